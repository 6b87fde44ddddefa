"""SimHash near-duplicates found through an inverted index over fingerprint bytes.

A 64-bit fingerprint is eight bytes, each with its position.  Two fingerprints at
most ``4`` bits apart agree in at least ``8 - 4 = 4`` positional bytes.  The index
holds, for each fingerprint, keys made of a few of its positional bytes; the chosen
position sets are such that any four positions contain one of them, so two
fingerprints which reach the guaranteed minimum share a key.  Within a key the shared
positional bytes of each pair are tallied, pairs with fewer than four are dropped and
the rest verified bit by bit.

Defined results for odd inputs: a null text counts as empty; a text without words has
fingerprint zero and links like any other; rows that repeat give rows that repeat; a
null ``doc_id`` takes part in links but never names a component (a component of such
rows only has a null id); an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweave.deploy import ship
from pixelweave.llm.common import connected_components, discard, materialize, shuffle_partitions

SEED = 42
MAX_BITS = 4
BYTES = 8
#: Buckets above this size are linked by pivots before pairs are compared.
SMALL_BUCKET = 64
#: Comparisons beyond which a bucket is split by further bytes.
FINER = 1 << 26
#: Pairs compared at once by one worker.
PAIR_BLOCK = 2_000_000


def fingerprint(text: str | None, width: int = 4) -> int:
    """Fingerprint of one text: bit is 1 where over half the shingle hashes have it."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(size) - 1
    starts = (ends - size + 1)[: len(words) - width + 1].tolist()
    stops = ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(starts), 65536):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[lo : lo + 65536], stops[lo : lo + 65536])], dtype=np.uint64)
        ones += _bit_sums(h)
    bits = (2 * ones > len(starts)).astype(np.uint64)
    return int(np.bitwise_or.reduce(bits << np.arange(64, dtype=np.uint64)))


def _bit_sums(h: np.ndarray) -> np.ndarray:
    """How many hashes have bit 0..63 set."""
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _fingerprint_batches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return run


def position_sets(size: int) -> list[tuple[int, ...]]:
    """Sets of ``size`` byte positions such that any four of eight contain one."""
    groups = ((0, 1, 2), (3, 4, 5), (6, 7))
    if size == 2:
        return [c for g in groups for c in combinations(g, 2)]
    if size == 3:
        inside = [c for g in groups for c in combinations(g, 3)]
        across = [(*c, x) for g, h in zip(groups, groups[1:] + groups[:1]) for c in combinations(g, 2) for x in h]
        return inside + across
    return list(combinations(range(BYTES), 4))


def key_width(n: int) -> int:
    """Bytes in a key, so that keys of random fingerprints hold few entries each."""
    return 2 if n <= 1 << 24 else 3 if n <= 1 << 32 else 4


def _linked(a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    """Count filter, then verification, for two arrays of fingerprints."""
    x = a ^ b
    shared = np.zeros(x.shape, np.uint8)
    for p in range(BYTES):
        shared += (x >> np.uint64(8 * p)) & np.uint64(255) == 0
    out = shared >= BYTES - max_bits
    out[out] = np.bitwise_count(x[out]) <= max_bits
    return out


class _Forest:
    """Least-index labels under union of index pairs, all in numpy."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        while len(i):
            a, b = label[i], label[j]
            differ = a != b
            if not differ.any():
                break
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                short = label[label]
                if (short == label).all():
                    break
                label = short
        self.label = label


def spanning_links(fp: np.ndarray, max_bits: int = MAX_BITS, finer: bool = True) -> np.ndarray:
    """For the members of one bucket: index of the least member linked to each.

    A large bucket is split by every four of the bytes, so work follows the members that
    agree in four bytes, not the square of the bucket.
    """
    n = len(fp)
    forest = _Forest(n)
    every = np.arange(n)
    if n > SMALL_BUCKET:
        for pivot in np.linspace(0, n - 1, 32).astype(np.int64):
            hit = every[_linked(fp, np.full(n, fp[pivot]), max_bits)]
            forest.add(hit, np.full(len(hit), pivot))
    main = np.bincount(forest.label).argmax()
    rest = every[forest.label != main] if n > SMALL_BUCKET else every
    if finer and len(rest) * n > FINER:
        # any two linked members agree in four bytes at least: compare within these
        for places in combinations(range(BYTES), 4):
            key = np.zeros(n, np.uint64)
            for p in places:
                key = key << np.uint64(8) | (fp >> np.uint64(8 * p)) & np.uint64(255)
            order = np.argsort(key, kind="stable")
            edges = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1], [True]]))
            several = np.flatnonzero(np.diff(edges) > 1)
            for a, b in zip(edges[several].tolist(), edges[several + 1].tolist()):
                own = order[a:b]
                if (forest.label[own] != forest.label[own[0]]).any():
                    forest.add(own, own[spanning_links(fp[own], max_bits, False)])
        return forest.label
    step = max(1, PAIR_BLOCK // max(1, n))
    for lo in range(0, len(rest), step):
        rows = rest[lo : lo + step]
        i, j = np.nonzero(_linked(fp[rows][:, None], fp[None, :], max_bits))
        forest.add(rows[i], j)
    return forest.label


def _small_buckets(key: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of many sorted buckets of at most SMALL_BUCKET members at once."""
    n = len(key)
    forest = _Forest(n)
    for gap in range(1, SMALL_BUCKET):
        same = np.flatnonzero(key[gap:] == key[:-gap])
        if not len(same):
            break
        hit = same[_linked(fp[same], fp[same + gap], max_bits)]
        forest.add(hit, hit + gap)
    moved = np.flatnonzero(forest.label != np.arange(n))
    return fp[moved], fp[forest.label[moved]]


def _bucket_links(max_bits: int):
    """Over a partition sorted by key: edges of a spanning forest of each key's links."""

    def solve(key: np.ndarray, fp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        small = np.repeat((sizes > 1) & (sizes <= SMALL_BUCKET), sizes)
        out = [_small_buckets(key[small], fp[small], max_bits)] if small.any() else []
        for s, m in zip(starts[sizes > SMALL_BUCKET], sizes[sizes > SMALL_BUCKET]):
            own = fp[s : s + m]
            label = spanning_links(own, max_bits)
            moved = np.flatnonzero(label != np.arange(m))
            out.append((own[moved], own[label[moved]]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        held_k, held_f = [], []

        def emit(found):
            for a, b in found:
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            held_k.append(batch.column(0).to_numpy(zero_copy_only=False))
            held_f.append(batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64))
            if held_k[-1][-1] == held_k[0][0]:
                continue
            keys, fps = np.concatenate(held_k), np.concatenate(held_f)
            cut = np.searchsorted(keys, keys[-1])
            yield from emit(solve(keys[:cut], fps[:cut]))
            held_k, held_f = [keys[cut:]], [fps[cut:]]
        if held_k:
            yield from emit(solve(np.concatenate(held_k), np.concatenate(held_f)))

    return run


def simhash_links(distinct: DataFrame, n: int, max_bits: int = MAX_BITS) -> DataFrame:
    """Spanning links ``(a, b)`` among distinct fingerprints (column ``fp``).

    Each key of the byte-position index sends back only a spanning forest of its links:
    the components are those of all links, and their number stays linear in the entries.
    """
    if max_bits != MAX_BITS:
        raise ValueError("the position sets guarantee a shared key for 4 differing bits")
    part = lambda p: F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))
    keys = []
    for k, positions in enumerate(position_sets(key_width(n))):
        value = F.lit(k).cast("long")
        for p in positions:
            value = F.shiftleft(value, 8).bitwiseOR(part(p))
        keys.append(value)
    entries = distinct.select(F.explode(F.array(*keys)).alias("key"), "fp")
    tasks = max(shuffle_partitions(distinct.sparkSession), 1)
    return entries.repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(_bucket_links(max_bits), "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id, kept``.

    ``component_id`` is the smallest id reachable through links of at most four bits and
    ``kept`` marks the document of that id.
    """
    ship(docs.sparkSession)
    prints = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_fingerprint_batches(width), "doc_id long, fp long"), "simhash-fp")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-distinct")
    parts = connected_components(simhash_links(distinct, distinct.count()), "simhash").withColumnsRenamed({"node": "fp", "component": "root"})
    rooted = distinct.join(parts, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = materialize(rooted, "simhash-rooted")
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    class_of = named.join(least, "root").select("fp", "component_id")
    return prints.join(class_of, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept")
    )
