"""Language-model scores by logistic mixing of hashed-context bit predictors.

A byte is the path of decisions in a binary code whose lengths follow the training
text's byte counts, so frequent bytes take few decisions and every byte has a path.  For
each decision several predictors answer, each from a table of counts in the slot that
its context (some preceding bytes) and the place in the code hash to.  Their answers, on
the logistic scale, are summed with weights that a gate chooses by how well filled the
longer contexts' slots are; a second table refines the sum by the place in the code; and
while a text goes on, scale and offset of its sum follow what was seen of it so far.

Learning is spread over the cluster and runs over pairs of a context and its next byte.
How often the training texts hold each distinct pair is summed up by fold, in a task and
then by a hash of the pair, so what a later step does for a pair it does once for all its
occurrences.  The pairs' decisions
are counted per slot and fold; gated weights and refinement are learnt online from all
pairs, each weighing as often as it occurs, in small steps in random order, fold by
fold, each against the counts of the other training folds, and averaged over tasks, a
fold going on from the weights of the one before; the final counts take in all training
folds.  Each predictor has at least four slots for every distinct pair of its context
and the next byte in the training texts (estimated from the pairs of least hash), so
counts and model grow with what the corpus holds; the model is broadcast.  A text is
scored byte by byte, but table look-ups are made once for equal pairs of a batch.

The base score is a smoothed unigram model over words whose counts come from the corpus
dictionary (``dictionary``).

Defined results: null text is an empty text (one end token, model score 0); repeated rows
give repeated rows; a null id hashes as the empty text; without training texts all counts
are zero; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweave.deploy import ship
from pixelweave.llm.common import discard, materialize, shuffle_partitions
from pixelweave.llm.dictionary import encode_words, per_document, segment_sums, token_rows

FOLDS, HELD_OUT = 5, 1
TRAINING = tuple(f for f in range(FOLDS) if f != HELD_OUT)
#: Preceding bytes that each predictor sees.
ORDERS = (2, 3, 5)
#: The predictor whose slots set the gate together with those of the longest.
GATE = 0
#: Least slots of a predictor's table, and the most that 32-bit slot numbers with a bit allow.
SLOT_BITS, MOST_BITS = 22, 31
#: Slots for each distinct pair of context and next byte, and hashes that pairs are estimated from.
PAIR_SLOTS, SKETCH = 4, 4096
#: Counts sent in one row.
BLOCK = 1 << 17
#: Text worked on at once, and bytes after which a text's scale and offset follow.
BATCH_BYTES = 800_000
STEP_BYTES = 512
#: Bytes whose pairs a task holds before it counts them, distinct pairs before it writes them,
#: pairs in a row and in a step of learning.
HELD_BYTES, HELD_PAIRS, ROW_PAIRS, STEP_PAIRS = 1 << 22, 1 << 20, 1 << 16, 1 << 10
#: Slot counts that a task holds before it sends them, and decisions scored at once.
HELD_SLOTS, SCORED = 1 << 21, 1 << 15
#: Slots of the table by which equal keys are found, as a power of two.
TABLE_BITS = 20
LEVELS, FILLED = 32, 8
REACH = 8.0
RATE, OWN_RATE = 0.02, 0.002
REFINE_BUCKETS = 33
PAD = 8
#: Bits of a pair below the number of its fold, and a multiplier of hashes.
FOLD_AT = 48
_MIX = 0x9E3779B97F4A7C15


def _crc(doc_id: int | None) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def fold_of(doc_id: int | None) -> int:
    return _crc(doc_id) % FOLDS


def _fold():
    """``fold_of`` as a column."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def text_key(raw: bytes) -> int:
    """A signed 64-bit hash that tells texts under one id apart."""
    return xxhash.xxh64_intdigest(raw) - (1 << 63)


def code_paths(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each byte the length of its path, and all paths' nodes and bits in one row."""
    heap = [(int(c) + 1, b) for b, c in enumerate(counts)]
    heapq.heapify(heap)
    children, fresh = {}, 256
    while len(heap) > 1:
        (n, a), (m, b) = heapq.heappop(heap), heapq.heappop(heap)
        children[fresh] = (a, b)
        heapq.heappush(heap, (n + m, fresh))
        fresh += 1
    paths: dict[int, list[tuple[int, int]]] = {}
    stack = [(fresh - 1, [])]
    while stack:
        node, path = stack.pop()
        if node < 256:
            paths[node] = path
        else:
            stack += [(kid, [*path, (node - 256, bit)]) for bit, kid in enumerate(children[node])]
    length = np.array([len(paths[b]) for b in range(256)])
    flat = [x for b in range(256) for x in paths[b]]
    return length, np.array([n for n, _ in flat], np.uint32), np.array([b for _, b in flat], np.uint8)


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Every byte (lowest) with the bytes before it, and the sizes of the texts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    joined = b"".join([bytes(PAD) + t for t in texts])
    every = np.ndarray((max(0, len(joined) - PAD + 1),), ">u8", joined, strides=(1,)) if len(joined) else np.zeros(0, ">u8")
    own = np.ones(len(joined), bool)
    starts = np.cumsum(sizes + PAD) - (sizes + PAD)
    own[(starts[:, None] + np.arange(PAD)[None, :]).ravel()] = False
    return every[np.flatnonzero(own) - (PAD - 1)].astype(np.uint64) & _up_to(max(ORDERS)), sizes


def _up_to(order: int) -> np.uint64:
    """Mask of a byte and ``order`` bytes before it."""
    return np.uint64((1 << 8 * (order + 1)) - 1)


def _at(table: np.ndarray, places: np.ndarray) -> np.ndarray:
    """``table[places]`` for places inside the table, without numpy's check of each."""
    return table.take(places, mode="clip")


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of every distinct key, in order, and for each key which of these
    is its own.

    Keys are written into a table by hash, the first one last; those that find an equal
    key in their slot belong to it, the others try again with another hash.
    """
    bits = min(TABLE_BITS, max(8, len(keys).bit_length()))
    table = np.empty(1 << bits, np.int32)
    shift = np.uint64(64 - bits)
    every = np.arange(len(keys), dtype=np.int32)
    h = ((keys * np.uint64(_MIX)) >> shift).view(np.int64)
    table[h[::-1]] = every[::-1]
    owner, turn = _at(table, h), 0
    left = np.flatnonzero(_at(keys, owner) != keys)
    while len(left):
        own, turn = _at(keys, left), turn + 2
        h = ((own * np.uint64(_MIX + turn)) >> shift).view(np.int64)
        table[h[::-1]] = left[::-1]
        found = _at(table, h)
        same = _at(keys, found) == own
        owner[left[same]] = found[same]
        left = left[~same]
    first = np.flatnonzero(owner == every)
    number = np.empty(len(keys), np.int32)
    number[first] = every[: len(first)]
    return first, _at(number, owner)


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and how often each occurs; sorts ``keys`` themselves."""
    keys.sort()
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[: len(keys)]
    return keys[starts], np.diff(starts, append=len(keys))


@dataclass
class Decisions:
    """All decisions of some texts.

    ``slots`` (by predictor), ``bits`` and ``nodes`` (places in the code) are those of the
    distinct pairs in the order in which they are met; ``start`` tells the first decision of
    each.  The texts' bytes are in order or, by
    steps, first the first step of every text, then the second of every text that has one,
    and so on; ``number`` is the pair of each and ``stops`` the decisions up to its end.
    ``runs`` are the decisions at which a text's part of a step starts, ``begins`` the bytes
    (both with the end), ``who`` its text,
    and ``steps`` the runs at which a step starts, with the end.  ``which`` says of each
    decision of some bytes which of the pairs' it is.
    """

    slots: list[np.ndarray]
    bits: np.ndarray
    nodes: np.ndarray
    start: np.ndarray
    number: np.ndarray
    stops: np.ndarray
    runs: np.ndarray | None = None
    begins: np.ndarray | None = None
    who: np.ndarray | None = None
    steps: np.ndarray | None = None

    def which(self, lo: int, hi: int) -> np.ndarray:
        ends = np.zeros(hi - lo + 1, np.int32)
        ends[0 if lo else 1 :] = self.stops[max(0, lo - 1) : hi]
        out = np.repeat(_at(self.start, self.number[lo:hi]) - ends[:-1], np.diff(ends))
        out += np.arange(ends[0], ends[-1], dtype=np.int32)
        return out


class Coder:
    """Turns pairs and texts into decisions."""

    def __init__(self, paths, slot_bits: tuple[int, ...] = (SLOT_BITS,) * len(ORDERS)):
        self.length, self.nodes, self.path_bits = paths
        self.slot_bits = slot_bits
        self.length = self.length.astype(np.int32)
        self.at = np.cumsum(self.length, dtype=np.int32) - self.length

    def paths_of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The pair, node and bit of each decision of pairs, and each pair's first one."""
        symbols = (keys & np.uint64(255)).astype(np.uint8)
        n = _at(self.length, symbols)
        stops = np.cumsum(n, dtype=np.int32)
        inner = np.repeat(_at(self.at, symbols) - (stops - n), n)
        inner += np.arange(len(inner), dtype=np.int32)
        return np.repeat(np.arange(len(keys), dtype=np.int32), n), _at(self.nodes, inner), _at(self.path_bits, inner), stops - n

    def slots_of(self, keys: np.ndarray, k: int, pair: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Slots of predictor ``k``: those of a context lie side by side."""
        h = ((keys & _up_to(ORDERS[k])) >> np.uint64(8)) + np.uint64(k + 1)
        h *= np.uint64(_MIX)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        slots = _at((h >> np.uint64(32)).astype(np.uint32), pair)
        slots += nodes
        slots &= np.uint32((1 << self.slot_bits[k]) - 1)
        return slots

    def decisions(self, texts: list[bytes], steps: bool = False) -> Decisions:
        keys, sizes = windows(texts)
        if steps:
            # the texts' parts of a step each, by step
            parts = -(-sizes // STEP_BYTES)
            who = np.repeat(np.arange(len(texts)), parts)
            step = np.arange(len(who)) - np.repeat(np.cumsum(parts) - parts, parts)
            order = np.argsort(step, kind="stable")
            who, step = who[order], step[order]
            size = np.minimum(sizes[who] - step * STEP_BYTES, STEP_BYTES)
            begins = np.cumsum(size) - size
            keys = _at(keys, np.repeat((np.cumsum(sizes) - sizes)[who] + step * STEP_BYTES - begins, size) + np.arange(len(keys)))
        first, number = grouped(keys)
        pairs = _at(keys, first)
        pair, nodes, bits, start = self.paths_of(pairs)
        slots = [self.slots_of(pairs, k, pair, nodes) for k in range(len(ORDERS))]
        stops = np.cumsum(_at(self.length, (keys & np.uint64(255)).astype(np.uint8)), dtype=np.int32)
        out = Decisions(slots, bits, nodes, start, number, stops)
        if steps and len(stops):
            out.begins, out.who = np.append(begins, len(keys)), who
            out.runs = np.append(np.int32(0), stops[out.begins[1:] - 1])
            out.steps = np.concatenate([np.flatnonzero(np.concatenate([[True], step[1:] != step[:-1]])), [len(begins)]])
        return out


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -12, 12)))


#: How well a slot with so many counts is filled, up to the last step.
_FILLING = np.searchsorted(np.array([1, 2, 3, 5, 10, 30, 200]), np.arange(201), side="right").astype(np.uint8)


def states(counts: np.ndarray) -> np.ndarray:
    """One byte for each slot: level on the logistic scale and how well it is filled."""
    n0, n1 = counts[0::2], counts[1::2]
    n = n0 + n1
    some = np.flatnonzero(n)
    level = np.log((n1[some].astype(np.float32) + np.float32(0.4)) / (n0[some].astype(np.float32) + np.float32(0.4)))
    level = np.clip(np.rint((level + REACH) * ((LEVELS - 1) / (2 * REACH))), 0, LEVELS - 1).astype(np.uint8)
    out = np.full(len(n), LEVELS // 2, np.uint8)
    out[some] = _FILLING[np.minimum(n[some], 200)] * np.uint8(LEVELS) + level
    return out


_LEVEL = (np.arange(256) % LEVELS * (2 * REACH) / (LEVELS - 1) - REACH).astype(np.float32)
_LEVEL[:LEVELS] = 0.0


class Mixer:
    """Gated weights over the predictors, and the refinement table."""

    def __init__(self, tables: list[np.ndarray], weights: np.ndarray | None = None, refine: np.ndarray | None = None):
        self.tables = tables
        self.weights = np.full((FILLED * FILLED, len(ORDERS)), 0.35, np.float32) if weights is None else weights
        self.refine = refine

    def found(self, slots: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        """States of slots by predictor, and the gate that they set."""
        out = [_at(t, s) for t, s in zip(self.tables, slots)]
        return out, (out[-1] // np.uint8(LEVELS)) * np.uint8(FILLED) + out[GATE] // np.uint8(LEVELS)

    def learn(self, slots: list[np.ndarray], bits: np.ndarray, times: np.ndarray) -> np.ndarray:
        """One online step over decisions that occur so many times each: their sums before
        it.  The gradient is averaged by gate."""
        found, gate = self.found(slots)
        x = [_at(_LEVEL, f) for f in found]
        s = np.zeros(len(gate), np.float32)
        for k in range(len(ORDERS)):
            s += _at(self.weights[:, k], gate) * x[k]
        miss = (bits - _squash(s)) * times
        n = np.maximum(np.bincount(gate, weights=times, minlength=len(self.weights)), 32)
        for k in range(len(ORDERS)):
            self.weights[:, k] += (RATE * np.bincount(gate, weights=miss * x[k], minlength=len(self.weights)) / n).astype(np.float32)
        return s

    @staticmethod
    def bucket(nodes: np.ndarray, s: np.ndarray) -> np.ndarray:
        return _place(s) + nodes.astype(np.int32) * REFINE_BUCKETS

    def mixed(self, slots: list[np.ndarray]) -> np.ndarray:
        """Weighted sums, by one table per predictor of gate and state."""
        found, gate = self.found(slots)
        gate = gate.astype(np.uint16) << np.uint16(8)
        out = np.zeros(len(gate), np.float32)
        for k, f in enumerate(found):
            out += _at((self.weights[:, k, None] * _LEVEL[None, :]).ravel(), gate | f)
        return out

    def log10(self, d: Decisions, texts: int) -> np.ndarray:
        """Log10 probability of every text, its scale and offset following it; the
        decisions must be by steps."""
        out = np.zeros(texts)
        if not len(d.stops):
            return out
        level = self.mixed(d.slots)
        right_of = None if self.refine is None else np.concatenate([1 - self.refine, self.refine])
        both = np.empty(len(level), [("level", np.float32), ("row", np.int32)])
        both["level"], both["row"] = level, (d.nodes.astype(np.int32) + d.bits * np.int32(255)) * REFINE_BUCKETS
        both = both.view(np.int64)
        scale, offset = np.ones(texts, np.float32), np.zeros(texts, np.float32)

        def follow(who, size, logs, miss, slope):
            out[who] += logs * _LOG10_E
            n = np.sqrt(size)
            offset[who] += np.clip(OWN_RATE * miss / n, -0.05, 0.05)
            scale[who] += np.clip(OWN_RATE * slope / n, -0.05, 0.05)

        ends = d.runs.astype(np.int64)
        # in the first step every text has the same scale and offset: by pair, not by decision
        first = slice(0, int(d.steps[1]))
        upto = int(d.begins[first.stop])
        met = int(d.number[:upto].max()) + 1  # pairs are numbered as they are met
        own = slice(0, int(d.start[met]) if met < len(d.start) else len(level))
        logs, miss = _outcomes(level[own], both.view(np.int32)[1::2][own].copy(), right_of)
        of_pair = [np.add.reduceat(x, d.start[:met], dtype=np.float64) for x in (logs, miss, miss * level[own])]
        follow(d.who[first], np.diff(ends[: first.stop + 1]), *(np.add.reduceat(_at(x, d.number[:upto]), d.begins[first]) for x in of_pair))
        rest = d.steps[1:]
        if len(rest) < 2:
            return out
        for ra, rb in _parts(rest, ends):
            a, b = ends[ra], ends[rb]
            start, size, who = ends[ra:rb] - a, np.diff(ends[ra : rb + 1]), d.who[ra:rb]
            own = _at(both, d.which(d.begins[ra], d.begins[rb]))
            v, row = own.view(np.float32)[0::2].copy(), own.view(np.int32)[1::2].copy()
            adapted = np.repeat(scale[who], size)
            adapted *= v
            adapted += np.repeat(offset[who], size)
            logs, miss = _outcomes(adapted, row, right_of)
            follow(who, size, np.add.reduceat(logs, start, dtype=np.float64), np.add.reduceat(miss, start), np.add.reduceat(np.multiply(miss, v, out=v), start))
        return out


def _outcomes(s: np.ndarray, row: np.ndarray, right_of: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of each bit under its sum, refined, and by how much it was missed;
    rows of the refinement table come first for bits that are 0."""
    flip = row - np.int32(255 * REFINE_BUCKETS)
    flip &= np.int32(-(1 << 31))  # the sign bit where the bit is 0
    wrong = np.clip(s, np.float32(-12), np.float32(12))
    signed = wrong.view(np.int32)
    signed ^= flip
    np.exp(wrong, out=wrong)
    wrong += np.float32(1)
    np.reciprocal(wrong, out=wrong)
    right = np.float32(1) - wrong
    if right_of is not None:
        place = _place(s)
        place += row
        right += _at(right_of, place)
        right *= np.float32(0.5)
    np.log(right, out=right)
    signed ^= flip
    return right, wrong


_LOG10_E = float(np.log10(np.e))


def _place(s: np.ndarray) -> np.ndarray:
    """Bucket of the refinement table for sums."""
    out = s + np.float32(REACH)
    out *= np.float32((REFINE_BUCKETS - 1) / (2 * REACH))
    out += np.float32(0.5)
    np.clip(out, 0, REFINE_BUCKETS - 1, out=out)
    return out.astype(np.int32)


def _parts(steps: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of one step, about SCORED decisions at a time."""
    for ra, rb in zip(steps[:-1].tolist(), steps[1:].tolist()):
        while ra < rb:
            to = max(ra + 1, min(rb, int(np.searchsorted(ends, ends[ra] + SCORED))))
            yield ra, to
            ra = to


def _batches(rows: Iterator[pa.RecordBatch], want) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and texts of wanted rows, about BATCH_BYTES at a time."""
    ids, texts, held = [], [], 0
    for batch in rows:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if want(i):
                ids.append(i)
                texts.append((t or "").encode("utf-8", "surrogatepass"))
                held += len(texts[-1])
                if held >= BATCH_BYTES:
                    yield ids, texts
                    ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def _pairs(buckets: int):
    """How often a task's training texts hold each distinct pair, by fold, packed by a
    hash of the pair."""

    def run(rows):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        fresh: list[np.ndarray] = []
        seen = 0

        def counted_in():
            if fresh:
                held.append(counted(np.concatenate(fresh)))
                fresh.clear()
                held[:] = [_in_order(held)]

        def written():
            keys, times = held[0]
            bucket = (_hash(keys & _up_to(max(ORDERS))) % np.uint64(buckets)).astype(np.min_scalar_type(buckets))
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for at in range(buckets):
                own = order[cuts[at] : cuts[at + 1]]
                yield from _pair_rows(at, keys[own], times[own])

        for ids, texts in _batches(rows, lambda i: fold_of(i) != HELD_OUT):
            keys, sizes = windows(texts)
            keys |= np.repeat(np.array([fold_of(i) for i in ids], np.uint64) << np.uint64(FOLD_AT), sizes)
            fresh.append(keys)
            seen += len(keys)
            if sum(map(len, fresh)) > HELD_BYTES:
                counted_in()
                if len(held[0][0]) > HELD_PAIRS or seen > 1 << 30:
                    yield from written()
                    held.clear()
                    seen = 0
        if seen:
            counted_in()
            yield from written()

    return run


def _pair_rows(bucket: int, keys: np.ndarray, times: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sorted keys as packed rows, each of one fold and of ROW_PAIRS at most."""
    fold = keys >> np.uint64(FOLD_AT)
    for f in TRAINING:
        a, b = np.searchsorted(fold, [f, f + 1])
        for lo in range(a, b, ROW_PAIRS):
            own = slice(lo, min(b, lo + ROW_PAIRS))
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([f], pa.int32()), pa.array([_packed_pairs(keys[own], times[own])], pa.binary())], names=["bucket", "fold", "pairs"])


def _merged_pairs(rows):
    """Over rows sorted by bucket: each distinct pair of a bucket once, by fold."""
    held, size, last = [], 0, None
    for batch in rows:
        for bucket, fold, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if bucket != last and held:
                yield from _pair_rows(last, *_in_order(held))
                held, size = [], 0
            keys, times = _unpacked_pairs(blob.as_py())
            held.append((keys | np.uint64(fold << FOLD_AT), times))
            last, size = bucket, size + len(keys)
            if size > 2 * HELD_PAIRS and size > 2 * len(held[0][0]):
                held = [_in_order(held)]
                size = len(held[0][0])
    if held:
        yield from _pair_rows(last, *_in_order(held))


def _in_order(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs in order, each once with all its times."""
    if len(held) == 1:
        return held[0]
    keys, times = (np.concatenate([h[c] for h in held]) for c in (0, 1))
    order = np.argsort(keys)
    keys, times = _at(keys, order), _at(times, order)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[: len(keys)]
    return keys[starts], np.add.reduceat(times, starts) if len(starts) else times


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, times = (np.concatenate([h[c] for h in held]) for c in (0, 1))
    first, number = grouped(keys)
    return _at(keys, first), np.bincount(number, weights=times, minlength=len(first)).astype(np.int64)


def _packed_pairs(keys: np.ndarray, times: np.ndarray) -> bytes:
    places = np.diff(keys & _up_to(max(ORDERS)), prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(places.tobytes() + times.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked_pairs(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(12, -1)
    keys = np.cumsum(np.ascontiguousarray(planes[:8].T).view("<u8").ravel(), dtype=np.uint64)
    return keys, np.ascontiguousarray(planes[8:].T).view("<u4").ravel().astype(np.int64)


def _histogram(rows):
    """Training bytes (``what`` -1), and by predictor the least hashes of its pairs."""
    total = np.zeros(256, np.int64)
    least = [np.zeros(0, np.uint64) for _ in ORDERS]
    for batch in rows:
        for blob in batch.column(0):
            keys, times = _unpacked_pairs(blob.as_py())
            total += np.bincount((keys & np.uint64(255)).astype(np.int64), weights=times, minlength=256).astype(np.int64)
            for k, order in enumerate(ORDERS):
                h = _hash(keys & _up_to(order))
                if len(least[k]) == SKETCH:
                    h = h[h < least[k][-1]]
                least[k] = smallest(np.concatenate([least[k], h]))
    what, at = [np.full(256, -1)], [np.arange(256)]
    for k, held in enumerate(least):
        what.append(np.full(len(held), k))
        at.append(held.astype(np.int64))
    at = np.concatenate(at)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(what), pa.int32()), pa.array(at), pa.array(np.concatenate([total, np.zeros(len(at) - 256, np.int64)]))], names=["what", "at", "n"])


def _hash(pairs: np.ndarray) -> np.ndarray:
    h = (pairs + np.uint64(1)) * np.uint64(_MIX)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h >> np.uint64(1)


def pair_hashes(texts: list[bytes]) -> Iterator[np.ndarray]:
    """By predictor, a 63-bit hash of each byte with its context."""
    keys, _ = windows(texts)
    for order in ORDERS:
        yield _hash(keys & _up_to(order))


def smallest(hashes: np.ndarray) -> np.ndarray:
    """The SKETCH least distinct hashes, in order."""
    if len(hashes) > 64 * SKETCH:  # most are far above the last that can stay
        for share in (58, 54):
            low = hashes[hashes < np.uint64(1 << share)]
            if len(np.unique(low)) < SKETCH:
                break
            hashes = low
    return np.unique(hashes)[:SKETCH]


def distinct_of(least: np.ndarray) -> int:
    """Distinct hashes in all, from the least of them in order."""
    return len(least) if len(least) < SKETCH else int((SKETCH - 1) * 2.0**63 / float(least[SKETCH - 1]))


def slot_bits_for(distinct: int) -> int:
    return min(MOST_BITS, max(SLOT_BITS, (PAIR_SLOTS * distinct - 1).bit_length()))


def _count(paths, slot_bits):
    """Counts of the decisions of pairs as rows of packed blocks, by fold."""

    def run(rows):
        coder = Coder(paths.value, slot_bits)
        tables: dict[tuple[int, int], list[np.ndarray]] = {}
        pack = zstandard.ZstdCompressor(level=1)

        def sent():
            for fold, k in sorted(tables):
                table = _added(tables.pop((fold, k)))
                at = (table >> np.uint64(32)).astype(np.uint32)
                for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at // BLOCK)) + 1):
                    own = slice(part[0], part[-1] + 1)
                    b, places = int(at[part[0]]) // BLOCK, np.diff(at[own] % BLOCK, prepend=np.uint32(0))
                    planes = np.concatenate([places, table[own].astype(np.uint32)]).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([b], pa.int32()), pa.array([fold], pa.int32()), pa.array([pack.compress(planes)], pa.binary())], names=["k", "block", "fold", "counts"])

        for batch in rows:
            for fold, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys, times = _unpacked_pairs(blob.as_py())
                for k in reversed(range(len(ORDERS))):
                    keys, times = _summed([(keys & _up_to(ORDERS[k]), times)])
                    pair, nodes, bits, _ = coder.paths_of(keys)
                    held = tables.setdefault((fold, k), [])
                    held.append(tally(coder.slots_of(keys, k, pair, nodes), bits, _at(times, pair)))
                    if sum(map(len, held[1:])) > max(1 << 18, len(held[0])):
                        held[:] = [_added(held)]
                if sum(len(t) for held in tables.values() for t in held) > HELD_SLOTS:
                    yield from sent()
        yield from sent()

    return run


def tally(slots: np.ndarray, bits: np.ndarray, times: np.ndarray) -> np.ndarray:
    """How often each slot met each bit: (2 * slot + bit) << 32 | count, in order."""
    at = slots << np.uint32(1)
    at |= bits
    return _added([at.astype(np.uint64) << np.uint64(32) | times.astype(np.uint64)], ordered=False)


def _added(tallies: list[np.ndarray], ordered: bool = True) -> np.ndarray:
    """One tally of several, each in order of its slots and bits."""
    if ordered and len(tallies) == 1:
        return tallies[0]
    every = np.concatenate(tallies)
    every.sort()
    at = every >> np.uint64(32)
    starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))[: len(at)]
    every &= np.uint64(0xFFFFFFFF)
    return (at[starts] << np.uint64(32)) | np.minimum(np.add.reduceat(every, starts), np.uint64(0xFFFFFFFF)) if len(at) else every


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places in a block and their counts."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    both = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().reshape(2, -1)
    return np.cumsum(both[0], dtype=np.int64), both[1].astype(np.int64)


def _reduce(rows):
    """Sum blocks of a partition sorted by (k, block), one at a time, to slot states:
    without each of the training folds, and of all."""

    def emit(key, sums):
        whole = sum(sums.values())
        found = {f"without_{f}": states(whole - sums[f]) for f in TRAINING} | {"whole": states(whole)}
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in found.values())], names=["k", "block", *found])

    key, sums = None, None
    for batch in rows:
        for k, b, fold, blob in zip(*(batch.column(c) for c in range(4))):
            now = (k.as_py(), b.as_py())
            if now != key:
                if key is not None:
                    yield emit(key, sums)
                key, sums = now, {f: np.zeros(BLOCK, np.int64) for f in TRAINING}
            places, counts = _unpacked(blob.as_py())
            sums[fold.as_py()][places] += counts
    if key is not None:
        yield emit(key, sums)


def _learn(paths, slot_bits, tables, weights):
    """Weights of one task after its online pass, and its refinement counts."""

    def run(rows):
        coder, mixer = Coder(paths.value, slot_bits), Mixer(tables.value, weights.astype(np.float32))
        refine = np.zeros((2, 255 * REFINE_BUCKETS))
        rng = np.random.default_rng(len(ORDERS))
        seen = 0.0
        for batch in rows:
            for blob in batch.column(0):
                keys, times = _unpacked_pairs(blob.as_py())
                order = rng.permutation(len(keys))
                for lo in range(0, len(keys), STEP_PAIRS):
                    own = order[lo : lo + STEP_PAIRS]
                    pair, nodes, bits, _ = coder.paths_of(keys[own])
                    n = _at(times[own].astype(np.float32), pair)
                    sums = mixer.learn([coder.slots_of(keys[own], k, pair, nodes) for k in range(len(ORDERS))], bits, n)
                    where = mixer.bucket(nodes, sums)
                    refine[0] += np.bincount(where, weights=n, minlength=refine.shape[1])
                    refine[1] += np.bincount(where, weights=n * bits, minlength=refine.shape[1])
                seen += float(times.sum())
        if seen:
            w = mixer.weights.ravel().astype(np.float64) * seen
            some = np.flatnonzero(refine[0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([np.zeros(len(w), np.int32), np.ones(len(some), np.int32)])), pa.array(np.concatenate([np.arange(len(w)), some])),
                 pa.array(np.concatenate([np.full(len(w), seen), refine[0][some]])), pa.array(np.concatenate([w, refine[1][some]]))],
                names=["what", "at", "n", "v"],
            )

    return run


def _score(paths, slot_bits, model):
    def run(rows):
        coder = Coder(paths.value, slot_bits)
        tables, weights, refine = model.value
        mixer = Mixer(tables, weights, refine)
        for ids, texts in _batches(rows, lambda i: True):
            out = mixer.log10(coder.decisions(texts, steps=True), len(texts))
            keys = [text_key(t) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(out)], names=["doc_id", "text_key", "n_bytes", "score"])

    return run


def _collected(reduced: DataFrame, column: str, slot_bits: tuple[int, ...]) -> list[np.ndarray]:
    """Slot states by predictor, a byte for each slot."""
    tables = [np.zeros(1 << b, np.uint8) for b in slot_bits]
    half = BLOCK // 2
    for k, b, blob in reduced.select("k", "block", column).collect():
        tables[k][b * half : (b + 1) * half] = np.frombuffer(blob, np.uint8)
    return tables


def model_scores(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, n_bytes, score`` for rows ``doc_id, text``."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    tasks = shuffle_partitions(spark)
    schema = "bucket int, fold int, pairs binary"
    apart = docs.mapInArrow(_pairs(tasks), schema).repartition(tasks, "bucket").sortWithinPartitions("bucket")
    pairs = materialize(apart.mapInArrow(_merged_pairs, schema), "lm-pairs")
    found = materialize(pairs.select("pairs").mapInArrow(_histogram, "what int, at long, n long").groupBy("what", "at").agg(F.sum("n").alias("n")), "lm-histogram")
    counts = np.zeros(256, np.int64)
    for b, n in found.where("what = -1").select("at", "n").collect():
        counts[b] = n
    least = [np.array([at for at, in found.where(F.col("what") == k).select("at").orderBy("at").limit(SKETCH).collect()], np.int64) for k in range(len(ORDERS))]
    slot_bits = tuple(slot_bits_for(distinct_of(x)) for x in least)
    discard(found)
    paths = sc.broadcast(code_paths(counts))
    blocks = pairs.select("fold", "pairs").mapInArrow(_count(paths, slot_bits), "k int, block int, fold int, counts binary")
    dealt = blocks.repartition(tasks, "k", "block").sortWithinPartitions("k", "block")
    reduced = materialize(dealt.mapInArrow(_reduce, "k int, block int, " + ", ".join(f"without_{f} binary" for f in TRAINING) + ", whole binary"), "lm-states")
    weights, prior = Mixer([]).weights, np.tile(_squash(np.linspace(-REACH, REACH, REFINE_BUCKETS)), 255)
    hits, ones = np.full(len(prior), 20.0), 20 * prior
    for fold in TRAINING:
        part = sc.broadcast(_collected(reduced, f"without_{fold}", slot_bits))
        own = pairs.where(F.col("fold") == fold).select("pairs")
        learnt = own.mapInArrow(_learn(paths, slot_bits, part, weights), "what int, at long, n double, v double").groupBy("what", "at").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
        part.destroy()
        weights = weights.copy()
        for what, at, n, v in learnt:
            if what == 0:
                weights.flat[at] = v / n
            else:
                hits[at] += n
                ones[at] += v
    model = sc.broadcast((_collected(reduced, "whole", slot_bits), weights, np.clip(ones / hits, 1e-5, 1 - 1e-5).astype(np.float32)))
    scored = materialize(docs.mapInArrow(_score(paths, slot_bits, model), "doc_id long, text_key long, n_bytes long, score double"), "lm-scores")
    model.destroy()
    discard(reduced, pairs)
    return scored


def base_scores(docs: DataFrame, chunk_bytes: int = 32 << 20) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score`` under smoothed word counts."""

    chunks = encode_words(docs, lambda raw: [text_key(raw)], lambda i: fold_of(i) != HELD_OUT, chunk_bytes, "lm-dictionary")
    rows = token_rows(chunks)
    totals = materialize(rows.groupBy("token").agg(F.sum("trained").alias("value")).where("value > 0"), "lm-counts")
    distinct, words = totals.agg(F.count(F.lit(1)), F.coalesce(F.sum("value"), F.lit(0))).first()
    known = rows.select("chunk", "pos", "token").join(totals, "token").select("chunk", "pos", "value")
    ends = docs.select("doc_id").where(_fold() != HELD_OUT).count()
    total, vocabulary = words + ends, distinct + (1 if ends else 0)
    norm = total + 0.5 * (vocabulary + 1)

    def reduce(ids, stats, starts, value, counts):
        n = segment_sums(counts, starts)
        part = segment_sums(counts * np.log10((value + 0.5) / norm), starts)
        return {
            "doc_id": ids, "text_key": stats, "n_tokens": n + 1, "n_known": segment_sums(counts * (value > 0), starts) + (1 if ends else 0), "train_tokens": np.full(len(n), total),
            "base_score": part + np.log10((ends + 0.5) / norm),
        }

    return per_document(chunks, known, reduce, "doc_id long, text_key long, n_tokens long, n_known long, train_tokens long, base_score double")


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base and model scores of every text, held out or not."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    model = model_scores(rows)
    base = base_scores(rows)
    once = model.groupBy(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).agg(F.first("n_bytes").alias("n_bytes"), F.first("score").alias("score"))
    joined = base.join(once, base["doc_id"].eqNullSafe(F.col("id")) & (base["text_key"] == F.col("key")), "left")
    held = _fold() == HELD_OUT
    bits = -F.col("score") * float(np.log2(10))
    return joined.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", F.when(F.col("n_bytes") > 0, bits / F.col("n_bytes")).alias("bits_per_byte"))
