"""Removal of repeated byte strings by merged Burrows-Wheeler transforms.

Every byte covered by a string of ``LENGTH`` bytes that also starts earlier goes.

1. Each text is cut into segments: runs of windows of ``LENGTH`` bytes that have the same
   least k-mer hash.  Equal windows have equal least hashes, so a string can repeat only
   among segments of one name.  Segments go to buckets by name, packed by the thousands.
2. In a bucket, of equal segments all but the first are repeats as a whole.  Names that
   one segment has are done with.  Segments of a name with several different contents,
   or whose name occurs twice within, are asked for.
3. Their bytes are fetched and go to buckets by name again.  In a bucket, shards of
   segments get their Burrows-Wheeler transforms; these are merged by refining the
   interleave of the shards' suffixes, one more character in each round, no suffix being
   sorted again.  The rounds also refine blocks of suffixes with a common prefix; after
   ``LENGTH`` rounds a block is a repeated interval, and all its members but the first in
   the corpus are repeats.
4. The repeats of a document are united and cut out.

Tasks that pack segments take out what repeats within their own rows first, so a passage
in very many documents reaches a bucket once per batch of documents; a name with more than ``WIDE``
different segments is dealt out again window by window.

Defined results: null text is empty; texts below ``LENGTH`` bytes keep everything; rows
that repeat an id with an equal text are one document and get equal results; of rows with
one id and different texts the order is that of a text hash; a null id counts as smaller
than any; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweave.deploy import ship
from pixelweave.llm.common import materialize, shuffle_partitions

LENGTH = 100
#: Bytes in the k-mers that name a window, and k-mers in a window.
KMER = 40
SPAN = LENGTH - KMER + 1
#: Windows in a segment at most.
MOST = 256
#: Different segments of a name beyond which it is dealt out by windows.
WIDE = 50_000
#: Bytes of segments merged at once, and in a shard.
MERGED, SHARD = 2 << 20, 128 << 10
#: Bytes of text for each bucket and each task, and tasks at most (a task goes through its
#: buckets one by one, so more of them only take longer).
BUCKET_BYTES, TASK_BYTES, MOST_TASKS = 16 << 20, 64 << 20, 20_000
#: Strings of bytes that a table looks up when rounds compare several bytes at once.
SYMBOL_CODES = 1 << 22

_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xBF58476D1CE4E5B9)
LEAST = -(1 << 63)


def rolling(raw: np.ndarray, length: int) -> np.ndarray:
    """Hash of every substring of ``length`` bytes, from those of powers of two."""
    part = raw.astype(np.uint64) + np.uint64(1)
    have, total, done = 1, None, 0
    while True:
        if length & have:
            if total is None:
                total = part.copy()
            else:
                n = len(raw) - done - have + 1
                total = total[:n] + part[done : done + n] * np.uint64(pow(_BASE, done, 1 << 64))
            done += have
        if done == length:
            break
        n = len(raw) - 2 * have + 1
        part = part[:n] + part[have : have + n] * np.uint64(pow(_BASE, have, 1 << 64))
        have *= 2
    total ^= total >> np.uint64(29)
    total *= _MIX
    total ^= total >> np.uint64(32)
    return total


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    have, out = 1, x
    while 2 * have <= width:
        out = op(out[: len(out) - have], out[have:])
        have *= 2
    gap = width - have
    return op(out[: len(out) - gap], out[gap:]) if gap else out


def segments(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Name, first window, windows of each segment, and whether its name is that of
    more than one k-mer of the text (then it may repeat within itself)."""
    kmers = rolling(raw, KMER)
    least = _sliding(kmers, SPAN, np.minimum)
    start = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    size = np.diff(np.concatenate([start, [len(least)]]))
    name = least[start]
    edge = np.zeros(SPAN - 1, np.uint64)
    named = np.flatnonzero(kmers == _sliding(np.concatenate([edge, least, edge]), SPAN, np.maximum))
    values, n = np.unique(kmers[named], return_counts=True)
    inner = n[np.searchsorted(values, name)] > 1
    if size.max() > MOST:
        parts = -(-size // MOST)
        start = np.repeat(start, parts) + MOST * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
        name, inner = np.repeat(name, parts), np.repeat(inner, parts)
        size = np.diff(np.concatenate([start, [len(least)]]))
    return name, start, size, inner


# ---- packed rows ---------------------------------------------------------------

_RECORD = np.dtype([("name", "<u8"), ("hash", "<u8"), ("doc", "<i8"), ("text", "<i8"), ("start", "<i4"), ("n", "<i4"), ("inner", "u1")])
_PIECE = np.dtype([("name", "<u8"), ("doc", "<i8"), ("text", "<i8"), ("start", "<i4"), ("size", "<i4")])
_RANGES = "doc long, text long, start int, end int"


def _pack(records: np.ndarray, tail: bytes = b"") -> bytes:
    """Fields one after another; hashes do not compress, the rest does well."""
    body = b"".join(np.ascontiguousarray(records[f]).view(np.uint8).reshape(len(records), -1).T.tobytes() for f in records.dtype.names)
    return len(records).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(body + tail)


def _unpack(blob: bytes, dtype: np.dtype) -> tuple[np.ndarray, bytes]:
    n = int.from_bytes(blob[:8], "little")
    raw = zstandard.ZstdDecompressor().decompress(blob[8:])
    out, at = np.zeros(n, dtype), 0
    for f in dtype.names:
        width = dtype[f].itemsize
        out[f] = np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).view(dtype[f]).ravel()
        at += n * width
    return out, raw[at:]


def _by_bucket(records: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    where = (records["name"] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(where, kind="stable")
    cuts = np.searchsorted(where[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)):
        yield int(b), order[cuts[b] : cuts[b + 1]]


def _first_of_equal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The records sorted, with a flag for the first of those with equal content, and one for
    those which are its later repeats (the same place twice is no repeat)."""
    r = r[np.lexsort((r["start"], r["text"], r["doc"], r["n"], r["hash"], r["name"]))]
    same = lambda *fs: np.concatenate([[False], np.logical_and.reduce([r[f][1:] == r[f][:-1] for f in fs])])
    first = ~same("name", "hash", "n")
    lead = np.maximum.accumulate(np.where(first, np.arange(len(r)), 0))
    repeat = ~first & ((r["doc"] != r["doc"][lead]) | (r["text"] != r["text"][lead]) | (r["start"] != r["start"][lead]))
    return r, first, repeat


def _ranges(r: np.ndarray) -> np.ndarray:
    """Bytes that whole segments cover, as united ranges (doc, text, start, end)."""
    if not len(r):
        return np.zeros((4, 0), np.int64)
    r = r[np.lexsort((r["start"], r["text"], r["doc"]))]
    end = r["start"].astype(np.int64) + r["n"] + LENGTH - 1
    fresh = np.concatenate([[True], (r["doc"][1:] != r["doc"][:-1]) | (r["text"][1:] != r["text"][:-1]) | (r["start"][1:] > end[:-1])])
    at = np.flatnonzero(fresh)
    return np.stack([r["doc"][at], r["text"][at], r["start"][at], np.maximum.reduceat(end, at)])


def _rows(bucket, payload, ranges: np.ndarray) -> pa.RecordBatch:
    """Packed rows first, then ranges, in one schema."""
    n, m = len(bucket), ranges.shape[1]
    nothing = lambda t, k: pa.nulls(k, t)
    join = lambda a, b: pa.concat_arrays([a, b])
    columns = [join(pa.array(bucket, pa.int32()), nothing(pa.int32(), m)), join(pa.array(payload, pa.binary()), nothing(pa.binary(), m))]
    for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32())):
        columns.append(join(nothing(t, n), pa.array(ranges[k], pa.int64()).cast(t)))
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "payload", "doc", "text", "start", "end"])


_MIXED = "bucket int, payload binary, doc long, text long, start int, end int"


def _cut_segments(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            found = []
            for doc, key, text in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if len(text) < LENGTH:
                    continue
                name, start, size, inner = segments(np.frombuffer(text, np.uint8))
                r = np.zeros(len(name), _RECORD)
                r["name"], r["start"], r["n"], r["inner"] = name, start, size, inner
                r["doc"], r["text"] = LEAST if doc is None else doc, key
                r["hash"] = [digest(text[a : a + n]) for a, n in zip(start.tolist(), (size + LENGTH - 1).tolist())]
                found.append(r)
            if found:
                r, _, repeat = _first_of_equal(np.concatenate(found))
                kept = r[~repeat]
                parts = [(b, _pack(kept[own])) for b, own in _by_bucket(kept, buckets)]
                yield _rows([b for b, _ in parts], [p for _, p in parts], _ranges(r[repeat]))

    return run


def _passed(batch: pa.RecordBatch) -> tuple[list, np.ndarray]:
    """Packed payloads of a batch, and the ranges that pass through."""
    ranges = batch.filter(pc.is_valid(batch.column(2)))
    return [p for p in batch.column(1).to_pylist() if p is not None], np.stack([ranges.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(2, 6)])


def _resolve_equal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket partition: whole repeats as ranges, and the segments to ask for as rows
    with ``start`` and, as ``end``, minus the number of windows; ``bucket`` tells wide
    names."""
    held = []
    for batch in batches:
        payloads, ranges = _passed(batch)
        held += [_unpack(p, _RECORD)[0] for p in payloads]
        if ranges.shape[1]:
            yield _asks(np.zeros(0, _RECORD), np.zeros(0, bool), ranges)
    if not held:
        return
    r, first, repeat = _first_of_equal(np.concatenate(held))
    lead = r[first]
    at = np.flatnonzero(np.concatenate([[True], lead["name"][1:] != lead["name"][:-1]]))
    n = np.diff(np.concatenate([at, [len(lead)]]))
    n = np.repeat(n, n)
    ask = (n > 1) | (lead["inner"] > 0)
    yield _asks(lead[ask], n[ask] > WIDE, _ranges(r[repeat]))


_ASKS = "name long, wide boolean, doc long, text long, start int, end int, n int"


def _asks(lead: np.ndarray, wide: np.ndarray, ranges: np.ndarray) -> pa.RecordBatch:
    m = ranges.shape[1]
    full = lambda a, b, t: pa.array(np.concatenate([a.astype(np.int64), b]), pa.int64()).cast(t)
    return pa.RecordBatch.from_arrays(
        [pa.concat_arrays([pa.array(lead["name"].view(np.int64) if len(lead) else np.zeros(0, np.int64), pa.int64()), pa.nulls(m, pa.int64())]),
         pa.concat_arrays([pa.array(wide, pa.bool_()), pa.nulls(m, pa.bool_())]),
         full(lead["doc"], ranges[0], pa.int64()), full(lead["text"], ranges[1], pa.int64()), full(lead["start"], ranges[2], pa.int32()),
         full(lead["start"] + lead["n"] + LENGTH - 1, ranges[3], pa.int32()), pa.concat_arrays([pa.array(lead["n"].astype(np.int32), pa.int32()), pa.nulls(m, pa.int32())])],
        names=["name", "wide", "doc", "text", "start", "end", "n"],
    )


def _fetch(buckets: int):
    """Documents with their asked segments: the bytes, packed by bucket of name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, bodies = [], []
            for doc, key, text, asked in zip(*(batch.column(c).to_pylist() for c in range(4))):
                doc = LEAST if doc is None else doc
                for a in asked:
                    if a["wide"]:
                        for s in range(a["start"], a["end"] - LENGTH + 1):
                            own = text[s : s + LENGTH]
                            keys.append((xxhash.xxh64_intdigest(own), doc, key, s, LENGTH))
                            bodies.append(own)
                    else:
                        own = text[a["start"] : a["end"]]
                        keys.append((a["name"] % (1 << 64), doc, key, a["start"], len(own)))
                        bodies.append(own)
            if not keys:
                continue
            pieces = np.array(keys, _PIECE)
            same = np.array([xxhash.xxh64_intdigest(b) for b in bodies], np.uint64)
            r = np.zeros(len(pieces), _RECORD)
            for f in ("name", "doc", "text", "start"):
                r[f] = pieces[f]
            r["hash"], r["n"] = same, pieces["size"] - LENGTH + 1
            order = np.lexsort((r["start"], r["text"], r["doc"], r["n"], r["hash"], r["name"]))
            _, _, repeat = _first_of_equal(r)
            kept = order[~repeat]
            parts = []
            for b, own in _by_bucket(pieces[kept], buckets):
                rows = kept[own]
                parts.append((b, _pack(pieces[rows], b"".join(bodies[i] for i in rows))))
            yield _rows([b for b, _ in parts], [p for _, p in parts], _ranges(r[order][repeat]))

    return run


# ---- Burrows-Wheeler transforms ------------------------------------------------


def shard_transform(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes of a shard, as positions, by doubling sorted lengths.

    ``text`` holds segments, each ended by 0, other bytes being one higher than theirs;
    ends are told apart by their place, so no two suffixes are equal.  Only suffixes that
    are not yet told apart are sorted on; a rank is the number of smaller suffixes.
    """
    n = len(text)
    ends = np.flatnonzero(text == 0)
    below = np.cumsum(np.bincount(text, minlength=1)) - np.bincount(text, minlength=1)
    rank = below[text]
    rank[ends] = np.arange(len(ends))
    tied = np.flatnonzero(text > 0)
    have = 1
    while len(tied):
        after = tied + have
        key = rank[tied] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        order = np.argsort(key, kind="stable")
        tied, key = tied[order], key[order]
        old = rank[tied]
        place = np.arange(len(tied))
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        head = np.concatenate([[True], old[1:] != old[:-1]])
        rank[tied] = old + np.maximum.accumulate(np.where(fresh, place, 0)) - np.maximum.accumulate(np.where(head, place, 0))
        start = np.flatnonzero(fresh)
        size = np.diff(np.concatenate([start, [len(tied)]]))
        tied = tied[np.repeat(size > 1, size)]
        have *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


def merge_transforms(shards: list[np.ndarray], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Repeated intervals of the merged shards: rows in merged order, and their blocks.

    A shard is its transform, the byte before each of its suffixes in order, 0 at a
    segment's start; rows count through the shards.  The interleave of the shards' rows
    starts as one block in which no byte is compared.  A round moves every row to its
    suffix with a few more bytes in front (``_strides``): rows with equal such bytes and
    of one block form the new blocks, in the order of bytes and block, so when ``k``
    bytes are compared a block holds the suffixes with one prefix of ``k`` bytes.  What is
    alone in its block stays alone in all further rounds and is let go.
    """
    offset, step = 0, []
    for bwt in shards:
        order = np.argsort(bwt, kind="stable")
        follow = np.empty(len(bwt), np.int32)
        follow[order] = np.arange(offset, offset + len(bwt), dtype=np.int32)
        step.append(follow)
        offset += len(bwt)
    bwt, step = np.concatenate(shards), np.concatenate(step)
    rows, block = np.arange(len(bwt), dtype=np.int32), np.zeros(len(bwt), np.int32)
    for symbols, target, turns in _strides(bwt, step, rounds):
        for _ in range(turns):
            chars = symbols[rows]
            inside = np.flatnonzero(chars)
            order = inside[np.argsort(chars[inside], kind="stable")]
            moved, before = chars[order], block[order]
            fresh = np.concatenate([[True], (moved[1:] != moved[:-1]) | (before[1:] != before[:-1])])[: len(order)]
            start = np.flatnonzero(fresh)
            size = np.diff(np.concatenate([start, [len(order)]]))
            many = size > 1
            rows = target[rows[order[np.repeat(many, size)]]]
            block = np.repeat(np.arange(int(many.sum()), dtype=np.int32), size[many])
            if not len(rows):
                return rows, block
    return rows, block


def _strides(bwt: np.ndarray, step: np.ndarray, rounds: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """How ``rounds`` bytes are compared: for each row a symbol, in order, for the bytes
    before it (0 where there are fewer), the row that these lead to, and how many times.

    As many bytes go into a symbol as let symbols stay below 2^16.
    """
    used = np.flatnonzero(np.bincount(bwt))
    letter = np.zeros(int(bwt.max(initial=0)) + 1, np.int64)
    letter[used] = np.arange(len(used)) if len(used) and used[0] == 0 else np.arange(1, len(used) + 1)
    letters = len(used) + 1
    width = max(1, min(rounds, int(np.log(SYMBOL_CODES) / np.log(max(letters, 2)))))
    while True:
        known: list[tuple[np.ndarray, np.ndarray]] = []
        code, target, scale = letter[bwt], step, 1
        inside = bwt > 0
        for k in range(1, width + 1):
            if k in (width, rounds % width):
                mark = np.zeros(scale * letters, bool)
                mark[code[inside]] = True
                if k > 1 and mark.sum() >= 1 << 16:
                    break
                symbols = np.cumsum(mark).astype(np.uint16)[code]
                symbols[~inside] = 0
                known.append((symbols, target))
            if k < width:
                scale *= letters
                code = code + letter[bwt[target]] * scale
                inside &= bwt[target] > 0
                target = step[target]
        else:
            break
        width -= 1
    if rounds % width:
        yield *known[0], 1
    yield *known[-1], rounds // width


def repeated_windows(pieces: np.ndarray, body: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Windows (piece, place) that also start earlier in the corpus, given pieces in
    corpus order, their bytes end to end, and where each piece's bytes start."""
    size = pieces["size"].astype(np.int64)
    cuts = [0]
    for i in range(len(pieces)):
        if offset[i] + size[i] - offset[cuts[-1]] > SHARD and i > cuts[-1]:
            cuts.append(i)
    cuts.append(len(pieces))
    kind = np.uint8 if not len(body) or body.max() < 255 else np.uint16
    shards, places = [], []
    for a, b in zip(cuts[:-1], cuts[1:]):
        at = offset[a:b] - offset[a] + np.arange(b - a)
        text = np.zeros(int(size[a:b].sum()) + b - a, kind)
        inside = np.ones(len(text), bool)
        inside[at + size[a:b]] = False
        text[inside] = body[offset[a] : offset[a] + size[a:b].sum()].astype(kind) + kind(1)
        order = shard_transform(text)
        last = text[order - 1]
        starts = np.zeros(len(text), bool)
        starts[at] = True
        last[starts[order]] = 0
        shards.append(last)
        owner = np.repeat(np.arange(a, b), size[a:b] + 1)
        inner = np.arange(len(text)) - np.repeat(at, size[a:b] + 1)
        places.append((owner[order], inner[order]))
    rows, block = merge_transforms(shards, LENGTH)
    owner, inner = (np.concatenate([p[k] for p in places])[rows] for k in (0, 1))
    full = inner + LENGTH <= size[owner]
    owner, inner, block = owner[full], inner[full], block[full]
    if not len(block):
        return np.zeros((2, 0), np.int64)
    place = pieces["start"][owner].astype(np.int64) + inner
    order = np.lexsort((place, pieces["text"][owner], pieces["doc"][owner], block))
    owner, inner, block, place = owner[order], inner[order], block[order], place[order]
    lead = np.concatenate([[True], block[1:] != block[:-1]])
    at = np.maximum.accumulate(np.where(lead, np.arange(len(block)), 0))
    repeat = ~lead & ((pieces["doc"][owner] != pieces["doc"][owner[at]]) | (pieces["text"][owner] != pieces["text"][owner[at]]) | (place != place[at]))
    return np.stack([owner[repeat], inner[repeat]])


def _merge_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, tails = [], []
    for batch in batches:
        payloads, ranges = _passed(batch)
        for p in payloads:
            r, body = _unpack(p, _PIECE)
            held.append(r)
            tails.append(body)
        if ranges.shape[1]:
            yield _range_batch(ranges)
    if not held:
        return
    pieces, body = np.concatenate(held), np.frombuffer(b"".join(tails), np.uint8)
    offset = np.cumsum(pieces["size"].astype(np.int64)) - pieces["size"]
    order = np.lexsort((pieces["start"], pieces["text"], pieces["doc"], pieces["name"]))
    names = pieces["name"][order]
    heads = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
    sizes = np.add.reduceat(pieces["size"][order].astype(np.int64), heads)
    upto, cuts, now = np.concatenate([heads[1:], [len(order)]]), [0], 0
    for e, s in zip(upto, sizes):
        now += s
        if now >= MERGED:
            cuts.append(int(e))
            now = 0
    if cuts[-1] != len(order):
        cuts.append(len(order))
    for a, b in zip(cuts[:-1], cuts[1:]):
        own = order[a:b]
        size = pieces["size"][own].astype(np.int64)
        at = np.cumsum(size) - size
        take = np.repeat(offset[own] - at, size) + np.arange(size.sum())
        found = repeated_windows(pieces[own], body[take], at)
        if found.shape[1]:
            r = np.zeros(found.shape[1], _RECORD)
            p = pieces[own][found[0]]
            r["doc"], r["text"], r["start"], r["n"] = p["doc"], p["text"], p["start"] + found[1], 1
            yield _range_batch(_ranges(r))


def _range_batch(ranges: np.ndarray) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(ranges[k], pa.int64()).cast(t) for k, t in enumerate(types)], names=["doc", "text", "start", "end"])


# ---- the operator ----------------------------------------------------------------


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for doc, text, spans in zip(*(batch.column(c).to_pylist() for c in range(3))):
            united: list[list[int]] = []
            for s in sorted((s["start"], s["end"]) for s in spans or ()):
                if united and s[0] <= united[-1][1]:
                    united[-1][1] = max(united[-1][1], s[1])
                else:
                    united.append([*s])
            kept, at = hashlib.sha256(), 0
            for a, b in united:
                kept.update(text[at:a])
                at = b
            kept.update(text[at:])
            for column, v in zip(out, (doc, len(text), sum(b - a for a, b in united), len(united), kept.hexdigest())):
                column.append(v)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _bucketwise(solve):
    """``solve`` over a partition sorted by bucket, one bucket at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            bucket = batch.column(0).fill_null(-1).to_numpy()
            cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if lo == hi:
                    continue
                if held and bucket[lo] != last:
                    yield from solve(iter(held))
                    held = []
                last = bucket[lo]
                held.append(batch.slice(lo, hi - lo))
                if last < 0:  # ranges only
                    yield from solve(iter(held))
                    held = []
        if held:
            yield from solve(iter(held))

    return run


def repeated_ranges(rows: DataFrame) -> DataFrame:
    """``(doc, text, start, end)`` byte ranges to remove, for ``doc_id, key, raw`` rows.

    Buckets and tasks follow the bytes of the texts; a task holds one bucket at a time.
    """
    size = rows.agg(F.sum(F.octet_length("raw").cast("long"))).first()[0] or 0
    tasks = max(shuffle_partitions(rows.sparkSession), min(size // TASK_BYTES, MOST_TASKS))
    buckets = max(64, 2 * tasks, size // BUCKET_BYTES)
    deal = lambda df: df.repartition(tasks, F.coalesce("bucket", F.pmod(F.col("doc"), F.lit(buckets)).cast("int"))).sortWithinPartitions("bucket")
    cut = rows.select("doc_id", "key", "raw").mapInArrow(_cut_segments(buckets), _MIXED)
    resolved = materialize(deal(cut).mapInArrow(_bucketwise(_resolve_equal), _ASKS), "repeats-resolved")
    asked = resolved.where("n IS NOT NULL").groupBy("doc", "text").agg(F.collect_list(F.struct("name", "wide", "start", "end")).alias("asked"))
    joined = rows.join(asked, (F.coalesce("doc_id", F.lit(LEAST)) == F.col("doc")) & (F.col("key") == F.col("text"))).select("doc_id", "key", "raw", "asked")
    pieces = joined.mapInArrow(_fetch(buckets), _MIXED)
    merged = deal(pieces).mapInArrow(_bucketwise(_merge_bucket), _RANGES)
    return resolved.where("n IS NULL").select("doc", "text", "start", "end").unionByName(merged)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("raw"))
    ids = rows.groupBy("doc_id").count()
    repeated = ids.where("count > 1").limit(1).count() > 0
    rows = rows.withColumn("key", F.xxhash64("raw") if repeated else F.lit(0).cast("long"))
    spans = repeated_ranges(rows).groupBy("doc", "text").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    joined = rows.join(spans, (F.coalesce("doc_id", F.lit(LEAST)) == F.col("doc")) & (F.col("key") == F.col("text")), "left")
    return joined.select("doc_id", "raw", "spans").mapInArrow(_cut_out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
