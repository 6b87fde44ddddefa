"""Corpus dictionaries: each distinct token of a block of documents stored once.

A block is up to ``chunk_bytes`` of text that one task reads.  Its row holds the
distinct tokens, how often training documents use each, and for each document the
sorted numbers of its tokens with their frequencies, packed.  Work on tokens (counting
pieces, summing counts) then touches one row per block and distinct token rather than
one per document and token, and a frequent token has as many rows as there are blocks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweave.llm.common import materialize

#: Bytes of text split into words at once.
PART_BYTES = 2 << 20

SCHEMA = "chunk long, tokens array<string>, trained array<long>, doc_id array<long>, stats array<long>, entries binary"
_ARROW = pa.schema(
    [("chunk", pa.int64()), ("tokens", pa.list_(pa.string())), ("trained", pa.list_(pa.int64())), ("doc_id", pa.list_(pa.int64())), ("stats", pa.list_(pa.int64())), ("entries", pa.binary())]
)


def _pack(sizes: np.ndarray, numbers: np.ndarray, counts: np.ndarray) -> bytes:
    """Numbers are sorted within a document, so their differences are small."""
    steps = numbers.copy()
    if len(numbers):
        steps[1:] -= numbers[:-1]
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    steps[starts] = numbers[starts]
    planes = [np.asarray(x, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for x in (sizes, steps, counts)]
    return zstandard.ZstdCompressor(level=1).compress(len(sizes).to_bytes(8, "little") + len(numbers).to_bytes(8, "little") + b"".join(planes))


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    docs, n = int.from_bytes(raw[:8], "little"), int.from_bytes(raw[8:16], "little")
    at, out = 16, []
    for size in (docs, n, n):
        planes = np.frombuffer(raw, np.uint8, 4 * size, at).reshape(4, size)
        out.append(np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64))
        at += 4 * size
    sizes, steps, counts = out
    total = np.cumsum(steps)
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[sizes > 0]
    base = np.zeros(len(starts), np.int64)
    base[1:] = total[starts[1:] - 1]
    return sizes, total - np.repeat(base, sizes[sizes > 0]), counts


class _Numbers(dict):
    """Tokens numbered as they are met."""

    def __missing__(self, token: str) -> int:
        n = self[token] = len(self)
        return n


class _Block:
    """Documents of one row; a document is held as the numbers of its tokens only."""

    def __init__(self, trains: Callable[[int | None], bool] | None):
        self.trains, self.number = trains, _Numbers()
        self.ids: list = []
        self.stats: list[int] = []
        self.numbers: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []

    def add(self, doc_id: int | None, tokens: Iterable[str], stats: list[int]) -> None:
        found = Counter(tokens)
        own = np.fromiter(map(self.number.__getitem__, found), np.int32, len(found))
        order = np.argsort(own)
        self.ids.append(doc_id)
        self.stats += stats
        self.sizes.append(np.array([len(found)]))
        self.numbers.append(own[order])
        self.counts.append(np.fromiter(found.values(), np.int32, len(found))[order])

    def row(self, chunk: int) -> pa.RecordBatch:
        numbers, counts = np.concatenate(self.numbers), np.concatenate(self.counts)
        return self._row(chunk, pa.array(list(self.number), pa.string()), numbers, counts)

    def _row(self, chunk: int, tokens: pa.Array, numbers: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        self.numbers = self.counts = []
        sizes = np.concatenate(self.sizes)
        use = np.repeat([self.trains is None or self.trains(i) for i in self.ids], sizes)
        trained = np.bincount(numbers[use], weights=counts[use], minlength=len(tokens)).astype(np.int64)
        row = [chunk], pa.ListArray.from_arrays([0, len(tokens)], tokens), [trained], [self.ids], [self.stats], [_pack(sizes, numbers, counts)]
        return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, f.type) for v, f in zip(row, _ARROW)], schema=_ARROW)


class _WordBlock(_Block):
    """A block whose parts number their own tokens; they are made one when it is written."""

    def __init__(self, trains: Callable[[int | None], bool] | None):
        super().__init__(trains)
        self.tokens: list[pa.Array] = []

    def row(self, chunk: int) -> pa.RecordBatch:
        coded = pc.dictionary_encode(pa.concat_arrays(self.tokens))
        number, at = coded.indices.to_numpy(), np.cumsum([0, *map(len, self.tokens)])
        numbers, counts = np.concatenate([number[own + lo] for own, lo in zip(self.numbers, at)]), np.concatenate(self.counts)
        doc = np.repeat(np.arange(len(self.ids)), np.concatenate(self.sizes))
        order = np.argsort(doc * max(1, len(coded.dictionary)) + numbers)
        return self._row(chunk, coded.dictionary.cast(pa.string()), numbers[order], counts[order])


def encode(docs: DataFrame, split: Callable[[str], tuple[Iterable[str], list[int]]], trains: Callable[[int | None], bool] | None, chunk_bytes: int, tag: str) -> DataFrame:
    """The dictionary table of ``docs`` (columns ``doc_id`` long and ``text`` string).

    ``split`` gives a text's tokens and a fixed number of integers kept per document;
    ``trains`` says by id which documents count as training text (None: all of them).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 24
        block, held = _Block(trains), 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py() or ""
                block.add(doc_id.as_py(), *split(text))
                held += len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))
                if held >= chunk_bytes:
                    yield block.row(chunk)
                    chunk, block, held = chunk + 1, _Block(trains), 0
        if block.ids:
            yield block.row(chunk)

    return materialize(docs.select("doc_id", "text").mapInArrow(run, SCHEMA), tag)


def encode_words(docs: DataFrame, stats: Callable[[bytes], list[int]], trains: Callable[[int | None], bool], chunk_bytes: int, tag: str) -> DataFrame:
    """The dictionary table of words between ASCII white space, A-Z lower-cased.

    The same rows as ``encode`` with such a split, made by whole-array operations.
    """

    def add(block: _WordBlock, ids: pa.Array, texts: pa.Array) -> None:
        texts = texts.cast(pa.large_string()).fill_null("")
        words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        coded = pc.dictionary_encode(words.flatten())
        tokens, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        doc = np.repeat(np.arange(len(texts)), np.diff(words.offsets.to_numpy()))
        empty = tokens.index("").as_py()  # beside white space at an end
        if empty >= 0:
            tokens = tokens.filter(pc.not_equal(tokens, ""))
            doc, code = doc[code != empty], code[code != empty]
            code -= code > empty
        size = max(1, len(tokens))
        block.tokens.append(tokens)
        keys, counts = np.unique(doc * size + code, return_counts=True)
        block.numbers.append((keys % size).astype(np.int32))
        block.counts.append(counts.astype(np.int32))
        block.sizes.append(np.bincount(keys // size, minlength=len(texts)))
        block.ids += ids.to_pylist()
        raw = texts.to_numpy(zero_copy_only=False)
        for t in raw:
            block.stats.extend(stats(t.encode("utf-8", "surrogatepass")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 24
        block, held = _WordBlock(trains), 0
        for batch in batches:
            for part in parts_by_bytes(batch, 1, PART_BYTES):
                add(block, part.column(0), part.column(1))
                held += part.column(1).nbytes
                if held >= chunk_bytes:
                    yield block.row(chunk)
                    chunk, block, held = chunk + 1, _WordBlock(trains), 0
        if block.ids:
            yield block.row(chunk)

    return materialize(docs.select("doc_id", "text").mapInArrow(run, SCHEMA), tag)


def parts_by_bytes(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of a text column, a row at least.

    Parts are copied: string kernels go wrong on a slice whose offsets do not start at 0.
    """
    size = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    upto, lo = np.cumsum(size, dtype=np.int64), 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + most, side="right")))
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([c.slice(lo, hi - lo)]) for c in batch.columns], schema=batch.schema)
        lo = hi


def token_rows(chunks: DataFrame) -> DataFrame:
    """``(chunk, pos, token, trained)``, one row per block and distinct token."""
    pairs = chunks.select("chunk", F.posexplode(F.arrays_zip("tokens", "trained")).alias("pos", "t"))
    return pairs.select("chunk", "pos", F.col("t.tokens").alias("token"), F.col("t.trained").alias("trained"))


def per_document(chunks: DataFrame, values: DataFrame, reduce: Callable, schema: str) -> DataFrame:
    """Join ``values (chunk, pos, value long)`` back and reduce to a row per document.

    ``reduce(doc_ids, stats, starts, value, counts)`` gets numpy arrays for a block:
    for document d the entries ``starts[d]:starts[d + 1]``, as each token's value and
    frequency, and returns the output columns.
    """
    gathered = values.groupBy("chunk").agg(F.collect_list(F.struct("pos", "value")).alias("found"))
    joined = chunks.select("chunk", F.size("tokens").alias("n"), "doc_id", "stats", "entries").join(gathered, "chunk", "left")
    joined = joined.select("n", "doc_id", "stats", "entries", F.col("found.pos").alias("pos"), F.col("found.value").alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                n, ids, stats, blob, pos, value = (batch.column(c)[k] for c in range(6))
                of = np.zeros(n.as_py(), np.int64)
                if pos.is_valid:
                    of[pos.values.to_numpy(zero_copy_only=False)] = value.values.to_numpy(zero_copy_only=False)
                sizes, numbers, counts = _unpack(blob.as_py())
                starts = np.concatenate([[0], np.cumsum(sizes)])
                out = reduce(ids.values, stats.values.to_numpy(zero_copy_only=False), starts, of[numbers], counts)
                yield pa.RecordBatch.from_arrays([pa.array(v) if not isinstance(v, pa.Array) else v for v in out.values()], names=list(out))

    return joined.mapInArrow(run, schema)


def segment_sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of x over consecutive segments, empty ones included."""
    total = np.concatenate([np.zeros(1, x.dtype), np.cumsum(x)])
    return total[starts[1:]] - total[starts[:-1]]
