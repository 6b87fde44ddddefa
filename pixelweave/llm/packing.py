"""Sum-of-squares packing of tokenised documents into sequences.

A document longer than a sequence is cut into full pieces and a rest; nothing else is
cut.  Pieces are dealt over shards of bounded size.  In a shard each piece goes where
the sum over residual gaps of the squared number of open sequences with that gap
becomes smallest, a new sequence being one of the choices.  Sequences which a shard
leaves far from full are dissolved and packed again among those of other shards, in
fewer and fewer shards of the same bounded size, until one shard is left, nothing moves
or the turns are over; the sequences of the last turn stay as they are.  Pieces are dealt
by their place in the written table of pieces, so ids that are null or repeat do not
gather in one shard, and a sequence is numbered by turn, shard and place in the shard, so
no two share a number.

Defined results: null text is an empty document, which is the terminator alone;
repeated rows are packed each; a null id is passed through; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweave.deploy import ship
from pixelweave.llm import tokenizer_files as tf
from pixelweave.llm.common import materialize
from pixelweave.llm.dictionary import parts_by_bytes

CAPACITY = 4096
TERMINATOR = 1
#: Pieces in a shard, on average.
SHARD = 20_000
#: Times that pieces are dealt over shards.
TURNS = 12
#: Bytes of text encoded at once.
PART_BYTES = 4 << 20
#: Distinct runs of characters whose ids a worker remembers before it starts afresh.
REMEMBERED = 600_000
#: Bits of a sequence's number for its place in the shard and for the shard.
BIN_BITS, SHARD_BITS = 24, 34


class WordIds:
    """Ids of whole texts; each distinct word is encoded once while it is remembered.

    The word split never looks across white space, so a text's ids are those of its
    white-space-separated runs, one after another.
    """

    def __init__(self, path: str):
        self.tok = tf.load(path)
        self.runs = _Runs(self.tok.model)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a batch of texts, and where each text's ids start and end."""
        if len(self.runs) > REMEMBERED:
            self.runs.clear()
        whole = {i: t for i, t in enumerate(texts.to_pylist()) if t and ("<|" in t or tf.UNUSUAL.search(t))}
        if whole:
            odd = np.zeros(len(texts), bool)
            odd[list(whole)] = True
            texts = pc.if_else(pa.array(odd), "", texts)
        runs = pc.utf8_split_whitespace(pc.utf8_lower(texts.cast(pa.large_string()).fill_null("")))
        coded = pc.dictionary_encode(runs.flatten())
        known = [self.runs[r] for r in coded.dictionary.to_pylist()]
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        flat, first = np.frombuffer(b"".join(known), "<u4"), np.cumsum(size) - size
        which = coded.indices.to_numpy()
        n = size[which]
        stops = np.cumsum(n)
        ids = flat[np.arange(n.sum()) + np.repeat(first[which] - (stops - n), n)]
        edges = np.concatenate([[0], stops])[runs.offsets.to_numpy() - runs.offsets[0].as_py()]
        if whole:
            parts = [ids[a:b] for a, b in zip(edges[:-1], edges[1:])]
            for i, t in whole.items():
                parts[i] = np.array(self.tok.encode(t, add_special_tokens=False).ids, "<u4")
            ids, edges = np.concatenate(parts), np.cumsum([0, *map(len, parts)])
        return ids, edges


class _Runs(dict):
    """Ids by run of characters other than white space."""

    def __init__(self, model):
        super().__init__()
        self.model = model

    def __missing__(self, run: str) -> bytes:
        if not run:
            return b""
        if run.isalpha() or len(run) == 1:
            mapped = run if run.isascii() else "".join(map(tf.BYTE_ALPHABET.__getitem__, run.encode()))
            out = array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()
        elif run[-1] in ".,!" and run[:-1].isalpha():
            out = self[run[:-1]] + self[run[-1]]
        else:
            words = tf.WORD_LEVEL.findall(run)
            if len(words) == 1 and words[0] == run:
                mapped = "".join(map(tf.BYTE_ALPHABET.__getitem__, run.encode()))
                out = array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()
            else:
                out = b"".join([self[w] for w in words])
        self[run] = out
        return out


def _cut(path: str, capacity: int):
    end = TERMINATOR.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds(path)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in parts_by_bytes(batch, 1, PART_BYTES):
                flat, edges = ids.encode(part.column(1))
                out: list[list] = [[], [], [], [], []]
                for doc, a, b in zip(part.column(0).to_pylist(), edges[:-1].tolist(), edges[1:].tolist()):
                    raw = flat[a:b].tobytes() + end
                    for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                        own = raw[at : at + 4 * capacity]
                        for column, v in zip(out, (doc, k, at // 4, len(own) // 4, zlib.crc32(own))):
                            column.append(v)
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                rows = np.arange(row, row + len(out[0]))
                row += len(rows)
                yield pa.RecordBatch.from_arrays([*(pa.array(v, t) for v, t in zip(out, types)), pa.array(rows)], names=["doc_id", "piece", "start", "length", "ids_crc32", "row"])

    return run


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece, placed in the order given."""
    gaps = np.zeros(capacity + 1, np.int64)
    open_at: dict[int, list[int]] = {}
    used = 0
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    never = np.iinfo(np.int64).max
    for i, s in enumerate(lengths.tolist()):
        here = gaps[s:capacity]
        cost = np.where(here > 0, 2 * (gaps[: capacity - s] - here) + 2, never)
        if len(cost) and here[0]:
            cost[0] -= 1
        best = int(cost.argmin()) if len(cost) else 0
        fresh = 0 if s == capacity else 2 * gaps[capacity - s] + 1
        if len(cost) and cost[best] <= fresh:
            g = best + s
            k = open_at[g].pop()
            gaps[g] -= 1
        else:
            g, k = capacity, used
            used += 1
        where[i], offset[i] = k, capacity - g
        if g > s:
            gaps[g - s] += 1
            open_at.setdefault(g - s, []).append(k)
    return where, offset


def _pack_shard(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "row"], ascending=[False, True], kind="stable")
        where, offset = sum_of_squares(pdf["length"].to_numpy(), capacity)
        fill = np.bincount(where, weights=pdf["length"], minlength=1).astype(np.int64)
        return pdf.assign(bin=where, offset=offset, fill=fill[where])

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY, shard: int = SHARD, slack: int = 64) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` per piece.

    Sequences with more than ``slack`` tokens free are packed again across shards.
    """
    if shard > 1 << (BIN_BITS - 2):
        raise ValueError("a shard must leave room for the numbers of its sequences")
    ship(docs.sparkSession)
    path = vocabulary or tf.vocabulary_path("word_bpe_49k.json")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = materialize(rows.mapInArrow(_cut(path, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long, row long"), "packing-pieces")
    columns = pieces.columns
    schema = ", ".join(f"{n} {t}" for n, t in pieces.dtypes) + ", shard long, bin long, offset long, fill long"
    left, n, done, before = pieces, pieces.count(), [], None
    for turn in range(TURNS):
        shards = max(1, -(-n // shard))
        dealt = left.withColumn("shard", F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(shards)))
        packed = materialize(dealt.groupBy("shard").applyInPandas(_pack_shard(capacity), schema), f"packing-{turn}")
        final = shards == 1 or n == before or turn == TURNS - 1
        full = packed if final else packed.where(F.col("fill") >= capacity - slack)
        number = F.lit(turn << (BIN_BITS + SHARD_BITS)) + F.shiftleft("shard", BIN_BITS) + F.col("bin")
        done.append(full.select(*columns, number.alias("sequence_id"), "offset"))
        if final:
            break
        left, before = packed.where(F.col("fill") < capacity - slack).select(*columns), n
        n = left.count()
    out = done[0]
    for df in done[1:]:
        out = out.union(df)
    return out.drop("row")
