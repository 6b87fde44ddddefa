"""Token counts without token ids.

Texts are split into pre-tokens; each distinct pre-token of the corpus is encoded once
and its number of pieces joined back to the per-document pre-token frequencies, whose
weighted sum is the document's token count.  The vocabulary's special string counts as
one token wherever it stands in a text, which is the library's default.

Defined results: null text counts as empty (0 bytes, 0 tokens); repeated rows give
repeated rows; a null id is passed through; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweave.deploy import ship
from pixelweave.llm import tokenizer_files as tf
from pixelweave.llm.common import shuffle_partitions
from pixelweave.llm.dictionary import encode, per_document, segment_sums, token_rows

SPECIAL = "<|endoftext|>"
#: Characters from which on the pre-tokens of a text are not listed at once.
LONG = 1 << 20


def pre_tokens(text: str, path: str) -> Iterable[str]:
    """Pre-tokens of a piece of text without special strings, as substrings; those of a
    long text one at a time."""
    if text.isascii() or not tf.EXOTIC.search(text):
        pattern = tf.BYTE_LEVEL_ASCII if text.isascii() else tf.BYTE_LEVEL
        return pattern.findall(text) if len(text) < LONG else (m.group() for m in pattern.finditer(text))
    return [text[a:b] for _, (a, b) in tf.load(path).pre_tokenizer.pre_tokenize_str(text)]


def _split(path: str):
    def split(text: str) -> tuple[Iterable[str], list[int]]:
        parts = text.split(SPECIAL)
        tokens = pre_tokens(text, path) if len(parts) == 1 else chain.from_iterable(pre_tokens(p, path) for p in parts)
        return tokens, [len(text.encode("utf-8", "surrogatepass")), len(parts) - 1]

    return split


def _count_pieces(path: str):
    """Over rows sorted by token: pieces of each distinct token, encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tf.load(path)
        last, last_n = None, 0
        for batch in batches:
            coded = batch.column(2).dictionary_encode()
            words = coded.dictionary.to_pylist()
            fresh = [w for w in words if w != last]
            size = dict(zip(fresh, (len(e.ids) for e in tok.encode_batch_fast(fresh, add_special_tokens=False))))
            if last is not None:
                size.setdefault(last, last_n)
            n = np.array([size[w] for w in words], np.int64)[coded.indices.to_numpy()]
            last = batch.column(2)[-1].as_py()
            last_n = size[last]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n)], names=["chunk", "pos", "value"])

    return run


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, limit: int = 512, chunk_bytes: int = 32 << 20) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs``."""
    ship(docs.sparkSession)
    path = vocabulary or tf.vocabulary_path("byte_bpe_50k.json")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    chunks = encode(rows, _split(path), None, chunk_bytes, "token-dictionary")
    tokens = token_rows(chunks).select("chunk", "pos", "token").repartition(shuffle_partitions(docs.sparkSession), "token").sortWithinPartitions("token")
    pieces = tokens.mapInArrow(_count_pieces(path), "chunk long, pos int, value long")

    def reduce(ids, stats, starts, value, counts):
        n_bytes, special = stats[0::2], stats[1::2]
        n = segment_sums(value * counts, starts) + special
        return {"doc_id": ids, "n_bytes": n_bytes, "n_tokens": n, "over_limit": n > limit}

    return per_document(chunks, pieces, reduce, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
