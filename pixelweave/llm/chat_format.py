"""Chat formatting with collapse of cumulative snapshots.

A log that writes a conversation anew after every turn holds many conversations which
are prefixes of longer ones.  Every turn is hashed with its place, a running exclusive
or over a conversation's turns gives the hash of each prefix (two independent 64-bit
hashes, so 128 bits), and an anti-join against the strict prefixes of all conversations
leaves the maximal ones.  Of equal conversations the one with the smallest id stays.
Only those are rendered.

Everything is DataFrame expressions.  Defined results: rows without a conversation id
belong to none and are left out; null roles and texts count as empty; a null turn sorts
first; turns that tie are ordered by role and text; repeated rows are repeated turns;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Marks around a turn in the rendered text.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def _turns(conversations: DataFrame) -> DataFrame:
    rows = conversations.where("conv_id IS NOT NULL")
    return rows.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")])


def prefix_hashes(conversations: DataFrame) -> DataFrame:
    """``(conv_id, k, n, h1, h2)``: the hash of every prefix of ``k`` of ``n`` turns."""
    rows = _turns(conversations).withColumn("d", F.sha2(F.concat_ws("\x00", F.length("role").cast("string"), "role", "text"), 256)).drop("text")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "d")
    numbered = rows.select("conv_id", "turn", "role", "d", F.row_number().over(order).alias("k"))
    numbered = numbered.withColumns({"a": F.xxhash64("k", "d"), "b": F.xxhash64("d", "k", F.lit("second"))})
    upto = Window.partitionBy("conv_id").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return numbered.select("conv_id", "k", F.count(F.lit(1)).over(Window.partitionBy("conv_id")).alias("n"), F.bit_xor("a").over(upto).alias("h1"), F.bit_xor("b").over(upto).alias("h2"))


def maximal(conversations: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, n_copies)`` of the conversations that prefix no other."""
    prefixes = prefix_hashes(conversations)
    full = prefixes.where("k = n").groupBy(F.col("n").alias("k"), "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    strict = prefixes.where("k < n").select("k", "h1", "h2").distinct()
    return full.join(strict, ["k", "h1", "h2"], "left_anti").select("conv_id", F.col("k").cast("long").alias("n_turns"), "n_copies")


def chat_format(conversations: DataFrame) -> DataFrame:
    """``conv_id, n_turns, n_copies, rendered`` for every maximal conversation."""
    kept = maximal(conversations)
    turn = F.concat(F.lit(OPEN), F.col("role"), F.lit(MIDDLE), F.col("text"), F.lit(CLOSE))
    rows = _turns(conversations).select("conv_id", F.struct("turn", "role", F.sha2(F.concat_ws("\x00", F.length("role").cast("string"), "role", "text"), 256).alias("d"), turn.alias("s")).alias("t"))
    text = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    text = text.select("conv_id", F.array_join(F.transform("ts", lambda t: t["s"]), "").alias("rendered"))
    return kept.join(text, "conv_id").select("conv_id", "n_turns", "n_copies", "rendered")


ORACLE_SQL = """WITH t AS (SELECT conv_id, turn, coalesce(role, '') r, coalesce(text, '') x FROM conversations WHERE conv_id IS NOT NULL),
 c AS (SELECT conv_id, list({'r': r, 'x': x} ORDER BY turn NULLS FIRST, r, sha256(concat_ws(chr(0), length(r), r, x))) ts FROM t GROUP BY conv_id),
 p AS (SELECT DISTINCT ts[1:k] pre FROM (SELECT ts, unnest(range(1, len(ts))) k FROM c)),
 m AS (SELECT ts, min(conv_id) conv_id, count(*) n_copies FROM c GROUP BY ts)
 SELECT conv_id, len(ts) AS n_turns, n_copies, array_to_string([ '<|im_start|>' || z.r || chr(10) || z.x || '<|im_end|>' || chr(10) for z in ts ], '') AS rendered
 FROM m ANTI JOIN p ON m.ts = p.pre"""
