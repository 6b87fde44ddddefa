"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that its predecessor
kept; its result is written as Parquet and read again as the next stage's ``docs``.  All
but the last return the columns of ``documents``.

Quality rules carry each row beside its statistics, so their verdicts need no join.  Other
decisions on documents are carried by a key of the row, not by its id alone, so rows
without an id or with one that other texts bear too are judged each by what they hold.
They are written as small tables of keys first, so that the optimizer knows their size: it
broadcasts them while they are small and shuffles texts only when they are not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.llm.common import materialize
from pixelweave.llm.mixing import sample
from pixelweave.llm.packing import pack
from pixelweave.llm.quality import quality_verdicts
from pixelweave.llm.secret_scan import redact
from pixelweave.llm.simhash import simhash_groups


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """``docs`` with a hash of these columns, nulls told apart, as ``_key``."""
    return docs.withColumn("_key", F.xxhash64(*columns, *[F.col(c).isNull() for c in columns]))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base limits or are far outliers go."""
    rows = docs.select("doc_id", "text", "lang", "source", F.struct(*docs.columns).alias("_row"))
    return quality_verdicts(rows, carry=("_row",)).where("kept").select("_row.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies one row with the smallest id stays."""
    rows = keyed(docs, "doc_id", "text")
    groups = simhash_groups(rows, id_col="_key").select(F.col("doc_id").alias("_key"), "component_id").distinct()
    named = materialize(groups.join(rows.select("_key", "doc_id").distinct(), "_key"), "near-named")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_key"))["_key"].alias("first")
    gone = materialize(named.join(named.groupBy("component_id").agg(first), "component_id").where("_key <> first").select("_key"), "near-gone")
    rest = rows.join(gone, "_key", "left_anti")
    repeated = materialize(rows.groupBy("_key").count().where("count > 1").select("_key"), "near-repeated")
    if not repeated.limit(1).count():
        return rest.select(*docs.columns)
    single = rest.join(repeated, "_key", "left_anti")
    return single.unionByName(rest.join(repeated, "_key", "left_semi").dropDuplicates(["_key"])).select(*docs.columns)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; ``n_chars`` follows where the text changed."""
    clean = redact(docs.withColumn("_before", F.length("text")))
    return clean.withColumn("n_chars", F.when(F.length("text") == F.col("_before"), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled by the probabilities of their source, language and topic."""
    return sample(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences."""
    return pack(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("secrets", secret_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Fingerprints, components and token ids are beyond SQL; tests hold the result against
#: a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
