"""Distributed connected components and size-checked joins; scratch tables by their name here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.scratch import discard, materialize, scratch_dir

__all__ = ["connected_components", "discard", "join_groups", "materialize", "scratch_dir", "shuffle_partitions"]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """Components of an undirected graph given as ``(a, b)`` long columns.

    Returns ``(node, component)`` for every node of an edge, ``component`` being the
    smallest node reachable.  Each round every node points to the neighbour (or itself)
    of least random priority and the edges are contracted along these pointers, so the
    number of live nodes falls by a constant factor whatever the shape of the graph.
    All steps are aggregates with map-side combine and equi-joins; nothing but the edge
    count of a round reaches the driver.
    """
    live = materialize(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), f"{tag}-e"
    )
    labels = None
    for turn in range(200):
        if not live.limit(1).count():
            break
        both = live.union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("v"))
        point = both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("node"), F.least(F.col("m"), rank("a"))["v"].alias("to"))
        point = materialize(point, f"{tag}-p{turn}")
        if labels is None:
            following = point.select("node", F.col("to").alias("root"))
        else:
            step = point.select(F.col("node").alias("root"), "to")
            following = labels.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        following = materialize(following, f"{tag}-l{turn}")
        pa = point.select(F.col("node").alias("a"), F.col("to").alias("ra"))
        pb = point.select(F.col("node").alias("b"), F.col("to").alias("rb"))
        fresh = (
            live.join(pa, "a").join(pb, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        )
        fresh = materialize(fresh, f"{tag}-e{turn}")
        discard(live, point, *([labels] if labels is not None else []))
        live, labels = fresh, following
    discard(live)
    if labels is None:
        return edges.sparkSession.createDataFrame([], "node long, component long")
    least = labels.groupBy("root").agg(F.min("node").alias("component"))
    return labels.join(least, "root").select("node", "component")


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], salt_by: str, limit: int = 20_000, salts: int = 16, size: int | None = None) -> DataFrame:
    """Left join of many rows to one row per group, whatever the size of a group.

    ``groups`` must be a scratch table.  It is counted first unless ``size`` tells how many
    rows it has: up to ``limit`` rows it is
    broadcast, beyond that every group row is copied ``salts`` times and the rows of a
    hot group are dealt over the copies.  Keys compare null-safe.
    """
    if (groups.count() if size is None else size) <= limit:
        right = F.broadcast(groups.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in groups.columns if c not in keys]))
        salted = []
    else:
        right = groups.select(
            *[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in groups.columns if c not in keys], F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_s")
        )
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int"))
        salted = [F.col("_salt") == F.col("_s")]
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + salted
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    return rows.join(right, condition, "left").drop(*[f"_k_{k}" for k in keys], "_s", "_salt")
