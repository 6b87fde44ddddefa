"""Intersection over union, optimal pairs, tiers, and what is built on them.

``a`` is the anatomy side and ``b`` the activity side; edges are ``(fov, la, lb, inter,
na, nb, iou)`` for pairs that share a pixel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixelweave.deploy import ship
from pixelweave.functions.scalar import TIERS
from pixelweave.operators.assignment import assign_field
from pixelweave.operators.rasters import areas
from pixelweave.scratch import discard, materialize, written

THRESHOLD = 0.3
#: A pair above 1 / (1 + 2 t), t = (sqrt(17) - 1) / 8, is in every optimum, as the
#: regions of either side are disjoint.
CERTAIN = 1.0 / (1.0 + (17.0**0.5 - 1.0) / 4.0)


def iou_edges(a: DataFrame, b: DataFrame) -> DataFrame:
    """All pairs of regions with a common pixel; pairs without one never materialise.

    Either side has one label at most on a pixel, so both go to their pixel in one
    aggregate; regions' areas are sums over the counts of label pairs that it leaves.
    """
    none = F.lit(None).cast("int")
    pa = a.select("fov", "y", "x", F.col("label").alias("la"), none.alias("lb"))
    pb = b.select("fov", "y", "x", none.alias("la"), F.col("label").alias("lb"))
    return counted_edges(overlay(pa.unionByName(pb), "la", "lb"))


def overlay(pixels: DataFrame, *sides: str) -> DataFrame:
    """Pixels of every combination of labels: ``(fov, *sides, inter, sum_y, sum_x)``.

    ``pixels`` is ``(fov, y, x, *sides)`` with any number of rows a pixel, of which the
    largest label of each side wins; null is background.
    """
    met = pixels.groupBy("fov", "y", "x").agg(*[F.max(side).alias(side) for side in sides])
    return met.groupBy("fov", *sides).agg(F.count(F.lit(1)).alias("inter"), F.sum("y").alias("sum_y"), F.sum("x").alias("sum_x"))


def counted_edges(counts: DataFrame) -> DataFrame:
    """``iou_edges`` from the counts ``(fov, la, lb, inter)`` of an overlay."""
    counts = counts.select("fov", "la", "lb", "inter")
    total = lambda side: F.sum("inter").over(Window.partitionBy("fov", side))
    out = counts.withColumns({"na": total("la"), "nb": total("lb")}).where("la IS NOT NULL AND lb IS NOT NULL")
    iou = F.col("inter").cast("double") / (F.col("na") + F.col("nb") - F.col("inter"))
    return out.select("fov", "la", "lb", "inter", "na", "nb", iou.alias("iou"))


def certain_pairs(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("iou") > CERTAIN)


def residual_edges(edges: DataFrame) -> DataFrame:
    """Edges that touch no region of a certain pair."""
    sure = certain_pairs(edges)
    return edges.join(sure.select("fov", "la"), ["fov", "la"], "left_anti").join(sure.select("fov", "lb"), ["fov", "lb"], "left_anti").select(*edges.columns)


def assigned(edges: DataFrame, most: int = 20_000) -> DataFrame:
    """Optimal pairs of weighted edges ``(fov, la, lb, iou)``, a scratch table.

    A task solves a field of view, one component after another.  A field with more than
    ``most`` edges is dealt over several tasks, whole components to each.
    """
    spark = edges.sparkSession
    ship(spark)
    # a number of our own, as few edges would else go to one task, however long they take
    dealt = edges.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "fov")
    crowded = edges.groupBy("fov").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("fov", F.ceil(F.col("n") / most).cast("int").alias("tasks"))
    if not crowded.limit(1).count():
        return dealt.groupBy("fov").applyInPandas(lambda pdf: assign_field(pdf), edges.schema)
    least = lambda df, side: df.join(df.groupBy("fov", side).agg(F.min("part").alias("low")), ["fov", side]).drop("part").withColumnRenamed("low", "part")
    part = materialize(edges.join(crowded, "fov").withColumn("part", F.col("la")), "assign-part")
    while True:
        lower = materialize(least(least(part, "lb"), "la").select(*part.columns), "assign-part")
        moved = lower.agg(F.sum(F.col("part").cast("decimal(38,0)"))).first() != part.agg(F.sum(F.col("part").cast("decimal(38,0)"))).first()
        discard(part)
        part = lower
        if not moved:
            break
    split = part.withColumn("task", F.pmod(F.xxhash64("part"), F.col("tasks"))).select(*edges.columns, "task").groupBy("fov", "task").applyInPandas(lambda pdf: assign_field(pdf.drop(columns="task")), edges.schema)
    return dealt.join(crowded.select("fov"), "fov", "left_anti").groupBy("fov").applyInPandas(lambda pdf: assign_field(pdf), edges.schema).unionByName(split)


def optimal_pairs(edges: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of the assignment with the largest total overlap, then the threshold.

    Certain pairs are fixed by a filter; the rest is solved by components.  The threshold must be positive: a pair without overlap is
    never considered.
    """
    if threshold <= 0:
        raise ValueError("the threshold must be positive")
    edges = written(edges, "edges")
    solved = assigned(materialize(residual_edges(edges).select("fov", "la", "lb", "iou"), "residual"))
    return certain_pairs(edges).select("fov", "la", "lb", "iou").unionByName(solved).where(F.col("iou") >= threshold)


def tier_records(a: DataFrame, b: DataFrame, threshold: float = THRESHOLD, iscell: DataFrame | None = None) -> DataFrame:
    """One record per region: GOLD pairs, SILVER anatomy only, BRONZE activity only.

    ``roi_id`` runs over GOLD, SILVER, BRONZE in label order.  Missing partners are -1,
    their overlap 0 and their probability -1.  Edges, pairs and records are written once
    each, as all that follows reads them several times.
    """
    return _records(iou_edges(a, b), areas(a).withColumnRenamed("label", "la"), areas(b).withColumnRenamed("label", "lb"), threshold, iscell)


def counted_records(counts: DataFrame, threshold: float = THRESHOLD, iscell: DataFrame | None = None) -> DataFrame:
    """``tier_records`` from an overlay of ``la`` and ``lb``, other sides aside."""
    middle = lambda c: F.floor(F.sum(c) / F.sum("inter")).cast("int")
    own = lambda side: counts.where(F.col(side).isNotNull()).groupBy("fov", side)
    of_a, of_b = (own(side).agg(F.sum("inter").alias("area_px"), middle("sum_y").alias("centroid_y"), middle("sum_x").alias("centroid_x")) for side in ("la", "lb"))
    return _records(counted_edges(counts.groupBy("fov", "la", "lb").agg(F.sum("inter").alias("inter"))), of_a, of_b, threshold, iscell)


def _records(edges: DataFrame, of_a: DataFrame, of_b: DataFrame, threshold: float, iscell: DataFrame | None) -> DataFrame:
    pairs = materialize(optimal_pairs(edges, threshold), "pairs")
    gold = pairs.join(of_a, ["fov", "la"]).select("fov", F.lit("GOLD").alias("tier"), F.lit(1).alias("rank"), "iou", "la", "lb", "centroid_y", "centroid_x", "area_px")
    silver = of_a.join(pairs, ["fov", "la"], "left_anti").select("fov", F.lit("SILVER").alias("tier"), F.lit(2).alias("rank"), F.lit(0.0).alias("iou"), "la", F.lit(-1).alias("lb"), "centroid_y", "centroid_x", "area_px")
    bronze = of_b.join(pairs, ["fov", "lb"], "left_anti").select("fov", F.lit("BRONZE").alias("tier"), F.lit(3).alias("rank"), F.lit(0.0).alias("iou"), F.lit(-1).alias("la"), "lb", "centroid_y", "centroid_x", "area_px")
    every = gold.unionByName(silver).unionByName(bronze)
    label = F.when(F.col("rank") == 3, F.col("lb")).otherwise(F.col("la"))
    every = every.withColumn("roi_id", F.row_number().over(Window.partitionBy("fov").orderBy("rank", label)))
    if iscell is not None:
        prob = iscell.select("fov", F.col("label").alias("lb"), F.round("prob", 4).alias("s2p_iscell_prob"))
        every = every.join(prob, ["fov", "lb"], "left")
    else:
        every = every.withColumn("s2p_iscell_prob", F.lit(None).cast("double"))
    records = every.select(
        "fov", F.col("roi_id").cast("int").alias("roi_id"), "tier", F.round("iou", 4).alias("iou_score"), F.col("la").cast("int").alias("cellpose_label"), F.col("lb").cast("int").alias("s2p_label"),
        "centroid_y", "centroid_x", "area_px", F.coalesce("s2p_iscell_prob", F.lit(-1.0)).alias("s2p_iscell_prob"),
    )
    return materialize(records, "records")


def consensus_mask(a: DataFrame, b: DataFrame, records: DataFrame, tiers: tuple[str, ...] = ("GOLD", "SILVER")) -> DataFrame:
    """Paint the regions of the tiers, numbered anew in record order; later wins."""
    chosen = records.where(F.col("tier").isin(*tiers))
    chosen = chosen.withColumn("fresh", F.row_number().over(Window.partitionBy("fov").orderBy("roi_id")))
    of_a = chosen.where("tier <> 'BRONZE'").select("fov", F.col("cellpose_label").alias("label"), "fresh")
    of_b = chosen.where("tier = 'BRONZE'").select("fov", F.col("s2p_label").alias("label"), "fresh")
    from_a, from_b = (pixels.join(own.hint("shuffle_hash"), ["fov", "label"]) for pixels, own in ((a, of_a), (b, of_b)))
    painted = from_a.select("fov", "y", "x", "fresh").unionByName(from_b.select("fov", "y", "x", "fresh"))
    return painted.groupBy("fov", "y", "x").agg(F.max("fresh").cast("int").alias("label"))


def gold_labels(records: DataFrame) -> DataFrame:
    """Consensus labels ``(fov, label)`` of GOLD regions with an anatomy partner."""
    return records.where((F.col("tier") == "GOLD") & (F.col("cellpose_label") > 0)).select("fov", F.col("roi_id").alias("label"))


def uncovered_gold(consensus: DataFrame, records: DataFrame, manual: DataFrame, overlap: float = 0.1) -> DataFrame:
    """GOLD regions with pixels that no manual region covers: ``(fov, label)``."""
    return uncovered(consensus.join(gold_labels(records).hint("shuffle_hash"), ["fov", "label"], "left_semi"), manual, overlap)


def uncovered(consensus: DataFrame, manual: DataFrame, overlap: float = 0.1) -> DataFrame:
    """Labels of consensus regions whose best overlap with any manual one is too small."""
    best = iou_edges(consensus, manual).groupBy("fov", F.col("la").alias("label")).agg(F.max("iou").alias("best"))
    return consensus.select("fov", "label").distinct().join(best, ["fov", "label"], "left").where(F.coalesce("best", F.lit(0.0)) < overlap).select("fov", "label")


def merge_masks(manual: DataFrame, extra: DataFrame) -> DataFrame:
    """Manual raster plus the extra regions that touch none of it, under next labels.

    The extra regions come from one raster and so are disjoint; a region is left out
    exactly if one of its pixels is labelled already.
    """
    touching = extra.join(manual.select("fov", "y", "x").hint("merge"), ["fov", "y", "x"], "left_semi").select("fov", "label").distinct()
    fresh = extra.join(touching.hint("shuffle_hash"), ["fov", "label"], "left_anti")
    top = manual.groupBy("fov").agg(F.max("label").alias("top"))
    numbers = fresh.select("fov", "label").distinct().withColumn("k", F.row_number().over(Window.partitionBy("fov").orderBy("label")))
    numbers = numbers.join(top, "fov", "left").select("fov", "label", (F.coalesce("top", F.lit(0)) + F.col("k")).cast("int").alias("next"))
    added = fresh.join(numbers.hint("shuffle_hash"), ["fov", "label"]).select("fov", "y", "x", F.col("next").alias("label"))
    return manual.select("fov", "y", "x", F.col("label").cast("int").alias("label")).unionByName(added)


def merge_totals(manual: DataFrame, merged: DataFrame) -> DataFrame:
    """Fields of view, those with additions, and regions added."""
    before = manual.groupBy("fov").agg(F.countDistinct("label").alias("n0"))
    after = merged.groupBy("fov").agg(F.countDistinct("label").alias("n1"))
    both = after.join(before, "fov", "left").withColumn("added", F.col("n1") - F.coalesce("n0", F.lit(0)))
    return both.agg(F.count(F.lit(1)).alias("n_fovs"), F.count_if(F.col("added") > 0).alias("n_changed"), F.coalesce(F.sum("added"), F.lit(0)).alias("n_added"))


def match_masks(a: DataFrame, b: DataFrame, threshold: float = THRESHOLD, tiers: tuple[str, ...] = ("GOLD", "SILVER"), iscell: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Consensus mask of the wanted tiers, that of all tiers, and the records.

    Frames of different size are matched on the pixels that they share.
    """
    records = tier_records(a, b, threshold, iscell)
    return consensus_mask(a, b, records, tuple(t.upper() for t in tiers)), consensus_mask(a, b, records, TIERS), records


def tier_pixels(mask: DataFrame, records: DataFrame) -> DataFrame:
    """The pixels of a mask over all tiers with the tier of their region."""
    return mask.join(records.select("fov", F.col("roi_id").alias("label"), "tier").hint("shuffle_hash"), ["fov", "label"]).select("fov", "y", "x", "label", "tier")


def precision(predicted: DataFrame, truth: DataFrame, thresholds: tuple[float, ...] = (0.6, 0.75, 0.9)) -> DataFrame:
    """Average precision TP / (TP + FP + FN) per field of view and threshold.

    Above one half a region has at most one partner, so matches are a filter.  At or
    below, pairs over the threshold are assigned to have the most matches.
    """
    sides = predicted.groupBy("fov").agg(F.countDistinct("label").alias("np")).join(truth.groupBy("fov").agg(F.countDistinct("label").alias("nt")), "fov", "full")
    return _precision(iou_edges(predicted, truth), sides, thresholds)


def counted_precision(counts: DataFrame, thresholds: tuple[float, ...] = (0.6, 0.75, 0.9)) -> DataFrame:
    """``precision`` from the counts ``(fov, la, lb, inter)`` of prediction and truth."""
    sides = counts.groupBy("fov").agg(F.countDistinct("la").alias("np"), F.countDistinct("lb").alias("nt"))
    return _precision(counted_edges(counts), sides, thresholds)


def _precision(edges: DataFrame, sides: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    upper, lower = ([t for t in thresholds if (t > 0.5) == over] for over in (True, False))
    if lower:
        edges = materialize(edges, "precision-edges")
    hits = edges.groupBy("fov").agg(*[F.count_if(F.col("iou") >= t).alias(f"tp{k}") for k, t in enumerate(upper)]) if upper else edges.select("fov").distinct()
    for k, t in enumerate(lower, len(upper)):
        weighted = edges.where(F.col("iou") >= t).select("fov", "la", "lb", (1.0 + F.col("iou") * 1e-6).alias("iou"))
        hits = hits.join(assigned(materialize(weighted, "precision-over")).groupBy("fov").agg(F.count(F.lit(1)).alias(f"tp{k}")), "fov", "left")
    counts = F.inline(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.coalesce(f"tp{k}", F.lit(0)).cast("long").alias("tp")) for k, t in enumerate(upper + lower)]))
    rows = sides.join(hits, "fov", "left").select("fov", F.coalesce("np", F.lit(0)).alias("np"), F.coalesce("nt", F.lit(0)).alias("nt"), counts)
    ap = F.round(F.col("tp") / F.greatest(F.col("np") + F.col("nt") - F.col("tp"), F.lit(1)), 4)
    return rows.select("fov", "threshold", "tp", "np", "nt", ap.alias("ap"))


def mean_precision(per_field: DataFrame) -> DataFrame:
    return per_field.groupBy("threshold").agg(F.round(F.avg("ap"), 4).alias("mean_ap"), F.count("ap").alias("n_fovs"))
