"""Scored regions: union mask, mean probability per region, tier summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelweave.functions.scalar import TIERS, half_up
from pixelweave.operators.matching import consensus_mask, tier_records


def mean_probability(mask: DataFrame, raster: DataFrame) -> DataFrame:
    """Mean over the pixels a region still holds in the mask."""
    return mask.join(raster.hint("merge"), ["fov", "y", "x"]).groupBy("fov", F.col("label").alias("roi_id")).agg(F.avg("v").alias("mean_prob"))


def probability_raster(mask: DataFrame, means: DataFrame) -> DataFrame:
    """Every surviving pixel of a region with the region's mean."""
    return mask.withColumnRenamed("label", "roi_id").join(means.hint("shuffle_hash"), ["fov", "roi_id"]).select("fov", "y", "x", "roi_id", "mean_prob")


def scored_rois(a: DataFrame, b: DataFrame, raster: DataFrame, iscell_a: DataFrame, iscell_b: DataFrame, threshold: float = 0.3) -> DataFrame:
    """One scored row per region of either pass.

    Unmatched lookups give -1 and -1.0; a region painted over entirely has mean 0.
    """
    records = tier_records(a, b, threshold)
    mask = consensus_mask(a, b, records, TIERS)
    means = mean_probability(mask, raster)
    return scored_records(records, means, iscell_a, iscell_b)


def scored_records(records: DataFrame, means: DataFrame, iscell_a: DataFrame, iscell_b: DataFrame) -> DataFrame:
    """Records with their mean probability and the classifier's flag and probabilities."""
    of_b = iscell_b.select("fov", F.col("label").alias("s2p_label"), F.col("flag").alias("activity_iscell"), F.col("prob").alias("activity_s2p_prob"))
    of_a = iscell_a.select("fov", F.col("label").alias("cellpose_label"), F.col("prob").alias("anatomy_s2p_prob"))
    out = records.join(means, ["fov", "roi_id"], "left").join(of_b, ["fov", "s2p_label"], "left").join(of_a, ["fov", "cellpose_label"], "left")
    return out.select(
        "fov", "roi_id", "tier", "iou_score", F.coalesce("activity_iscell", F.lit(-1)).alias("activity_iscell"),
        F.coalesce("activity_s2p_prob", F.lit(-1.0)).alias("activity_s2p_prob"), F.coalesce("anatomy_s2p_prob", F.lit(-1.0)).alias("anatomy_s2p_prob"),
        half_up(F.coalesce("mean_prob", F.lit(0.0)), 5).alias("cellpose_mean_prob"),
    )


def score_footprints(pixels: DataFrame, raster: DataFrame) -> DataFrame:
    """Mean over every footprint pixel, before any painting over."""
    return pixels.join(raster.hint("merge"), ["fov", "y", "x"]).groupBy("fov", F.col("label").alias("roi_id")).agg(F.round(F.avg("v"), 5).alias("cellpose_mean_prob"))


def footprint_raster(pixels: DataFrame, scores: DataFrame) -> DataFrame:
    """Per pixel the score of the last region painted there."""
    joined = pixels.withColumnRenamed("label", "roi_id").join(scores.hint("shuffle_hash"), ["fov", "roi_id"])
    return joined.groupBy("fov", "y", "x").agg(F.max_by("cellpose_mean_prob", "roi_id").alias("v"), F.max("roi_id").alias("roi_id"))


def tier_counts(scored: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("tier") == t).alias(f"n_{t.lower()}") for t in TIERS]
    return scored.groupBy("fov").agg(*counts, F.count(F.lit(1)).alias("n_rois"))


def tier_totals(scored: DataFrame) -> DataFrame:
    return scored.groupBy("tier").agg(F.count("roi_id").alias("n_rois"))


def summary(scored: DataFrame) -> DataFrame:
    return scored.agg(F.countDistinct("fov").alias("n_fovs"), F.count(F.lit(1)).alias("n_rois"), F.count_if(F.col("tier") == "GOLD").alias("n_gold"))


def viewer_filter(scored: DataFrame, tiers: tuple[str, ...] = TIERS, least: float = 0.0, column: str = "cellpose_mean_prob") -> DataFrame:
    """Selected tiers and ``NOT (probability < least)``: a missing value (NaN or null)
    passes, a missing column counts as zero."""
    prob: Column = F.coalesce(F.col(column), F.lit(float("nan"))) if column in scored.columns else F.lit(0.0)
    return scored.where(F.upper("tier").isin(*tiers) & ~(prob < least))


def shown_of_total(scored: DataFrame, least: float) -> DataFrame:
    shown = viewer_filter(scored, TIERS, least).groupBy("tier").agg(F.count(F.lit(1)).alias("n_shown"))
    return tier_totals(scored).join(shown, "tier", "left").select("tier", F.coalesce("n_shown", F.lit(0)).alias("n_shown"), F.col("n_rois").alias("n_total"))


def high_confidence(scored: DataFrame, least: float = 0.5) -> DataFrame:
    return scored.where(F.col("tier").isin("GOLD", "SILVER") & (F.col("cellpose_mean_prob") > least))


def preview(scored: DataFrame, n: int = 20) -> DataFrame:
    return scored.orderBy("fov", "roi_id").limit(n)


def iou_histogram(pairs: DataFrame, bins: int = 20) -> DataFrame:
    """Counts over equal bins of [0, 1], the last one closed, with the median."""
    which = F.least(F.floor(F.col("iou") * bins), F.lit(bins - 1)).cast("int")
    median = pairs.agg(F.percentile("iou", 0.5).alias("median_iou"))
    return pairs.groupBy(which.alias("bin")).agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(median))


def dense_scores(scored: DataFrame, n_labels: DataFrame) -> DataFrame:
    """A row per label 0..n with its probability, zero by default; ids above n ignored."""
    every = n_labels.select("fov", F.explode(F.sequence(F.lit(0), F.col("n").cast("int"))).alias("roi_id"))
    return every.join(scored.select("fov", "roi_id", "cellpose_mean_prob"), ["fov", "roi_id"], "left").select("fov", "roi_id", F.coalesce("cellpose_mean_prob", F.lit(0.0)).alias("prob"))
