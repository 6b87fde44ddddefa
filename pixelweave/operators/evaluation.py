"""Evaluation variants, corrections, projections and decay times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixelweave.operators.matching import counted_precision, overlay
from pixelweave.scratch import materialize, written

VARIANTS = ("cellpose_only", "gold_only", "consensus", "all_tiers")


def gold_only(consensus: DataFrame, records: DataFrame) -> DataFrame:
    """GOLD regions of a consensus mask, numbered anew in the order of the records."""
    gold = records.where("tier = 'GOLD'").select("fov", F.col("roi_id").alias("label"), F.row_number().over(Window.partitionBy("fov").orderBy("roi_id")).alias("fresh"))
    return consensus.join(gold.hint("shuffle_hash"), ["fov", "label"]).select("fov", "y", "x", F.col("fresh").alias("label"))


def variants(consensus: DataFrame, all_tiers: DataFrame | None, records: DataFrame, detector: DataFrame | None) -> DataFrame:
    """Masks ``(variant, fov, y, x, label)`` to compare with the truth."""
    found = {"cellpose_only": detector, "gold_only": gold_only(consensus, records), "consensus": consensus, "all_tiers": all_tiers}
    out = None
    for name, mask in found.items():
        if mask is not None:
            rows = mask.select(F.lit(name).alias("variant"), "fov", "y", "x", F.col("label").cast("int").alias("label"))
            out = rows if out is None else out.unionByName(rows)
    return out


def variant_precision(masks: DataFrame, present: DataFrame, truth: DataFrame, thresholds: tuple[float, ...] = (0.5, 0.75)) -> DataFrame:
    """``(variant, fov, threshold, ap)`` for every field with truth.

    ``present`` is ``(variant, fov, same_shape)``: a variant that a field lacks gets -1, one
    of another shape no row.
    """
    names = F.explode(F.array(*map(F.lit, VARIANTS))).alias("variant")
    none = F.lit(None).cast("int")
    key = lambda: F.struct("variant", "fov").alias("fov")
    both = masks.select(key(), "y", "x", F.col("label").alias("la"), none.alias("lb")).unionByName(truth.select("fov", "y", "x", "label", names).select(key(), "y", "x", none.alias("la"), F.col("label").alias("lb")))
    return counted_variants(overlay(both, "la", "lb").select("fov.variant", "fov.fov", "la", "lb", "inter"), present, thresholds)


def variant_counts(counts: DataFrame, records: DataFrame) -> DataFrame:
    """Counts ``(variant, fov, la, lb, inter)`` of every variant's labels with the truth's.

    ``counts`` is the overlay of detector ``la``, second pass ``lb`` and truth ``lt`` that
    the records were made from: a variant gives new numbers to labels, so its pixels need
    not be made.  The larger number wins where both passes have a region, as in painting.
    """
    by_id = Window.partitionBy("fov").orderBy("roi_id")
    numbered = records.withColumn("whole", F.row_number().over(by_id))
    first = records.where("tier IN ('GOLD', 'SILVER')").select("fov", "roi_id", F.row_number().over(by_id).alias("consensus"))
    gold = records.where("tier = 'GOLD'").select("fov", F.col("roi_id").alias("consensus"), F.row_number().over(by_id).alias("gold"))
    of_a = numbered.where("tier <> 'BRONZE'").join(first, ["fov", "roi_id"], "left").join(gold, ["fov", "consensus"], "left")
    of_a = of_a.select("fov", F.col("cellpose_label").alias("la"), "consensus", "gold", F.col("whole").alias("of_a"))
    of_b = numbered.where("tier = 'BRONZE'").select("fov", F.col("s2p_label").alias("lb"), F.col("whole").alias("of_b"))
    met = counts.join(of_a.hint("shuffle_hash"), ["fov", "la"], "left").join(of_b.hint("shuffle_hash"), ["fov", "lb"], "left")
    labels = {"cellpose_only": F.col("la"), "gold_only": F.col("gold"), "consensus": F.col("consensus"), "all_tiers": F.greatest("of_a", "of_b")}
    each = F.inline(F.array(*[F.struct(F.lit(name).alias("variant"), label.cast("int").alias("la")) for name, label in labels.items()]))
    rows = met.select("fov", F.col("lt").alias("lb"), "inter", each).where("la IS NOT NULL OR lb IS NOT NULL")
    return rows.groupBy("variant", "fov", "la", "lb").agg(F.sum("inter").alias("inter"))


def counted_variants(counts: DataFrame, present: DataFrame, thresholds: tuple[float, ...] = (0.5, 0.75)) -> DataFrame:
    """``variant_precision`` from the counts of ``variant_counts``, written once, as what
    follows reads them several times."""
    key = lambda v, f: F.concat_ws("\x1f", v, f.cast("string"))
    counts = written(counts, "variant-counts")
    fields = materialize(counts.where("lb IS NOT NULL").select("fov").distinct(), "fields")
    wanted = materialize(present.join(fields, "fov", "left_semi"), "present")
    own = wanted.where("same_shape").select("variant", "fov")
    compared = counts.join(F.broadcast(own), ["variant", "fov"], "left_semi").select(key(F.col("variant"), F.col("fov")).alias("fov"), "la", "lb", "inter")
    scores = counted_precision(compared, thresholds).select(F.col("fov").alias("k"), "threshold", "ap")
    every = own.withColumn("k", key(F.col("variant"), F.col("fov"))).join(scores, "k").select("variant", "fov", "threshold", "ap")
    names = F.explode(F.array(*map(F.lit, VARIANTS))).alias("variant")
    missing = fields.select("fov", names).join(wanted, ["variant", "fov"], "left_anti")
    absent = missing.select("variant", "fov", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"), F.lit(-1.0).alias("ap"))
    return every.unionByName(absent)


def variant_means(scores: DataFrame) -> DataFrame:
    """Mean precision by variant and threshold over the fields that have the variant."""
    return scores.groupBy("variant", "threshold").agg(F.round(F.avg(F.when(F.col("ap") >= 0, F.col("ap"))), 4).alias("mean_ap"), F.count_if(F.col("ap") >= 0).alias("n_fovs"))


def correct_masks(masks: DataFrame, corrections: DataFrame) -> DataFrame:
    """Masks in which every corrected field is replaced by its latest correction.

    ``corrections`` is ``(name, landed, y, x, label)``; the field is the name without
    ``_mean_seg`` or ``_seg``; a correction without labelled pixels counts for nothing.
    """
    fov = F.replace(F.replace(F.col("name"), F.lit("_mean_seg"), F.lit("")), F.lit("_seg"), F.lit(""))
    rows = corrections.where("label > 0").withColumn("fov", fov)
    last = rows.groupBy("fov").agg(F.max(F.struct("landed", "name")).alias("last"))
    fresh = rows.join(last, "fov").where((F.col("landed") == F.col("last.landed")) & (F.col("name") == F.col("last.name"))).select("fov", "y", "x", "label")
    return masks.join(last, "fov", "left_anti").select("fov", "y", "x", "label").unionByName(fresh)


def projection_files(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mean and correlation images ``(fov, kind, h, w, data)`` with the name of their file,
    and the number of fields that have one at least."""
    own = images.where(F.col("kind").isin("mean", "vcorr") & F.col("data").isNotNull())
    return own.select("fov", "kind", F.concat_ws("_", "fov", "kind").alias("name"), "h", "w", "data"), own.agg(F.countDistinct("fov").alias("n_fovs"))


def correlation_files(images: DataFrame) -> DataFrame:
    """Correlation images with the name of their file and their range."""
    own = images.where((F.col("kind") == "vcorr") & F.col("data").isNotNull())
    return own.select("fov", F.concat("fov", F.lit("_mc_vcorr")).alias("name"), "h", "w", "data", F.array_min("data").alias("v_min"), F.array_max("data").alias("v_max"))


def decay_times(traces: DataFrame, rate: float, lags: int = 10, neuropil: float = 0.7) -> DataFrame:
    """``(fov, label, tau)``: seconds in which a trace's autocorrelation falls to 1/e.

    ``traces`` is ``(fov, label, t, f, fneu)``.  The corrected trace, less its mean, is
    correlated with itself at each lag; a line through the origin is fitted to the log of
    the correlations before the first that is not positive.  Without such correlations,
    or where they do not fall, ``tau`` is null.
    """
    own = Window.partitionBy("fov", "label")
    rows = traces.select("fov", "label", "t", (F.col("f") - neuropil * F.col("fneu")).alias("v")).withColumn("v", F.col("v") - F.avg("v").over(own))
    later = [F.lead("v", k).over(own.orderBy("t")) for k in range(1, lags + 1)]
    wide = rows.select("fov", "label", "v", *[c.alias(f"v{k}") for k, c in enumerate(later, 1)])
    sums = wide.groupBy("fov", "label").agg(F.sum(F.col("v") * F.col("v")).alias("power"), *[F.sum(F.col("v") * F.col(f"v{k}")).alias(f"c{k}") for k in range(1, lags + 1)])
    return sums.select("fov", "label", _decay([F.col(f"c{k}") / F.col("power") for k in range(1, lags + 1)], rate).alias("tau"))


def _decay(correlations: list[Column], rate: float) -> Column:
    """Least squares of log c(k) = -k / (rate * tau) over the leading positive ones."""
    going, top, bottom = F.lit(True), F.lit(0.0), F.lit(0.0)
    for k, c in enumerate(correlations, 1):
        going = going & F.coalesce(c > 0, F.lit(False))
        top = top + F.when(going, k * F.log(c)).otherwise(0.0)
        bottom = bottom + F.when(going, F.lit(float(k * k))).otherwise(0.0)
    return F.when((bottom > 0) & (top < 0), -bottom / (top * rate))


def decay_map(taus: DataFrame, mask: DataFrame, slow: float = 1.5) -> DataFrame:
    """Every pixel of a region with its decay time and whether it is slow."""
    return mask.join(taus.where("tau IS NOT NULL"), ["fov", "label"]).select("fov", "y", "x", "label", "tau", (F.col("tau") > slow).alias("is_slow"))
