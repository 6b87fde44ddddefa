"""From files to scored tables and rasters, for all fields of view at once.

A pass of the detector is a folder with three Parquet tables: ``footprints (fov, label,
pix)``, ``cells (fov, label, flag, prob)`` and ``frames (fov, ly, lx)``.  Mean and
correlation images are TIFF files ``<fov>_mean.tif`` or ``<fov>_mc_mean.tif``, and alike
for ``vcorr``.  Results are ``<fov>_all_s2p_masks.tif``, ``<fov>_roi_cellprob.tif`` and the
table ``scored`` by field of view, which also says what a later run may skip.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.functions.scalar import TIERS
from pixelweave.operators import matching, planning, rasters, scoring
from pixelweave.options import BatchOptions
from pixelweave.scorers import Scorer
from pixelweave.scratch import materialize
from pixelweave.sources import tables, tiff

FOOTPRINTS = "fov string, label int, pix array<struct<y:int,x:int>>"
CELLS = "fov string, label int, flag int, prob double"
FRAMES = "fov string, ly int, lx int"


@dataclasses.dataclass
class DetectorPass:
    footprints: DataFrame
    cells: DataFrame
    frames: DataFrame

    def mask(self, fields: DataFrame) -> DataFrame:
        """Label rasters of these fields (``fov, ly, lx``)."""
        pixels = rasters.explode_footprints(self.footprints).join(fields, "fov")
        return rasters.rasterize(rasters.in_bounds(pixels, F.col("ly"), F.col("lx")))


@dataclasses.dataclass
class UnionResult:
    """``scored`` rows, the union ``mask`` and, per pixel of a region, its ``probability``;
    ``status`` says of every field of the activity pass what became of it."""

    scored: DataFrame
    mask: DataFrame
    probability: DataFrame
    status: DataFrame


def read_pass(spark: SparkSession, root: str) -> DetectorPass:
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{root.rstrip('/')}/{name}")
    return DetectorPass(read("footprints", FOOTPRINTS), read("cells", CELLS), read("frames", FRAMES))


def read_images(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """Images of a kind, ``mean`` or ``vcorr``, as ``(fov, y, x, v)``; the name without
    ``_mc`` wins."""
    found = tiff.read_stacks(spark, root).where("error IS NULL AND t = 0")
    name = F.regexp_extract("path", "([^/]*)\\.[^./]*$", 1)
    named = found.withColumns({"fov": F.regexp_extract(name, f"^(.*?)(_mc)?_{kind}$", 1), "suffix": F.regexp_extract(name, f"(_mc)?_{kind}$", 0)}).where("suffix <> ''")
    return tiff.raster_pixels(planning.first_candidate(named, (f"_{kind}", f"_mc_{kind}")))


def union(activity: DetectorPass, anatomy: DetectorPass, mean: DataFrame, second: DataFrame | None, scorer: Scorer, options: BatchOptions = BatchOptions(), done: DataFrame | None = None) -> UnionResult:
    """Match, paint and score all complete fields that are not done yet.

    A field is complete with frames and regions in both passes, of equal size, and a mean
    image.  Without a correlation image its second channel is zero.
    """
    images = mean.select("fov").distinct().withColumn("kind", F.lit("mean"))
    complete = planning.complete_fields(activity.frames, anatomy.frames, images)
    pending = planning.resume_pending(complete, done) if done is not None else complete
    fields = materialize(pending, "fields")
    a, b = (materialize(p.mask(fields), "mask") for p in (anatomy, activity))
    own = mean.join(fields.select("fov"), "fov", "left_semi")
    channels = rasters.two_channels(own, second) if options.second_channel and second is not None else own.select("fov", "y", "x", F.col("v").alias("c0"), F.lit(0.0).alias("c1"))
    raster = rasters.probability(materialize(scorer(channels), "scores"))
    records = matching.tier_records(a, b, options.iou_threshold, activity.cells)
    mask = materialize(matching.consensus_mask(a, b, records, TIERS), "union")
    means = materialize(scoring.mean_probability(mask, raster), "means")
    scored = materialize(scoring.scored_records(records, means, anatomy.cells, activity.cells), "scored")
    state = F.when(F.col("ok").isNotNull(), "done").when(F.col("whole").isNotNull(), "skipped").otherwise("incomplete")
    status = activity.frames.select("fov").join(fields.select("fov", F.lit(True).alias("ok")), "fov", "left").join(complete.select("fov", F.lit(True).alias("whole")), "fov", "left")
    return UnionResult(scored, mask, scoring.probability_raster(mask, means), status.select("fov", state.alias("status")))


def run_union(spark: SparkSession, activity: str, anatomy: str, images: str, output: str, scorer: Scorer, options: BatchOptions = BatchOptions()) -> DataFrame:
    """Files to files; returns the scored rows of this run.  The table is written last, so
    a run that breaks off is taken up again by the next."""
    done = None
    if options.resume:
        try:
            done = spark.read.parquet(f"{output}/scored").select(F.col("fov").cast("string").alias("fov"))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    act, ana = read_pass(spark, activity), read_pass(spark, anatomy)
    second = read_images(spark, images, "vcorr") if options.second_channel else None
    found = union(act, ana, materialize(read_images(spark, images, "mean"), "mean"), second, scorer, options, done)
    frames = act.frames.join(found.status.where("status = 'done'"), "fov", "left_semi").select("fov", F.col("ly").alias("h"), F.col("lx").alias("w"))
    tiff.write_labels(found.mask, frames, output, "_all_s2p_masks").write.format("noop").mode("overwrite").save()
    tiff.write_rasters(found.probability.withColumnRenamed("mean_prob", "v"), frames, output, "_roi_cellprob").write.format("noop").mode("overwrite").save()
    tables.write_by_field(found.scored, f"{output}/scored")
    return found.scored


def run_match(spark: SparkSession, anatomy: DataFrame, activity: DataFrame, frames: DataFrame, output: str, tiers: tuple[str, ...] = ("GOLD", "SILVER"), threshold: float = 0.3, iscell: DataFrame | None = None) -> DataFrame:
    """Match two sets of label rasters and write both masks and the records by field."""
    default, every, records = matching.match_masks(anatomy, activity, threshold, tiers, iscell)
    for mask, suffix in ((default, "_consensus_masks"), (every, "_all_tiers_masks")):
        tiff.write_labels(mask, frames, output, suffix).write.format("noop").mode("overwrite").save()
    tables.write_by_field(records, f"{output}/consensus")
    return records
