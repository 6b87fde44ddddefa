"""Footprints to label rasters, aggregates over pixels and frames, polygon fill.

A label raster is ``(fov, y, x, label)`` with background rows absent.

Sizes of exploded or well packed pixels are estimated far too low, so joins name their
kind wherever the planner could take pixels for a small table and broadcast them: pixels
meet pixels by merging, regions are hashed by partition, fields (a row a frame) broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixelweave.functions import align_offset, rescaled, sigmoid


def explode_footprints(footprints: DataFrame) -> DataFrame:
    """``(…, label, pix array<struct<y, x>>)`` to a row per pixel; labels start at one."""
    rest = [c for c in footprints.columns if c != "pix"]
    return footprints.select(*rest, F.inline("pix"))


def in_bounds(pixels: DataFrame, height: Column, width: Column) -> DataFrame:
    return pixels.where((F.col("y") >= 0) & (F.col("y") < height) & (F.col("x") >= 0) & (F.col("x") < width))


def rasterize(pixels: DataFrame, keys: tuple[str, ...] = ("fov",)) -> DataFrame:
    """Paint regions in ascending label order: at each pixel the last one wins."""
    return pixels.groupBy(*keys, "y", "x").agg(F.max("label").alias("label"))


def rasterize_filtered(pixels: DataFrame, iscell: DataFrame, min_prob: float = 0.5) -> DataFrame:
    """Regions flagged as cells with enough probability, numbered anew from one, painted.

    ``iscell`` is ``(fov, label, flag, prob)``, one row per region.  ``n_kept`` counts
    the regions kept, painted over or not.
    """
    kept = iscell.where((F.col("flag") >= 1) & (F.col("prob") >= min_prob))
    kept = kept.select("fov", "label", F.row_number().over(Window.partitionBy("fov").orderBy("label")).alias("fresh"), F.count(F.lit(1)).over(Window.partitionBy("fov")).alias("n_kept"))
    joined = pixels.join(kept, ["fov", "label"])
    return joined.groupBy("fov", "y", "x").agg(F.max("fresh").alias("label"), F.max("n_kept").alias("n_kept"))


def align_center(pixels: DataFrame, have: tuple[Column, Column], want: tuple[Column, Column]) -> DataFrame:
    """Crop or pad about the centre: new coordinates, rows outside dropped."""
    moved = pixels.withColumns({"y": F.col("y") + align_offset(have[0], want[0]), "x": F.col("x") + align_offset(have[1], want[1])})
    return in_bounds(moved, want[0], want[1])


def areas(pixels: DataFrame, keys: tuple[str, ...] = ("fov", "label")) -> DataFrame:
    """Pixel count and truncated mean position of every region."""
    return pixels.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("area_px"), F.floor(F.avg("y")).cast("int").alias("centroid_y"), F.floor(F.avg("x")).cast("int").alias("centroid_x")
    )


def label_summary(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("fov").agg(F.countDistinct("label").alias("n_labels"), F.max("label").alias("max_label"))


def probability(raster: DataFrame) -> DataFrame:
    """Logits to probabilities, all pixels of a field of view or none: those of a field
    with any value outside [0, 1] go through the logistic function."""
    ends = raster.groupBy("fov").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    joined = raster.join(F.broadcast(ends), "fov")
    return joined.select("fov", "y", "x", F.when((F.col("low") < 0) | (F.col("high") > 1), sigmoid(F.col("v"))).otherwise(F.col("v")).alias("v"))


def raster_range(raster: DataFrame, above: float = 0.5) -> DataFrame:
    return raster.groupBy("fov").agg(F.min("v").alias("v_min"), F.max("v").alias("v_max"), F.count_if(F.col("v") > above).alias("n_above"))


def two_channels(mean: DataFrame, vcorr: DataFrame, require_both: bool = False) -> DataFrame:
    """Two rasters side by side; where the second is missing it is zero, or for training
    (``require_both``) the field of view is left out."""
    second = vcorr.select("fov", "y", "x", F.col("v").alias("c1"))
    if require_both:
        mean = mean.join(second.select("fov").distinct(), "fov", "left_semi")
    return mean.select("fov", "y", "x", F.col("v").alias("c0")).join(second.hint("merge"), ["fov", "y", "x"], "left").withColumn("c1", F.coalesce("c1", F.lit(0.0)))


def frame_values(frames: DataFrame, width: Column) -> DataFrame:
    """``(fov, t, data array)`` to a row per frame and pixel."""
    values = frames.select("fov", "t", F.posexplode("data").alias("pos", "v"))
    return values.select("fov", "t", F.floor(F.col("pos") / width).cast("int").alias("y"), (F.col("pos") % width).cast("int").alias("x"), F.col("v").cast("double").alias("v"))


def projections(values: DataFrame) -> DataFrame:
    """Mean and maximum over time of every pixel."""
    return values.groupBy("fov", "y", "x").agg(F.avg("v").alias("mean_v"), F.max("v").alias("max_v"))


def traces(values: DataFrame, mask: DataFrame) -> DataFrame:
    """Mean value of each region's pixels in every frame."""
    return values.join(mask, ["fov", "y", "x"]).groupBy("fov", "t", "label").agg(F.avg("v").alias("mean_f"))


def stretch(raster: DataFrame, low: float, high: float, rule: str) -> DataFrame:
    """Percentile stretch of every field of view; exact percentiles, interpolated."""
    ends = raster.groupBy("fov").agg(F.percentile("v", F.array(F.lit(low), F.lit(high))).alias("p"))
    joined = raster.join(ends, "fov")
    return joined.select("fov", "y", "x", rescaled(F.col("v"), F.col("p")[0], F.col("p")[1], rule).alias("v"))


def fill_polygons(vertices: DataFrame, height: int, width: int) -> DataFrame:
    """``(fov, roi, seq, y, x)`` polygons to a label raster; ``roi`` is the label.

    Even-odd rule on pixel centres; a centre on a left or upper edge is inside, on a
    right or lower edge outside.  Fewer than three vertices paint nothing; a later
    polygon paints over an earlier one.
    """
    ring = Window.partitionBy("fov", "roi").orderBy("seq")
    every = Window.partitionBy("fov", "roi")
    edges = vertices.withColumns({"n": F.count(F.lit(1)).over(every), "y2": F.lead("y").over(ring), "x2": F.lead("x").over(ring)})
    edges = edges.withColumns({"y2": F.coalesce("y2", F.first("y").over(ring)), "x2": F.coalesce("x2", F.first("x").over(ring))}).where("n >= 3")
    rows = edges.withColumn("py", F.explode(F.sequence(F.greatest(F.ceil(F.least("y", "y2")), F.lit(0)).cast("int"), F.least(F.ceil(F.greatest("y", "y2")), F.lit(height)).cast("int"))))
    rows = rows.where((F.col("py") < height) & ((F.col("y") <= F.col("py")) != (F.col("y2") <= F.col("py"))))
    rows = rows.withColumn("cross", F.col("x") + (F.col("py") - F.col("y")) * (F.col("x2") - F.col("x")) / (F.col("y2") - F.col("y")))
    line = rows.groupBy("fov", "roi", "py").agg(F.sort_array(F.collect_list("cross")).alias("at"))
    spans = line.select("fov", "roi", "py", F.explode(F.sequence(F.lit(0), F.size("at") - 2, F.lit(2))).alias("k"), "at")
    pair = spans.select("fov", F.col("roi").alias("label"), F.col("py").alias("y"), F.greatest(F.ceil(F.col("at")[F.col("k")]), F.lit(0)).cast("int").alias("a"), F.least(F.ceil(F.col("at")[F.col("k") + 1]) - 1, F.lit(width - 1)).cast("int").alias("b"))
    pixels = pair.where("a <= b").select("fov", "label", "y", F.explode(F.sequence("a", "b")).alias("x"))
    return rasterize(pixels)
