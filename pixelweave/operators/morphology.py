"""Neighbourhood operators on label rasters of known frame size.

Background has no rows.  Outside the frame counts as background.  The structuring
element is the cross of four neighbours and its powers, diamonds.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixelweave.deploy import ship
from pixelweave.functions.scalar import TIERS
from pixelweave.operators.rasters import areas


def _spread(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """The four neighbours of every pixel inside the frame."""
    cells = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((-1, 0), (0, -1), (0, 1), (1, 0))])
    out = pixels.select("fov", "label", "y", "x", F.inline(cells)).select("fov", "label", (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"))
    return out.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))


def contour(mask: DataFrame, height: int, width: int) -> DataFrame:
    """The ring of pixels just outside each region; it may lie on other regions."""
    ring = _spread(mask, height, width).withColumn("own", F.lit(0))
    both = ring.unionByName(mask.select("fov", "label", "y", "x", F.lit(1).alias("own")))
    return both.groupBy("fov", "label", "y", "x").agg(F.max("own").alias("own")).where("own = 0").drop("own")


def runs(mask: DataFrame, *keys: str) -> DataFrame:
    """Stretches ``(fov, *keys, y, x0, x1)`` of neighbouring labelled pixels in a row."""
    row = ["fov", *keys, "y"]
    pixels = mask.select(*row, "x").distinct() if keys else mask.select("fov", "y", "x")
    place = F.col("x") - F.row_number().over(Window.partitionBy(*row).orderBy("x"))
    return pixels.withColumn("k", place).groupBy(*row, "k").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("k")


def _beside(stretches: DataFrame, radius: int, height: int, grow: bool) -> DataFrame:
    """Stretches seen from the rows within ``radius``, longer or shorter at both ends by
    what the diamond leaves there."""
    by = F.array(*[F.struct(F.lit(d).alias("dy"), F.lit(radius - abs(d)).alias("by")) for d in range(-radius, radius + 1)])
    moved = stretches.select("fov", "y", "x0", "x1", F.inline(by)).where((F.col("y") + F.col("dy")).between(0, height - 1))
    by = F.col("by") if grow else -F.col("by")
    return moved.select("fov", (F.col("y") + F.col("dy")).alias("y"), (F.col("x0") - by).alias("x0"), (F.col("x1") + by).alias("x1"))


def dilate(mask: DataFrame, radius: int, height: int, width: int) -> DataFrame:
    """Pixels within the diamond of any region, by stretches of rows united."""
    near = _beside(runs(mask), radius, height, True)
    near = near.select("fov", "y", F.greatest("x0", F.lit(0)).alias("x0"), F.least("x1", F.lit(width - 1)).alias("x1"))
    upto = F.max("x1").over(Window.partitionBy("fov", "y").orderBy("x0", "x1").rowsBetween(Window.unboundedPreceding, -1))
    fresh = near.withColumn("from", F.greatest("x0", F.coalesce(upto + 1, F.lit(0)))).where(F.col("from") <= F.col("x1"))
    return fresh.select("fov", "y", F.explode(F.sequence("from", "x1")).alias("x"))


def erode(mask: DataFrame, radius: int, height: int, width: int) -> DataFrame:
    """Labelled pixels whose whole diamond is labelled, whatever by."""
    near = _beside(runs(mask), radius, height, False).where(F.col("x0") <= F.col("x1"))
    inside = near.select("fov", "y", F.explode(F.sequence("x0", "x1")).alias("x")).groupBy("fov", "y", "x").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == 2 * radius + 1)
    return mask.join(inside.select("fov", "y", "x").hint("merge"), ["fov", "y", "x"], "left_semi").select("fov", "y", "x", "label")


def markers(mask: DataFrame, height: int, width: int, erosion: int = 2, dilation: int = 5) -> DataFrame:
    """Seeds: eroded labels; a region lost to erosion keeps its truncated mean position;
    far background is one label above the largest.  A lost region's seed wins over
    background and, of several on a pixel, the largest label stays."""
    core = erode(mask, erosion, height, width)
    lost = areas(mask).join(core.select("fov", "label").distinct(), ["fov", "label"], "left_anti")
    points = lost.select("fov", F.col("centroid_y").alias("y"), F.col("centroid_x").alias("x"), "label")
    frame = mask.groupBy("fov").agg((F.max("label") + 1).alias("label"))
    frame = frame.select("fov", "label", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y")).select("fov", "label", "y", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))
    far = frame.join(dilate(mask, dilation, height, width).hint("merge"), ["fov", "y", "x"], "left_anti").select("fov", "y", "x", "label")
    every = core.withColumn("rank", F.lit(1)).unionByName(points.withColumn("rank", F.lit(2))).unionByName(far.withColumn("rank", F.lit(0)))
    return every.groupBy("fov", "y", "x").agg(F.max(F.struct("rank", "label"))["label"].alias("label"))


def _readers(c: str, n: int, reach: int):
    """Outputs ``o`` that read coordinate ``c`` at offset ``d``: coordinates outside take
    the nearest inside, so the first and last one are read from beyond the edge too."""
    kind = "array<struct<o:int,d:int>>"
    pairs = lambda found: F.array(*[F.struct(o.alias("o"), F.lit(d).alias("d")) for o, d in found]).cast(kind)
    inner = F.filter(pairs([(F.col(c) - d, d) for d in range(-reach, reach + 1)]), lambda s: s["o"].between(0, n - 1))
    first = pairs([(F.lit(o), d) for d in range(-reach, 0) for o in range(min(-d, n))])
    last = pairs([(F.lit(o), d) for d in range(1, reach + 1) for o in range(max(n - d, 0), n)])
    none = F.array().cast(kind)
    return F.concat(inner, F.when(F.col(c) == 0, first).otherwise(none), F.when(F.col(c) == n - 1, last).otherwise(none))


def _weights(w) -> Column:
    return F.array(*[F.lit(float(v)) for v in w])


def _filtered(raster: DataFrame, reach: int, height: int, width: int, **kernels: tuple) -> DataFrame:
    """Separable filters of a dense raster, each a column: every pixel is scattered to
    the outputs that read it, and one aggregate sums them all."""
    far = raster.select("fov", "x", "v", F.inline(_readers("y", height, reach))).select("fov", F.col("o").alias("oy"), F.col("d").alias("dy"), "x", "v")
    far = far.select("fov", F.col("oy").alias("y"), "dy", "v", F.inline(_readers("x", width, reach))).withColumnsRenamed({"o": "x", "d": "dx"})
    at = lambda w, d: F.get(_weights(w), F.col(d) + reach)
    return far.groupBy("fov", "y", "x").agg(*[F.sum(at(down, "dy") * at(across, "dx") * F.col("v")).alias(name) for name, (down, across) in kernels.items()])


def gaussian(raster: DataFrame, height: int, width: int, sigma: float = 1.0, reach: int = 4) -> DataFrame:
    """Separable Gaussian of a dense raster, weights cut at ``reach`` and scaled to one."""
    w = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    w /= w.sum()
    down = raster.select("fov", "x", "v", F.inline(_readers("y", height, reach))).groupBy("fov", F.col("o").alias("y"), "x")
    down = down.agg(F.sum(F.get(_weights(w), F.col("d") + reach) * F.col("v")).alias("v"))
    across = down.select("fov", "y", "v", F.inline(_readers("x", width, reach))).groupBy("fov", "y", F.col("o").alias("x"))
    return across.agg(F.sum(F.get(_weights(w), F.col("d") + reach) * F.col("v")).alias("v"))


def sobel(raster: DataFrame, height: int, width: int) -> DataFrame:
    """Gradient magnitude of a dense raster: 3 x 3 kernels with weights 1/4, 1/2, 1/4,
    root of the mean square of both directions."""
    smooth, edge = (0.25, 0.5, 0.25), (-0.5, 0.0, 0.5)
    both = _filtered(raster, 1, height, width, gy=(edge, smooth), gx=(smooth, edge))
    return both.select("fov", "y", "x", F.sqrt((F.col("gy") * F.col("gy") + F.col("gx") * F.col("gx")) / 2.0).alias("v"))


def flood(height_map: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Priority flood from seeds: lowest value first, then order of arrival.

    Works on flat lists with a rim that counts as labelled; seeds without an unlabelled
    neighbour have nothing to give and stay out of the queue.
    """
    h, w = seeds.shape
    wide = w + 2
    rim = np.pad(seeds.astype(np.int64), 1, constant_values=-1)
    open_ = rim == 0
    beside = np.zeros_like(open_)
    beside[1:-1, 1:-1] = open_[:-2, 1:-1] | open_[2:, 1:-1] | open_[1:-1, :-2] | open_[1:-1, 2:]
    first = np.flatnonzero((rim > 0) & beside)
    relief, out = np.pad(height_map, 1).ravel().tolist(), rim.ravel().tolist()
    heap = [(relief[at], order, at) for order, at in enumerate(first.tolist())]
    order = len(heap)
    heapq.heapify(heap)
    push, pop = heapq.heappush, heapq.heappop
    while heap:
        _, _, at = pop(heap)
        label = out[at]
        for near in (at - wide, at - 1, at + 1, at + wide):
            if not out[near]:
                out[near] = label
                push(heap, (relief[near], order, near))
                order += 1
    return np.array(out, np.int64).reshape(h + 2, wide)[1:-1, 1:-1]


def gradient_of(image: np.ndarray, sigma: float = 1.0, reach: int = 4) -> np.ndarray:
    """``sobel`` of ``gaussian`` of one whole frame."""
    h, w = image.shape
    taps = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    taps /= taps.sum()
    wide = np.pad(image, ((reach, reach), (0, 0)), mode="edge")
    wide = np.pad(sum(t * wide[k : k + h] for k, t in enumerate(taps)), ((0, 0), (reach, reach)), mode="edge")
    wide = np.pad(sum(t * wide[:, k : k + w] for k, t in enumerate(taps)), 1, mode="edge")
    smooth = lambda a, b, c: 0.25 * a + 0.5 * b + 0.25 * c
    down, across = 0.5 * (wide[2:] - wide[:-2]), 0.5 * (wide[:, 2:] - wide[:, :-2])
    gy, gx = smooth(down[:, :-2], down[:, 1:-1], down[:, 2:]), smooth(across[:-2], across[1:-1], across[2:])
    return np.sqrt((gy * gy + gx * gx) / 2.0)


def _cross(on: np.ndarray, outside: bool, grow: bool) -> np.ndarray:
    """One step of the four neighbours: any of them (``grow``) or all."""
    p = np.pad(on, 1, constant_values=outside)
    near = (p[1:-1, 1:-1], p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:])
    return (np.logical_or if grow else np.logical_and).reduce(near)


def marked(mask: np.ndarray, erosion: int = 2, dilation: int = 5) -> np.ndarray:
    """``markers`` of one whole frame; zero where there is none."""
    on = mask > 0
    core = near = on
    for _ in range(erosion):
        core = _cross(core, False, False)
    for _ in range(dilation):
        near = _cross(near, False, True)
    out = np.where(core, mask, np.where(near, 0, mask.max() + 1))
    lost = np.setdiff1d(mask[on], mask[core])
    if len(lost):
        ys, xs = np.nonzero(np.isin(mask, lost))
        at = np.searchsorted(lost, mask[ys, xs])
        n = np.bincount(at)
        for label, y, x in zip(lost, np.bincount(at, ys) // n, np.bincount(at, xs) // n):  # in rising order: the largest stays
            out[int(y), int(x)] = label
    return out


def watershed(relief: DataFrame, seeds: DataFrame, height: int, width: int) -> DataFrame:
    """Seeded watershed of each field of view; the largest seed label is background.

    A flood is sequential by nature, so one task solves one field of view.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grid, mark = np.zeros((height, width)), np.zeros((height, width), np.int64)
        grid[pdf["y"], pdf["x"]] = pdf["v"]
        own = pdf[pdf["label"] > 0]
        mark[own["y"], own["x"]] = own["label"]
        out = flood(grid, mark)
        ys, xs = np.nonzero((out > 0) & (out < max(mark.max(), 1)))
        return pd.DataFrame({"fov": pdf["fov"].iloc[0], "y": ys, "x": xs, "label": out[ys, xs]})

    ship(relief.sparkSession)
    joined = relief.join(seeds.hint("merge"), ["fov", "y", "x"], "left").select("fov", "y", "x", "v", F.coalesce("label", F.lit(0)).alias("label"))
    return joined.groupBy("fov").applyInPandas(run, f"fov {dict(joined.dtypes)['fov']}, y int, x int, label int")


def refined_regions(mean: DataFrame, mask: DataFrame, records: DataFrame, height: int, width: int, tiers: tuple[str, ...] | None = None) -> DataFrame:
    """Regions of the wanted tiers (None: all) with their borders moved to edges of the
    mean image: ``(fov, y, x, label)``; fields without such regions have no rows.

    The relief is the gradient of the smoothed image, the seeds are ``markers``.  A flood
    is sequential, so one task holds a whole frame anyway and filters and marks it too.
    """

    def run(image: pd.DataFrame, regions: pd.DataFrame) -> pd.DataFrame:
        grid, own = np.zeros((height, width)), np.zeros((height, width), np.int64)
        grid[image["y"], image["x"]] = image["v"]
        own[regions["y"], regions["x"]] = regions["label"]
        top = own.max()
        out = flood(gradient_of(grid), marked(own)) if top and len(image) else own * 0
        ys, xs = np.nonzero((out > 0) & (out <= top))
        return pd.DataFrame({"fov": image["fov"].iloc[0] if len(image) else None, "y": ys, "x": xs, "label": out[ys, xs]})

    wanted = records.where(F.upper("tier").isin(*[t.upper() for t in (TIERS if tiers is None else tiers)])).select("fov", F.col("roi_id").alias("label"))
    own = F.broadcast(wanted.select("fov").distinct())
    mask, mean = (df.join(own, "fov", "left_semi") for df in (mask, mean))
    ship(mean.sparkSession)
    pixels = mean.select("fov", "y", "x", "v").groupBy("fov").cogroup(mask.select("fov", "y", "x", "label").groupBy("fov"))
    refined = pixels.applyInPandas(run, f"fov {dict(mean.dtypes)['fov']}, y int, x int, label int")
    return refined.join(wanted.hint("shuffle_hash"), ["fov", "label"], "left_semi").select("fov", "y", "x", "label")


def refined_outlines(mean: DataFrame, mask: DataFrame, records: DataFrame, height: int, width: int, tiers: tuple[str, ...] | None = None) -> DataFrame:
    """Contours of the refined regions."""
    return contour(refined_regions(mean, mask, records, height, width, tiers), height, width)
