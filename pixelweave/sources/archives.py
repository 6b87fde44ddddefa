"""Archives and polygon files.

Archives are unpacked on the driver, before a job, into a folder that it shares with the
executors; region zips are a Spark source.
"""

from __future__ import annotations

import io
import os
import struct
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.deploy import ship
from pixelweave.operators.rasters import fill_polygons

SUFFIXES = (".tar.gz", ".tar.bz2", ".tgz", ".tar", ".zip")


def extract(path: str, target: str | None = None) -> str:
    """Unpack beside the archive (its name without the suffix) unless told where."""
    low = path.lower()
    suffix = next((s for s in SUFFIXES if low.endswith(s)), None)
    if suffix is None:
        raise ValueError(f"not an archive: {path}")
    target = target or path[: -len(suffix)]
    os.makedirs(target, exist_ok=True)
    if suffix == ".zip":
        with zipfile.ZipFile(path) as z:
            z.extractall(target)
    else:
        with tarfile.open(path) as t:
            t.extractall(target, filter="data")
    return target


def extract_all(root: str) -> list[tuple[str, str]]:
    """Unpack every archive below ``root`` whose target does not exist yet.

    Returns ``(path, error)`` for those that failed; the others are not held up.
    """
    failed = []
    for folder, _, names in os.walk(root):
        for name in names:
            suffix = next((s for s in SUFFIXES if name.lower().endswith(s)), None)
            path = os.path.join(folder, name)
            if suffix and not os.path.exists(path[: -len(suffix)]):
                try:
                    extract(path)
                except (OSError, tarfile.TarError, zipfile.BadZipFile, ValueError) as e:
                    failed.append((path, str(e)))
    return failed


def polygon(raw: bytes) -> list[tuple[float, float]]:
    """Vertices ``(y, x)`` of a polygon, freehand or rectangle region file."""
    if raw[:4] != b"Iout":
        raise ValueError("not a region file")
    kind = raw[6]
    top, left, bottom, right, n = struct.unpack_from(">hhhhH", raw, 8)
    if kind == 1:
        return [(float(y), float(x)) for y, x in ((top, left), (top, right), (bottom, right), (bottom, left))]
    xs = struct.unpack_from(f">{n}h", raw, 64)
    ys = struct.unpack_from(f">{n}h", raw, 64 + 2 * n)
    return [(float(top + y), float(left + x)) for y, x in zip(ys, xs)]


def polygons(path) -> list[tuple[int, int, float, float]]:
    """``(roi, seq, y, x)`` of a zip of region files (a path or an open file); numbers start
    at one and count regions with too few vertices."""
    with zipfile.ZipFile(path) as z:
        names = [n for n in z.namelist() if n.endswith(".roi")]
        return [(k, s, y, x) for k, n in enumerate(names, 1) for s, (y, x) in enumerate(polygon(z.read(n)))]


def read_regions(spark: SparkSession, root: str) -> DataFrame:
    """Vertices ``(fov, roi, seq, y, x, error)`` of every region zip below ``root``; the
    field is the file's name, a damaged file gives one row with its error."""
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.zip").load(root).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, raw in zip(pdf["path"], pdf["content"]):
                fov = os.path.splitext(os.path.basename(path))[0]
                try:
                    rows = [(fov, *row, None) for row in polygons(io.BytesIO(raw))]
                except (ValueError, IndexError, struct.error, zipfile.BadZipFile) as e:
                    rows = [(fov, None, None, None, None, str(e))]
                yield pd.DataFrame(rows, columns=["fov", "roi", "seq", "y", "x", "error"])

    return files.mapInPandas(run, "fov string, roi int, seq int, y double, x double, error string")


def region_masks(regions: DataFrame, frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Label rasters of the fields that have a frame ``(fov, h, w)``, and the fields
    without one."""
    sizes = frames.select("fov", "h", "w")
    height, width = sizes.agg(F.max("h"), F.max("w")).first()
    own = regions.where("error IS NULL").join(sizes.select("fov"), "fov", "left_semi")
    pixels = fill_polygons(own, height or 0, width or 0).join(sizes, "fov").where("y < h AND x < w").select("fov", "y", "x", "label")
    return pixels, regions.select("fov").distinct().join(sizes, "fov", "left_anti")
