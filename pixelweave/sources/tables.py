"""Tables in explicit schemas: scored summary, records, traces, classifier arrays."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SCORED = "fov string, roi_id int, tier string, iou_score double, activity_iscell int, activity_s2p_prob double, anatomy_s2p_prob double, cellpose_mean_prob double"
RECORD = "fov string, roi_id int, tier string, iou_score double, cellpose_label int, s2p_label int, centroid_y int, centroid_x int, area_px long, s2p_iscell_prob double"


def read_csv(spark: SparkSession, path: str, schema: str = SCORED) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_by_field(df: DataFrame, path: str) -> None:
    """Parquet by field of view: a re-run replaces only the fields it has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("fov").parquet(path)


def wide_traces(traces: DataFrame, rois: list[int]) -> DataFrame:
    """A column ``ROI_<id>`` per region, at the sink only."""
    out = traces.groupBy("fov", "t").pivot("label", rois).avg("mean_f")
    return out.withColumnsRenamed({str(r): f"ROI_{r}" for r in rois})


def read_classifier(spark: SparkSession, root: str) -> DataFrame:
    """Plain float arrays ``(n, 2)``: ``(path, label, flag, prob)``, label from one.

    Pickled content is refused: such files run code when opened.  Footprints and run
    metadata come as Parquet or JSON instead.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "iscell.npy").load(root).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, raw in zip(pdf["path"], pdf["content"]):
                a = np.load(io.BytesIO(raw), allow_pickle=False)
                yield pd.DataFrame({"path": path, "label": np.arange(1, len(a) + 1), "flag": a[:, 0].astype(int), "prob": a[:, 1].astype(float)})

    return files.mapInPandas(run, "path string, label int, flag int, prob double")


def read_footprints(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("fov string, pass string, label int, pix array<struct<y:int,x:int>>").parquet(path)


def listing(spark: SparkSession, root: str) -> DataFrame:
    """Files below ``root`` as ``(dir, kind, name)`` for the planning operators."""
    from pyspark.sql import functions as F

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    parts = files.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"))
    kind = F.when(F.col("name").endswith("_mc.tif"), "tif").when(F.col("name").endswith("RoiSet.zip"), "zip")
    return parts.select("dir", kind.alias("kind"), "name").where("kind IS NOT NULL")
