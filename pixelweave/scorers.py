"""Scorers give every pixel a value that regions are judged by.

A scorer takes dense two-channel rasters ``(fov, y, x, c0, c1)`` and returns
``(fov, y, x, v)``; values outside [0, 1] count as logits.  Networks are external: they
are plugged in through ``by_field``.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweave.deploy import ship


class Scorer(Protocol):
    def __call__(self, channels: DataFrame) -> DataFrame: ...


def stub_scorer(channels: DataFrame) -> DataFrame:
    """A STUB, not a model: arithmetic on the channels, for tests and dry runs."""
    return channels.select("fov", "y", "x", ((F.col("c0") + 2 * F.col("c1")) / 3).alias("v"))


def by_field(model: Callable[[np.ndarray], np.ndarray]) -> Scorer:
    """A scorer from a function of one field's array (height, width, 2).

    One task holds one field; the function must be picklable and is sent to the tasks.
    """

    def score(channels: DataFrame) -> DataFrame:
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            image = np.zeros((int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1, 2), np.float32)
            image[pdf["y"], pdf["x"], 0], image[pdf["y"], pdf["x"], 1] = pdf["c0"], pdf["c1"]
            v = np.asarray(model(image), float)
            return pd.DataFrame({"fov": pdf["fov"], "y": pdf["y"], "x": pdf["x"], "v": v[pdf["y"], pdf["x"]]})

        ship(channels.sparkSession)
        return channels.groupBy("fov").applyInPandas(run, f"fov {dict(channels.dtypes)['fov']}, y int, x int, v double")

    return score
