"""Typed options of the detector's contract and of a batch, from nested mappings."""

from __future__ import annotations

import dataclasses
import json
import os
from collections.abc import Mapping
from typing import Any, TypeVar

T = TypeVar("T")


@dataclasses.dataclass(frozen=True)
class DetectorOptions:
    """What the external detector is told; its results come in as tables.

    Fixed values: the defaults are those of the contract.  ``anatomical`` is 0 for the
    pass on activity, 1 for the pass on the mean image.
    """

    fs: float = 30.0
    tau: float = 1.0
    anatomical: int = 0
    do_registration: bool = False
    nplanes: int = 1
    nchannels: int = 1
    functional_chan: int = 1
    nimg_init: int = 300
    batch_size: int = 250
    smooth_sigma: float = 1.15
    maxregshift: float = 0.1
    nonrigid: bool = True
    block_size: tuple[int, int] = (128, 128)
    spatial_scale: int = 0
    threshold_scaling: float = 1.0
    max_iterations: int = 20
    connected: bool = True
    nbinned: int = 5000
    allow_overlap: bool = False
    preclassify: float = 0.0
    high_pass: int = 100
    inner_neuropil_radius: int = 2
    min_neuropil_pixels: int = 350
    spikedetect: bool = True


@dataclasses.dataclass(frozen=True)
class BatchOptions:
    """How a batch matches, scores and writes."""

    iou_threshold: float = 0.3
    second_channel: bool = True
    resume: bool = True
    diameter: float = 30.0


def from_mapping(kind: type[T], config: Mapping[str, Any] | None, **given: Any) -> T:
    """Options of a kind: what is given wins, then the mapping, then the defaults.

    ``None`` means not given; zero is a value like any other.  Unknown names are an error.
    """
    names = {f.name for f in dataclasses.fields(kind)}
    values = {**(config or {}), **{k: v for k, v in given.items() if v is not None}}
    unknown = sorted(set(values) - names)
    if unknown:
        raise ValueError(f"unknown options: {', '.join(unknown)}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})


def load(path: str | None) -> dict[str, Any]:
    """A JSON file of nested options; without a file there are none."""
    if not path or not os.path.exists(path):
        return {}
    with open(path) as f:
        return json.load(f)
