"""No plan broadcasts pixels, however few bytes they are estimated at."""

import re

import pytest

from pixelweave import catalogue
from pixelweave.operators import evaluation, matching

SF = "/root/testdata/sf0.001"


def broadcasts(df):
    """Columns of every broadcast side."""
    nodes = [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            nodes.append(node.initialPlan())
            continue
        if node.nodeName() == "BroadcastExchange":
            yield {node.output().apply(k).name() for k in range(node.output().size())}
        nodes += [node.children().apply(k) for k in range(node.children().size())]


@pytest.mark.parametrize(
    "name",
    [
        "dense_scores",
        "footprint_raster",
        "markers",
        "merge_masks",
        "merge_totals",
        "preview",
        "scored_rois",
        "shown_of_total",
        "viewer_filter",
        "high_confidence",
        "watershed",
        "two_channel_stack",
        "two_channel_training",
        "score_raw_footprint",
        "probability_raster",
    ],
)
def test_pixels_are_not_broadcast(spark, monkeypatch, name):
    plans = []

    def watched(df, tag, write=matching.materialize):
        plans.append(df)
        return write(df, tag)

    monkeypatch.setattr(catalogue, "materialize", watched)
    monkeypatch.setattr(matching, "materialize", watched)
    plans.append(catalogue.queries()[name](spark, SF))
    assert not [columns for df in plans for columns in broadcasts(df) if {"y", "x"} <= columns]


def of_pixels(node):
    """Whether a plan has a row per pixel, read as written or made, though it may bear no coordinates."""
    name, text = node.nodeName(), node.simpleString(200)
    if {"y", "x"} <= {node.output().apply(k).name() for k in range(node.output().size())}:
        return True
    if "Aggregate" in name:
        return "y#" in text.split("functions=")[0]
    if name.startswith("Scan parquet"):
        return "-masks" in node.relation().location().toString()
    sides = [node.children().apply(k) for k in range(node.children().size())]
    return any(map(of_pixels, sides[:1] if "LeftSemi" in text or "LeftAnti" in text else sides))


def unnamed(df):
    """Joins that meet pixels with regions by a broadcast of whichever side is estimated smaller."""
    nodes = [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            nodes.append(node.initialPlan())
            continue
        sides = [node.children().apply(k) for k in range(node.children().size())]
        if node.nodeName() == "BroadcastHashJoin" and node.leftKeys().size() > 1 and any(map(of_pixels, sides)):
            yield node.simpleString(200)
        nodes += sides


@pytest.mark.parametrize(
    "name",
    [
        "gold_only_mask",
        "consensus_mask_default",
        "union_mask",
        "tier_layer_pixels",
        "uncovered_gold",
        "merge_totals",
        "preview",
        "variant_precision",
        "variant_means",
        "scored_rois",
        "shown_of_total",
        "viewer_filter",
        "high_confidence",
        "refined_outlines",
    ],
)
def test_pixels_meet_regions_by_partition(spark, name):
    assert not list(unnamed(catalogue.queries()[name](spark, SF)))


def test_variants_read_written_tables(spark):
    plan = catalogue.queries()["variant_means"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "part.parquet" not in plan and plan.count("Scan parquet") <= 24


@pytest.mark.parametrize("name", ["variant_means", "variant_precision"])
def test_variants_make_their_pixels_once_and_where_they_are(spark, monkeypatch, name):
    """Masks and truth meet in one overlay, pixels are not dealt out; all else reads counts."""
    plans = {}

    def watched(df, tag, write=matching.materialize):
        plans[tag] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, tag)

    for module in (catalogue, matching, evaluation):
        monkeypatch.setattr(module, "materialize", watched)
    catalogue.queries()[name](spark, SF)
    assert [tag for tag, plan in plans.items() if re.search(r"\by#", plan)] == ["overlay"]
    assert not re.search(r"Exchange.*\b[yx]#", plans["overlay"])
