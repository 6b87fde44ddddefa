"""Hand rasters with known answers, and assignment against brute force."""

from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pixelweave.operators import matching, morphology, rasters, scoring
from pixelweave.operators.assignment import canonical

PIXEL = "fov int, y int, x int, label int"


def raster(spark, *lines, fov=0):
    rows = [(fov, y, x, int(c)) for y, line in enumerate(lines) for x, c in enumerate(line) if c != "."]
    return spark.createDataFrame(rows, PIXEL)


ANATOMY = ("11.22.", "11.22.", "....33", "....33")
ACTIVITY = ("111.22", "1...22", "......", "44...3")


def test_records_and_union(spark):
    a, b = raster(spark, *ANATOMY), raster(spark, *ACTIVITY)
    records = matching.tier_records(a, b, 0.3)
    got = {(r.roi_id, r.tier, r.iou_score, r.cellpose_label, r.s2p_label, r.area_px, r.centroid_y, r.centroid_x) for r in records.collect()}
    assert got == {
        (1, "GOLD", 0.6, 1, 1, 4, 0, 0), (2, "GOLD", 0.3333, 2, 2, 4, 0, 3), (3, "SILVER", 0.0, 3, -1, 4, 2, 4),
        (4, "BRONZE", 0.0, -1, 3, 1, 3, 5), (5, "BRONZE", 0.0, -1, 4, 2, 3, 0),
    }
    union = matching.consensus_mask(a, b, records, scoring.TIERS).collect()
    assert sum(r.label == 3 for r in union) == 3
    assert {(r.y, r.x) for r in union if r.label == 4} == {(3, 5)}


def strip(spark, parts):
    return spark.createDataFrame([(0, 0, x, label) for label, (lo, hi) in parts.items() for x in range(lo, hi)], PIXEL)


def test_optimum_beats_greedy(spark):
    a, b = strip(spark, {1: (0, 16), 2: (16, 21)}), strip(spark, {1: (0, 5), 2: (5, 21)})
    edges = matching.iou_edges(a, b)
    assert {(r.la, r.lb) for r in matching.optimal_pairs(edges, 0.3).collect()} == {(1, 1), (2, 2)}
    assert matching.optimal_pairs(edges, 0.4).count() == 0


def test_empty_sides(spark):
    a, none = raster(spark, *ANATOMY), spark.createDataFrame([], PIXEL)
    assert {r.tier for r in matching.tier_records(a, none).collect()} == {"SILVER"}
    assert {r.tier for r in matching.tier_records(none, a).collect()} == {"BRONZE"}
    assert matching.tier_records(none, none).count() == 0
    with pytest.raises(ValueError):
        matching.optimal_pairs(matching.iou_edges(a, a), 0.0)


def test_overpaint(spark):
    px = spark.createDataFrame([(0, 0, 0, 1), (0, 0, 1, 1), (0, 0, 0, 2), (0, 0, 1, 2), (0, 0, 2, 2)], PIXEL)
    assert {r.label for r in rasters.rasterize(px).collect()} == {2}


def test_missing_probability_passes(spark):
    scored = spark.createDataFrame([(1, "gold", None), (2, "GOLD", 0.2), (3, "GOLD", 0.9), (4, "GOLD", float("nan"))], "roi_id int, tier string, cellpose_mean_prob double")
    assert {r.roi_id for r in scoring.viewer_filter(scored, least=0.5).collect()} == {1, 3, 4}


def test_half_threshold_precision(spark):
    a = strip(spark, {1: (0, 10), 2: (10, 20)})
    b = strip(spark, {1: (0, 20)})
    got = {r.threshold: (r.tp, r.ap) for r in matching.precision(a, b, (0.5, 0.6)).collect()}
    assert got == {0.5: (1, 0.5), 0.6: (0, 0.0)}


def brute(weight):
    n, m = weight.shape
    size = max(n, m)
    full = np.zeros((size, size))
    full[:n, :m] = weight
    best, choice = -1.0, None
    for p in permutations(range(size)):
        pairs = tuple((i, j) for i, j in enumerate(p) if full[i, j] > 0)
        total = sum(full[i, j] for i, j in pairs)
        if total > best + 1e-9 or (abs(total - best) <= 1e-9 and pairs < choice):
            best, choice = max(best, total), pairs
    return best, choice


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 4), st.integers(1, 4), st.data())
def test_assignment_is_optimal_and_canonical(n, m, data):
    weight = np.array([[data.draw(st.sampled_from([0, 0, 0.25, 0.3, 0.5, 0.6, 0.9])) for _ in range(m)] for _ in range(n)], dtype=float)
    got = canonical(weight)
    best, _ = brute(weight)
    assert abs(sum(weight[i, j] for i, j in got) - best) < 1e-9
    assert len({i for i, _ in got}) == len(got) == len({j for _, j in got})


def listed(weight):
    """As the SQL: matchings by their number of pairs, later items first, the first of the largest total."""
    items = [(i, j) for i in range(weight.shape[0]) for j in range(weight.shape[1]) if weight[i, j] > 0]
    every, last = [], [()]
    while last:
        every += last
        last = [g + (e,) for e in reversed(items) for g in last if (not g or g[-1] < e) and all(e[0] != i and e[1] != j for i, j in g)]
    return max(every, key=lambda g: sum(weight[p] for p in g))


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 4), st.integers(1, 4), st.data())
def test_equal_optima_are_taken_in_the_order_of_the_sql(n, m, data):
    weight = np.array([[data.draw(st.sampled_from([0, 0, 0.125, 0.25, 0.375, 0.5])) for _ in range(m)] for _ in range(n)], dtype=float)
    assert tuple(canonical(weight)) == listed(weight)


def test_equal_partners_of_a_region():
    assert canonical(np.array([[0.25], [0.25]])) == [(1, 0)]
    assert canonical(np.array([[0.5, 0.25], [0.25, 0.0]])) == [(0, 0)]


def test_erosion_dilation_contour(spark):
    mask = raster(spark, "11111", "11111", "11111", "11111", "11111")
    assert {(r.y, r.x) for r in morphology.erode(mask, 2, 5, 5).collect()} == {(2, 2)}
    dot = raster(spark, ".....", ".....", "..1..", ".....", ".....")
    assert {(r.y, r.x) for r in morphology.contour(dot, 5, 5).collect()} == {(1, 2), (3, 2), (2, 1), (2, 3)}
    assert morphology.dilate(dot, 5, 5, 5).count() == 25


def test_watershed_splits_between_seeds(spark):
    relief = spark.createDataFrame([(0, 0, x, float(v)) for x, v in enumerate([0, 1, 5, 1, 0])], "fov int, y int, x int, v double")
    seeds = spark.createDataFrame([(0, 0, 0, 1), (0, 0, 4, 2), (0, 0, 2, 3)], PIXEL).where("label < 3")
    seeds = seeds.unionByName(spark.createDataFrame([(0, 0, 2, 3)], PIXEL))
    got = {r.x: r.label for r in morphology.watershed(relief, seeds, 1, 5).collect()}
    assert got == {0: 1, 1: 1, 3: 2, 4: 2}


def test_prefix_match_of_all_parts(spark):
    import pyarrow.parquet as pq
    from pixelweave import catalogue
    from pixelweave.operators import planning

    keys = pq.read_table("/root/testdata/sf0.01/part.parquet")["p_partkey"].to_pylist()
    paths = sorted(f"FOV{k}_mc.tif" for k in keys if k % 2 == 0)
    want = {f"FOV{k}": next((p for p in paths if p.startswith(f"FOV{k}")), None) for k in keys}
    df = catalogue.queries()["prefix_match_all"](spark, "/root/testdata/sf0.01")
    assert {r.stem: r.path for r in df.collect()} == want and len(want) == len(keys)
    assert "NestedLoop" not in df._jdf.queryExecution().toString()
    masks = spark.createDataFrame([("a",), ("a",), ("",), (None,), ("é1",), ("zz",), ("ab.tif",)], "stem string")
    stacks = spark.createDataFrame([("ab.tif",), ("aa.tif",), ("é12",), (None,), ("ab.tif",)], "path string")
    assert sorted(map(tuple, planning.prefix_match(masks, stacks).collect()), key=str) == sorted([("", "aa.tif"), ("a", "aa.tif"), ("ab.tif", "ab.tif"), ("zz", None), ("é1", "é12"), (None, None)], key=str)


def test_refined_frames_equal_the_relational_steps(spark):
    rng = np.random.default_rng(5)
    h, w = 24, 30
    lines = np.zeros((2, h, w), int)
    for f in range(2):
        for label in range(1, 9):
            y, x, a, b = rng.integers(0, h - 3), rng.integers(0, w - 3), rng.integers(1, 9), rng.integers(1, 9)
            lines[f, y : y + a, x : x + b] = label
    mask = spark.createDataFrame([(int(f), int(y), int(x), int(lines[f, y, x])) for f, y, x in zip(*np.nonzero(lines))], PIXEL)
    mean = spark.createDataFrame([(f, y, x, float(v)) for f in range(3) for (y, x), v in np.ndenumerate(rng.random((h, w)))], "fov int, y int, x int, v double")
    records = mask.selectExpr("fov", "label AS roi_id", "'GOLD' AS tier").distinct()
    relief = {(r.fov, r.y, r.x): r.v for r in morphology.sobel(morphology.gaussian(mean, h, w), h, w).collect()}
    grid = np.zeros((3, h, w))
    for r in mean.collect():
        grid[r.fov, r.y, r.x] = r.v
    assert all(np.allclose([[relief[f, y, x] for x in range(w)] for y in range(h)], morphology.gradient_of(grid[f]), atol=1e-12) for f in range(3))
    seeds = {(r.fov, r.y, r.x): r.label for r in morphology.markers(mask, h, w).collect()}
    assert seeds == {(f, y, x): v for f in range(2) for (y, x), v in np.ndenumerate(morphology.marked(lines[f])) if v}
    want = morphology.watershed(morphology.sobel(morphology.gaussian(mean, h, w), h, w), morphology.markers(mask, h, w), h, w)
    refined = morphology.refined_regions(mean, mask, records, h, w)
    assert sorted(map(tuple, refined.collect())) == sorted(map(tuple, want.select("fov", "y", "x", "label").collect()))
    plan = refined._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "FlatMapCoGroupsInPandas" in plan


def test_flood_without_far_background_keeps_the_largest_region(spark):
    mask = raster(spark, "1111", "1111", "2222", "2222")
    mean = spark.createDataFrame([(0, y, x, float(y * 4 + x)) for y in range(4) for x in range(4)], "fov int, y int, x int, v double")
    records = spark.createDataFrame([(0, 1, "GOLD"), (0, 2, "GOLD")], "fov int, roi_id int, tier string")
    assert {r.label for r in morphology.refined_regions(mean, mask, records, 4, 4).collect()} == {1, 2}


def test_counted_records_equal_those_of_masks(spark):
    from pixelweave.operators import evaluation

    a, b = raster(spark, *ANATOMY), raster(spark, *ACTIVITY)
    truth = raster(spark, "111.2.", "11..22", "....33", "......")
    none = "CAST(NULL AS INT)"
    sides = [df.selectExpr("fov", "y", "x", *[f"{'label' if k == own else none} AS {k}" for k in ("la", "lb", "lt")]) for own, df in (("la", a), ("lb", b), ("lt", truth))]
    counts = matching.overlay(sides[0].unionByName(sides[1]).unionByName(sides[2]), "la", "lb", "lt")
    records = matching.tier_records(a, b)
    assert sorted(map(tuple, matching.counted_records(counts).collect())) == sorted(map(tuple, records.select(*matching.counted_records(counts).columns).collect()))
    masks = evaluation.variants(matching.consensus_mask(a, b, records), matching.consensus_mask(a, b, records, scoring.TIERS), records, a)
    present = masks.selectExpr("variant", "fov", "true AS same_shape").distinct()
    want = evaluation.variant_precision(masks, present, truth)
    got = evaluation.counted_variants(evaluation.variant_counts(counts, records), present)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() == 8
