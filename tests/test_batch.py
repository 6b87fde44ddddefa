"""Files to scored tables, options, scorers, refined regions against plain numpy."""

import numpy as np
import pytest

from pixelweave import batch, options, scorers
from pixelweave.operators import matching, morphology
from pixelweave.sources import tiff

H = W = 24


def painted(discs):
    """Label raster of discs ``(y, x, r)``, later ones on top."""
    grid = np.zeros((H, W), int)
    yy, xx = np.mgrid[:H, :W]
    for k, (y, x, r) in enumerate(discs, 1):
        grid[(yy - y) ** 2 + (xx - x) ** 2 <= r * r] = k
    return grid


def write_pass(spark, root, fields):
    """``fields``: name -> discs; the disc's number modulo 3 tells the classifier's flag."""
    feet, cells, frames = [], [], []
    yy, xx = np.mgrid[-3 : H + 3, -3 : W + 3]
    for fov, discs in fields.items():
        frames.append((fov, H, W))
        for k, (y, x, r) in enumerate(discs, 1):
            inside = (yy - y) ** 2 + (xx - x) ** 2 <= r * r
            feet.append((fov, k, [(int(a), int(b)) for a, b in zip(yy[inside], xx[inside])]))
            cells.append((fov, k, int(k % 3 > 0), k / 16 + 1 / 3))
    spark.createDataFrame(feet, batch.FOOTPRINTS).write.parquet(f"{root}/footprints")
    spark.createDataFrame(cells, batch.CELLS).write.parquet(f"{root}/cells")
    spark.createDataFrame(frames, batch.FRAMES).write.parquet(f"{root}/frames")


ACTIVITY = {"A": [(5, 5, 3), (14, 15, 4)], "B": [(8, 8, 3)], "C": [(8, 8, 3)]}
ANATOMY = {"A": [(6, 5, 3), (4, 18, 2), (1, 1, 2)], "B": [(8, 9, 3)]}


def test_files_to_scored_rows(spark, tmp_path):
    act, ana, img, out = (str(tmp_path / n) for n in ("act", "ana", "img", "out"))
    write_pass(spark, act, ACTIVITY)
    write_pass(spark, ana, ANATOMY)
    (tmp_path / "img").mkdir()
    means = {f: (np.arange(H * W).reshape(H, W) * 7 % 13 / 13).astype(np.float32) for f in "AB"}
    (tmp_path / "img/A_mean.tif").write_bytes(tiff.encode(means["A"]))
    (tmp_path / "img/A_mc_mean.tif").write_bytes(tiff.encode(means["A"] * 0))
    (tmp_path / "img/B_mc_mean.tif").write_bytes(tiff.encode(means["B"]))
    (tmp_path / "img/A_vcorr.tif").write_bytes(tiff.encode(means["A"] / 2))
    rows = batch.run_union(spark, act, ana, img, out, scorers.stub_scorer).collect()
    got = {(r.fov, r.tier): r for r in rows if r.fov == "A"}
    assert {r.fov for r in rows} == {"A", "B"}
    a, b = painted(ANATOMY["A"]), painted(ACTIVITY["A"])
    inter = ((a == 1) & (b == 1)).sum()
    gold = got["A", "GOLD"]
    assert gold.iou_score == pytest.approx(inter / ((a == 1).sum() + (b == 1).sum() - inter), abs=5e-5)
    assert gold.activity_s2p_prob == 1 / 16 + 1 / 3 and gold.anatomy_s2p_prob == 1 / 16 + 1 / 3
    assert sorted(r.tier for r in rows if r.fov == "A") == ["BRONZE", "GOLD", "SILVER", "SILVER"]
    back = {r.fov: r for r in tiff.read_stacks(spark, out).where("path LIKE '%masks%'").collect()}
    mask = np.array(back["A_all_s2p_masks"].data).reshape(H, W).astype(int)
    union = np.zeros((H, W), int)
    order = [("a", 1), ("a", 2), ("a", 3), ("b", 2)]
    for k, (side, label) in enumerate(order, 1):
        union[(a if side == "a" else b) == label] = k
    assert (mask == union).all()
    score = (means["A"].astype(float) + 2 * (means["A"] / 2).astype(np.float32).astype(float)) / 3
    for r in rows:
        if r.fov == "A":
            assert r.cellpose_mean_prob == pytest.approx(score[union == r.roi_id].mean(), abs=6e-6)
    # nothing is left to do, and a new field is all that a later run works on
    assert batch.run_union(spark, act, ana, img, out, scorers.stub_scorer).count() == 0
    (tmp_path / "img/C_mean.tif").write_bytes(tiff.encode(means["A"]))
    assert batch.run_union(spark, act, ana, img, out, scorers.stub_scorer).count() == 0
    assert {r.fov for r in spark.read.parquet(f"{out}/scored").select("fov").distinct().collect()} == {"A", "B"}


def test_scorer_by_field(spark):
    channels = spark.createDataFrame([(f, y, x, float(y), float(x)) for f in "pq" for y in range(3) for x in range(2)], "fov string, y int, x int, c0 double, c1 double")
    got = scorers.by_field(lambda image: image[..., 0] * 10 + image[..., 1])(channels).collect()
    assert len(got) == 12 and all(r.v == 10 * r.y + r.x for r in got)


def test_options():
    made = options.from_mapping(options.DetectorOptions, {"tau": 2.0, "block_size": [64, 64]}, tau=None, anatomical=0, fs=7.5)
    assert (made.tau, made.fs, made.block_size, made.anatomical) == (2.0, 7.5, (64, 64), 0)
    with pytest.raises(ValueError, match="wrong"):
        options.from_mapping(options.BatchOptions, {"wrong": 1})
    assert options.load(None) == {}


def test_masks_matched_and_written(spark, tmp_path):
    def rows(grid):
        ys, xs = np.nonzero(grid)
        return spark.createDataFrame([("f", int(y), int(x), int(grid[y, x])) for y, x in zip(ys, xs)], "fov string, y int, x int, label int")

    a, b = rows(painted(ANATOMY["A"])), rows(painted(ACTIVITY["A"]))
    records = batch.run_match(spark, a, b, spark.createDataFrame([("f", H, W)], "fov string, h int, w int"), str(tmp_path), ("gold",)).collect()
    found = {r.path.rsplit("/", 1)[1]: set(r.data) - {0.0} for r in tiff.read_stacks(spark, str(tmp_path)).collect()}
    assert found == {"f_consensus_masks.tif": {1.0}, "f_all_tiers_masks.tif": {float(k) for k in range(1, len(records) + 1)}}


def test_crowded_fields_are_split(spark):
    rng = np.random.default_rng(1)
    rows = {(1, int(a), int(a + d)): float(rng.integers(1, 400)) / 1000 for a in range(0, 300) for d in range(int(rng.integers(0, 3)))}
    from pixelweave.scratch import materialize

    edges = materialize(spark.createDataFrame([(*k, v) for k, v in rows.items()], "fov int, la int, lb int, iou double"), "test-edges")
    whole, split = (sorted(tuple(r) for r in matching.assigned(edges, most).collect()) for most in (10_000, 20))
    assert whole == split and len(whole) > 50


def flooded(relief, seeds):
    import heapq

    out, heap, n = seeds.copy(), [], 0
    for y, x in zip(*np.nonzero(seeds)):
        heapq.heappush(heap, (relief[y, x], n, y, x))
        n += 1
    while heap:
        _, _, y, x = heapq.heappop(heap)
        for ny, nx in ((y - 1, x), (y, x - 1), (y, x + 1), (y + 1, x)):
            if 0 <= ny < H and 0 <= nx < W and not out[ny, nx]:
                out[ny, nx] = out[y, x]
                heapq.heappush(heap, (relief[ny, nx], n, ny, nx))
                n += 1
    return out


def shifted(grid, dy, dx, mode):
    return np.pad(grid, 8, mode=mode)[8 + dy : 8 + dy + H, 8 + dx : 8 + dx + W]


def test_refined_regions(spark):
    rng = np.random.default_rng(4)
    image = rng.integers(0, 50, (H, W)).astype(float)
    labels = painted([(6, 6, 4), (6, 16, 5), (18, 10, 1)])
    w = np.exp(-0.5 * np.arange(-4, 5) ** 2.0)
    w /= w.sum()
    smooth = sum(v * shifted(image, d, 0, "edge") for d, v in zip(range(-4, 5), w))
    smooth = sum(v * shifted(smooth, 0, d, "edge") for d, v in zip(range(-4, 5), w))
    part = lambda k: sum(k[dy, dx] * shifted(smooth, dy - 1, dx - 1, "edge") for dy in range(3) for dx in range(3))
    kernel = np.outer([-0.5, 0, 0.5], [0.25, 0.5, 0.25])
    relief = np.sqrt((part(kernel) ** 2 + part(kernel.T) ** 2) / 2)
    diamond = lambda r: [(a, b) for a in range(-r, r + 1) for b in range(-r, r + 1) if abs(a) + abs(b) <= r]
    core = np.logical_and.reduce([shifted(labels > 0, a, b, "constant") for a, b in diamond(2)])
    near = np.logical_or.reduce([shifted(labels > 0, a, b, "constant") for a, b in diamond(5)])
    seeds = np.where(near, 0, 4) + np.where(core, labels, 0)
    ys, xs = np.nonzero(labels == 3)
    assert not core[labels == 3].any()
    seeds[int(ys.mean()), int(xs.mean())] = 3
    out = flooded(relief, seeds)
    want = {(y, x, int(out[y, x])) for y, x in zip(*np.nonzero((out == 1) | (out == 3)))}
    grid = lambda g, kind: [("f", y, x, kind(g[y, x])) for y in range(H) for x in range(W) if kind is float or g[y, x]]
    mean = spark.createDataFrame(grid(image, float), "fov string, y int, x int, v double")
    mask = spark.createDataFrame(grid(labels, int), "fov string, y int, x int, label int")
    records = spark.createDataFrame([("f", 1, "gold"), ("f", 2, "SILVER"), ("f", 3, "GOLD")], "fov string, roi_id int, tier string")
    got = {(r.y, r.x, r.label) for r in morphology.refined_regions(mean, mask, records, H, W, ("GOLD",)).collect()}
    assert got == want
    every = morphology.refined_regions(mean, mask, records, H, W)
    assert {r.label for r in every.collect()} == {1, 2, 3} and morphology.refined_regions(mean, mask, records, H, W, ()).count() == 0
