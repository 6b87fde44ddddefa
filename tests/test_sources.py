"""Round trips of files, archives and the incremental run."""

import os
import struct
import zipfile

import numpy as np
import pytest

from pixelweave.operators import planning
from pixelweave.sources import archives, tables, tiff
from pixelweave.streaming import process_landed


@pytest.mark.parametrize("kind", ["uint8", "uint16", "float32"])
def test_tiff_round_trip(kind):
    frames = (np.arange(2 * 3 * 5) * 7 % 251).reshape(2, 3, 5).astype(kind)
    assert (tiff.decode(tiff.encode(frames)) == frames).all()
    assert tiff.shape_of(tiff.encode(frames)) == (2, 3, 5)


def test_stacks_and_bad_files(spark, tmp_path):
    frames = np.arange(24, dtype=np.float32).reshape(2, 3, 4)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/A_mc.tif").write_bytes(tiff.encode(frames))
    (tmp_path / "B.tiff").write_bytes(b"junk data")
    (tmp_path / "C.Tif").write_bytes(tiff.encode(frames))
    assert tiff.discover(spark, str(tmp_path)).count() == 2
    rows = tiff.read_stacks(spark, str(tmp_path)).collect()
    good = {r.t: r.data for r in rows if r.error is None}
    assert [r.fov for r in rows if r.error is None] == ["A", "A"] and list(good[1]) == list(range(12, 24))
    assert sum(r.error is not None for r in rows) == 1
    assert {(r.fov, r.frames) for r in tiff.validate(spark, str(tmp_path)).where("error IS NULL").collect()} == {("A", 2)}


def test_label_round_trip(spark, tmp_path):
    mask = spark.createDataFrame([("f", 0, 1, 3), ("f", 1, 1, 7)], "fov string, y int, x int, label int")
    frames = spark.createDataFrame([("f", 2, 3), ("g", 2, 2)], "fov string, h int, w int")
    assert tiff.write_labels(mask, frames, str(tmp_path)).count() == 2
    back = tiff.label_pixels(tiff.read_stacks(spark, str(tmp_path)))
    assert {(r.y, r.x, r.label) for r in back.collect()} == {(0, 1, 3), (1, 1, 7)}


def test_classifier_refuses_pickles(spark, tmp_path):
    np.save(tmp_path / "iscell.npy", np.array([[1, 0.5], [0, 0.25]]))
    assert {(r.label, r.flag, r.prob) for r in tables.read_classifier(spark, str(tmp_path)).collect()} == {(1, 1, 0.5), (2, 0, 0.25)}
    np.save(tmp_path / "iscell.npy", np.array([{}], dtype=object), allow_pickle=True)
    with pytest.raises(Exception, match="allow_pickle"):
        tables.read_classifier(spark, str(tmp_path)).collect()


def test_archives(tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("a.txt", "hello")
    (tmp_path / "bad.tar").write_bytes(b"no")
    assert [os.path.basename(p) for p, _ in archives.extract_all(str(tmp_path))] == ["bad.tar"]
    assert (tmp_path / "x/a.txt").read_text() == "hello"
    with pytest.raises(ValueError):
        archives.extract(str(tmp_path / "a.rar"))


def test_polygon_file():
    raw = bytearray(64 + 12)
    raw[:4] = b"Iout"
    raw[6] = 0
    struct.pack_into(">hhhhH", raw, 8, 10, 20, 14, 25, 3)
    struct.pack_into(">3h", raw, 64, 0, 5, 0)
    struct.pack_into(">3h", raw, 70, 0, 0, 4)
    assert archives.polygon(bytes(raw)) == [(10, 20), (10, 25), (14, 20)]


def test_incremental_run(spark, tmp_path):
    landing, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    add = lambda fov, v: spark.createDataFrame([(fov, v)], "fov string, v int").write.mode("append").parquet(landing)
    add("a", 1)
    run = lambda: process_landed(spark, landing, "fov string, v int", out, mark, lambda df: df.selectExpr("fov", "v * 2 AS v"))
    run()
    add("b", 5)
    add("a", 9)
    run()
    assert {(r.fov, r.v) for r in spark.read.parquet(out).collect()} == {("a", 2), ("b", 10)}


def test_split_cuts_after_whole_items(spark):
    items = spark.range(10).selectExpr("id AS k")
    assert planning.train_val_split(items, fraction=0.25).where("is_val").count() == 2
    assert planning.train_val_split(items.limit(1)).where("is_val").count() == 1


def test_whole_fields_lose_no_row(spark, tmp_path):
    landing, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    add = lambda fov, v: spark.createDataFrame([(fov, v)], "fov string, v int").write.mode("append").parquet(landing)
    run = lambda: process_landed(spark, landing, "fov string, v int", out, mark, lambda df: df.groupBy("fov").sum("v").withColumnRenamed("sum(v)", "v"), whole_fields=True)
    add("a", 1)
    run()
    add("a", 9)
    add("b", 5)
    run()
    assert {(r.fov, r.v) for r in spark.read.parquet(out).collect()} == {("a", 10), ("b", 5)}


def packed_bits(data):
    return b"".join(bytes([0, b]) for b in data)


def lzw(data):
    """Codes of growing width; the table starts afresh before it is full."""
    bits, table, width, word, out = [], {bytes([k]): k for k in range(256)}, 9, b"", []
    emit = lambda code: out.append(f"{code:0{width}b}")
    emit(256)
    size = 258
    for b in data:
        if word + bytes([b]) in table:
            word += bytes([b])
            continue
        emit(table[word])
        table[word + bytes([b])] = size
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        word = bytes([b])
        if size > 4000:
            emit(table[word])
            emit(256)
            table, width, size, word = {bytes([k]): k for k in range(256)}, 9, 258, b""
    if word:
        emit(table[word])
    emit(257)
    text = "".join(out)
    return bytes(int(text[k : k + 8].ljust(8, "0"), 2) for k in range(0, len(text), 8))


@pytest.mark.parametrize("kind", [5, 8, 32773])
def test_packed_strips(kind):
    import zlib

    rng = np.random.default_rng(kind)
    data = bytes(np.repeat(rng.integers(0, 256, 3000, dtype=np.uint8), rng.integers(1, 5, 3000)))
    pack = {5: lzw, 8: zlib.compress, 32773: packed_bits}[kind]
    assert tiff.UNPACK[kind](pack(data)) == data


def big_file(page, strips):
    """A big-layout file of one 16-bit page in deflated strips with differences."""
    import zlib

    diff = np.diff(page.astype(np.int64), axis=1, prepend=0).astype("<u2")
    packed = [zlib.compress(diff[r : r + strips].tobytes()) for r in range(0, len(page), strips)]
    out, offsets = bytearray(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 0)), []
    for p in packed:
        offsets.append(len(out))
        out += p
    where = {}
    for name, values in (("offsets", offsets), ("counts", [len(p) for p in packed])):
        where[name] = len(out)
        out += struct.pack(f"<{len(values)}Q", *values)
    struct.pack_into("<Q", out, 8, len(out))
    tags = [(256, 3, 1, page.shape[1]), (257, 3, 1, page.shape[0]), (258, 3, 1, 16), (259, 3, 1, 8), (273, 16, len(packed), where["offsets"] if len(packed) > 1 else offsets[0]), (277, 3, 1, 1), (279, 16, len(packed), where["counts"] if len(packed) > 1 else len(packed[0])), (317, 3, 1, 2)]
    out += struct.pack("<Q", len(tags)) + b"".join(struct.pack("<HHQQ", *t) for t in tags) + struct.pack("<Q", 0)
    return bytes(out)


def test_big_packed_files_and_pages(spark, tmp_path):
    page = (np.arange(30) ** 2 * 37 % 60000).reshape(6, 5).astype(np.uint16)
    assert (tiff.decode(big_file(page, 4)) == page).all()
    (tmp_path / "x_mc.tif").write_bytes(big_file(page, 2))
    (tmp_path / "y.tif").write_bytes(tiff.encode(np.arange(24, dtype=np.float32).reshape(2, 3, 4)))
    (tmp_path / "bad.tif").write_bytes(tiff.encode(page)[:-20])
    rows = tiff.read_pages(spark, str(tmp_path), 3).collect()
    assert {(r.fov, r.t): list(r.data) for r in rows if r.error is None} == {("x", 0): page.ravel().tolist(), ("y", 0): list(range(12)), ("y", 1): list(range(12, 24))}
    assert [r.fov for r in rows if r.error] == ["bad"]


def region_file(points):
    ys, xs = [p[0] for p in points], [p[1] for p in points]
    raw = bytearray(64 + 4 * len(points))
    raw[:4] = b"Iout"
    struct.pack_into(">hhhhH", raw, 8, min(ys), min(xs), max(ys), max(xs), len(points))
    struct.pack_into(f">{len(points)}h", raw, 64, *[x - min(xs) for x in xs])
    struct.pack_into(f">{len(points)}h", raw, 64 + 2 * len(points), *[y - min(ys) for y in ys])
    return bytes(raw)


def test_region_zips(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "A.zip", "w") as z:
        z.writestr("1.roi", region_file([(1, 1), (1, 4), (3, 4), (3, 1)]))
        z.writestr("2.roi", region_file([(0, 0), (5, 5)]))
        z.writestr("3.roi", region_file([(2, 2), (2, 9), (9, 9), (9, 2)]))
    with zipfile.ZipFile(tmp_path / "B.zip", "w") as z:
        z.writestr("1.roi", region_file([(0, 0), (0, 3), (3, 3)]))
    (tmp_path / "C.zip").write_bytes(b"junk")
    regions = archives.read_regions(spark, str(tmp_path))
    assert [r.fov for r in regions.where("error IS NOT NULL").collect()] == ["C"]
    masks, without = archives.region_masks(regions, spark.createDataFrame([("A", 6, 5)], "fov string, h int, w int"))
    want = {(y, x): 1 for y in (1, 2) for x in (1, 2, 3)} | {(y, x): 3 for y in range(2, 6) for x in range(2, 5)}
    assert {(r.y, r.x): r.label for r in masks.collect()} == want
    assert {r.fov for r in without.collect()} == {"B", "C"}


def test_names_are_paired_and_resolved(spark):
    files = [(1, "tif", "other_mc.tif"), (1, "zip", "otherRoiSet.zip"), (2, "tif", "a_mc.tif"), (2, "zip", "a_RoiSet.zip"), (2, "tif", "b_mc.tif"), (2, "zip", "RoiSet.zip")]
    got = {(r.dir, r.tif, r.zip, r.strategy) for r in planning.pair_files(spark.createDataFrame(files, "dir int, kind string, name string")).collect()}
    assert got == {(1, "other_mc.tif", "otherRoiSet.zip", "C"), (2, "a_mc.tif", "a_RoiSet.zip", "A"), (2, "b_mc.tif", "RoiSet.zip", "B")}
    known = spark.createDataFrame([("fov1",), ("fov12",), ("xfov12",), ("FOV7",), ("a.c",), ("abc",)], "fov string")
    named = lambda w: {(r.fov, r.found) for r in planning.resolve_fields(known, w).collect()}
    assert named("fov1*") == {("fov1", True), ("fov12", True)}
    assert named("FOV7_mc, zz") == {("FOV7", True), ("zz", False)}
    assert named("f?v") == {("fov1", True), ("fov12", True)} and named("a.c*") == {("a.c", True)} and named("[ax]*") == {("a.c", True), ("abc", True), ("xfov12", True)}
    assert len(named("__all__")) == 6


def test_tables_round_trip(spark, tmp_path):
    rows = [("a", 1, "GOLD", 0.5, 1, 0.25, -1.0, 0.75)]
    df = spark.createDataFrame(rows, tables.SCORED)
    tables.write_csv(df, str(tmp_path / "s"))
    assert [tuple(r) for r in tables.read_csv(spark, str(tmp_path / "s")).collect()] == rows
    (tmp_path / "d").mkdir()
    for n in ("x_mc.tif", "x_RoiSet.zip", "note.txt"):
        (tmp_path / "d" / n).write_bytes(b"1")
    assert {(r.kind, r.name) for r in tables.listing(spark, str(tmp_path / "d")).collect()} == {("tif", "x_mc.tif"), ("zip", "x_RoiSet.zip")}
    moves = planning.move_plan(spark.createDataFrame([("/in/a", "x_mc.tif", "x_RoiSet.zip", "A"), ("/out/b", "y_mc.tif", "RoiSet.zip", "B")], "dir string, tif string, zip string, strategy string"), "/in", "/to")
    assert {(r.source, r.target) for r in moves.collect()} == {("/in/a/x_mc.tif", "/to/x_mc.tif"), ("/in/a/x_RoiSet.zip", "/to/x_RoiSet.zip")}
