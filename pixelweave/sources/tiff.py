"""TIFF stacks: 8- or 16-bit unsigned or 32-bit float samples, one sample a pixel, in
strips that are plain, packed (PackBits, LZW) or deflated, classic or big files.

Pages are frames.  Small files come whole through Spark's binary reader, one file to a
task row; ``read_pages`` reads headers and then single pages by byte range, so a stack of
any size is spread over tasks.  Files that cannot be read give a row with an error
instead of failing the job.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.deploy import ship

#: Tag numbers, field sizes and compressions of the format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS, PREDICTOR, FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 317, 339
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 16: 8}
CODES = {1: "B", 3: "H", 4: "I", 16: "Q"}
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
PATTERNS = "*.{tif,tiff,TIF,TIFF}"
BAD = (ValueError, KeyError, IndexError, OSError, struct.error, zlib.error)


def _directories(raw) -> Iterator[tuple[str, dict[int, tuple]]]:
    """Byte order and tags of every page; ``raw`` is anything that gives byte slices."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(raw[:2]))
    number = lambda code, at: struct.unpack(order + code, raw[at : at + struct.calcsize(order + code)])[0]
    version = number("H", 2) if order else 0
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    link, count, entry, inline = ("I", "H", 12, 4) if version == 42 else ("Q", "Q", 20, 8)
    at, seen = number(link, 4 if version == 42 else 8), set()
    while at and at not in seen:
        seen.add(at)
        n, first = number(count, at), at + struct.calcsize("<" + count)
        if n > 1 << 16:
            raise ValueError("damaged directory")
        tags = {}
        block = raw[first : first + entry * n]
        for k in range(n):
            tag, kind, values = struct.unpack_from(order + "HH" + link, block, entry * k)
            if kind in CODES:
                size = SIZES[kind] * values
                place = block[entry * (k + 1) - inline : entry * (k + 1)]
                data = place[:size] if size <= inline else raw[(start := struct.unpack(order + link, place)[0]) : start + size]
                tags[tag] = struct.unpack(f"{order}{values}{CODES[kind]}", data)
        yield order, tags
        at = number(link, first + entry * n)


def _unpacked_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            out += data[at + 1 : at + 2] * (257 - n) if n > 128 else b""
            at += 2 if n > 128 else 1
    return bytes(out)


def _unpacked_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, highest bit first; 256 starts afresh and 257 ends."""
    out, table, bits, held, width, last = bytearray(), [], 0, 0, 9, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & (1 << bits) - 1
        if code == 257:
            break
        if code == 256 or not table:
            table, width, last = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
            if code == 256:
                continue
        word = table[code] if code < len(table) else last + last[:1]
        out += word
        if last:
            table.append(last + word[:1])
        last = word
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


UNPACK = {PLAIN: bytes, LZW: _unpacked_lzw, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress, PACKBITS: _unpacked_bits}


def _page(raw, order: str, tags: dict[int, tuple]) -> np.ndarray:
    unpack = UNPACK.get(tags.get(COMPRESSION, (1,))[0])
    if unpack is None or tags.get(SAMPLES, (1,))[0] != 1:
        raise ValueError("this compression or several samples are not supported")
    kind = {(8, 1): "u1", (16, 1): "u2", (32, 3): "f4"}.get((tags[BITS][0], tags.get(FORMAT, (1,))[0]))
    predictor = tags.get(PREDICTOR, (1,))[0]
    if kind is None or predictor not in (1, 2) or (predictor == 2 and kind == "f4"):
        raise ValueError("sample type is not supported")
    data = b"".join(unpack(raw[o : o + c]) for o, c in zip(tags[OFFSETS], tags[COUNTS]))
    h, w = tags[HEIGHT][0], tags[WIDTH][0]
    page = np.frombuffer(data, order + kind, h * w).reshape(h, w)
    return np.cumsum(page, axis=1, dtype=page.dtype.newbyteorder("=")) if predictor == 2 else page


class Ranges:
    """Byte slices of a file in any store that pyarrow can open."""

    def __init__(self, path: str):
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)
        self.file = store.open_input_file(inner)

    def __getitem__(self, part: slice) -> bytes:
        start = part.start or 0
        return self.file.read_at(part.stop - start, start)


def decode(raw: bytes) -> np.ndarray:
    """All pages as frames x height x width."""
    return np.stack([_page(raw, order, tags) for order, tags in _directories(raw)])


def shape_of(raw: bytes) -> tuple[int, int, int]:
    """Frames, height, width from the headers alone."""
    sizes = [(t[HEIGHT][0], t[WIDTH][0]) for _, t in _directories(raw)]
    if len(set(sizes)) > 1:
        raise ValueError("pages differ in size")
    return (len(sizes), *sizes[0])


def encode(frames: np.ndarray) -> bytes:
    """Frames as one little-endian file; a 2-D array is one frame."""
    frames = frames[None] if frames.ndim == 2 else frames
    bits, fmt = {"uint8": (8, 1), "uint16": (16, 1), "float32": (32, 3)}[frames.dtype.name]
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for frame in frames:
        data = frame.astype(frame.dtype.newbyteorder("<")).tobytes()
        start = len(out)
        out += data + b"\0" * (len(data) % 2)
        h, w = frame.shape
        tags = [(WIDTH, 4, w), (HEIGHT, 4, h), (BITS, 3, bits), (COMPRESSION, 3, 1), (PHOTOMETRIC, 3, 1), (OFFSETS, 4, start), (SAMPLES, 3, 1), (ROWS, 4, h), (COUNTS, 4, len(data)), (FORMAT, 3, fmt)]
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def discover(spark: SparkSession, root: str) -> DataFrame:
    """Paths below ``root`` with a stack's suffix, distinct and in order; mixed-case
    suffixes do not count.  A missing root is an error.  Archives are unpacked before by
    ``archives.extract_all``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", PATTERNS).load(root)
    return files.select("path").distinct().orderBy("path")


def read_stacks(spark: SparkSession, root: str) -> DataFrame:
    """``(path, fov, t, h, w, data array<float>, error)``; a bad file gives one error row."""
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", PATTERNS).load(root).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, raw in zip(pdf["path"], pdf["content"]):
                fov = os.path.splitext(os.path.basename(path))[0].replace("_mc", "")
                try:
                    for t, (order, tags) in enumerate(_directories(raw)):
                        page = _page(raw, order, tags).astype(np.float32)
                        yield pd.DataFrame({"path": [path], "fov": [fov], "t": [t], "h": [page.shape[0]], "w": [page.shape[1]], "data": [page.ravel()], "error": [None]})
                except BAD as e:
                    yield pd.DataFrame({"path": [path], "fov": [fov], "t": [None], "h": [None], "w": [None], "data": [None], "error": [str(e)]})

    return files.mapInPandas(run, "path string, fov string, t int, h int, w int, data array<float>, error string")


def validate(spark: SparkSession, root: str) -> DataFrame:
    """``(path, fov, frames, h, w, error)`` from headers; a single page is an error."""
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", PATTERNS).load(root).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, raw in zip(pdf["path"], pdf["content"]):
                fov = os.path.splitext(os.path.basename(path))[0].replace("_mc", "")
                try:
                    n, h, w = shape_of(raw)
                    rows.append((path, fov, n, h, w, None if n > 1 else "not three-dimensional"))
                except BAD as e:
                    rows.append((path, fov, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "fov", "frames", "h", "w", "error"])

    return files.mapInPandas(run, "path string, fov string, frames int, h int, w int, error string")


def read_pages(spark: SparkSession, root: str, tasks: int | None = None) -> DataFrame:
    """Like ``read_stacks``, for stacks of any size: headers first, then single pages by
    byte range in as many tasks as wanted.  The store must be one that pyarrow opens."""
    ship(spark)
    paths = discover(spark, root)

    def headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["path"]:
                rows = []
                try:
                    for t, (order, tags) in enumerate(_directories(Ranges(path))):
                        flat = [x for tag, values in tags.items() for x in (tag, len(values), *values)]
                        rows.append((path, t, order, flat, None))
                except BAD as e:
                    rows.append((path, None, None, None, str(e)))
                yield pd.DataFrame(rows, columns=["path", "t", "order", "tags", "error"])

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, t, order, flat, error in pdf.itertuples(index=False):
                fov = os.path.splitext(os.path.basename(path))[0].replace("_mc", "")
                row = {"path": path, "fov": fov, "t": None, "h": None, "w": None, "data": None, "error": error}
                if error is None:
                    try:
                        tags, at = {}, 0
                        while at < len(flat):
                            tags[flat[at]] = tuple(int(x) for x in flat[at + 2 : at + 2 + flat[at + 1]])
                            at += 2 + flat[at + 1]
                        page = _page(Ranges(path), order, tags).astype(np.float32)
                        row |= {"t": int(t), "h": page.shape[0], "w": page.shape[1], "data": page.ravel()}
                    except BAD as e:
                        row["error"] = str(e)
                yield pd.DataFrame([row])

    every = paths.mapInPandas(headers, "path string, t int, order string, tags array<long>, error string")
    dealt = every.repartition(*([tasks] if tasks else []), "path", "t")
    return dealt.mapInPandas(pages, "path string, fov string, t int, h int, w int, data array<float>, error string")


def _store(path: str, data: bytes) -> None:
    """Write a file under another name first, then give it its own."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)
    store.create_dir(os.path.dirname(inner), recursive=True)
    with store.open_output_stream(inner + ".part") as f:
        f.write(data)
    store.move(inner + ".part", inner)


def _write_fields(values: DataFrame, frames: DataFrame, folder: str, suffix: str, kind: str) -> DataFrame:
    spark = frames.sparkSession
    if ":" not in folder.split("/")[0] and not spark.sparkContext.master.startswith("local"):
        raise ValueError("on a cluster the folder must name its store, as in hdfs://host/folder")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fov, h, w = pdf["fov"].iloc[0], int(pdf["h"].iloc[0]), int(pdf["w"].iloc[0])
        own = pdf[pdf["v"].notna()]
        if kind == "uint16" and len(own) and own["v"].max() > 65535:
            raise OverflowError("more than 65,535 labels in a field of view")
        grid = np.zeros((h, w), kind)
        grid[own["y"].astype(int), own["x"].astype(int)] = own["v"].astype(kind)
        path = f"{folder.rstrip('/')}/{fov}{suffix}.tif"
        _store(path, encode(grid))
        return pd.DataFrame({"fov": [str(fov)], "path": [path], "n": [int(own["v"].nunique())]})

    ship(spark)
    return frames.select("fov", "h", "w").join(values.select("fov", "y", "x", "v"), "fov", "left").groupBy("fov").applyInPandas(run, "fov string, path string, n int")


def write_labels(mask: DataFrame, frames: DataFrame, folder: str, suffix: str = "_masks") -> DataFrame:
    """One 16-bit file per field of view below ``folder``; returns ``(fov, path, n)``.

    ``frames`` is ``(fov, h, w)``.  Labels above 65,535 are an error.  Files appear under
    their name when they are whole, so a task that is tried again does no harm.
    """
    return _write_fields(mask.withColumnRenamed("label", "v"), frames, folder, suffix, "uint16")


def write_rasters(raster: DataFrame, frames: DataFrame, folder: str, suffix: str) -> DataFrame:
    """One 32-bit float file per field of view, like ``write_labels``; gaps are zero."""
    return _write_fields(raster, frames, folder, suffix, "float32")


def raster_pixels(stacks: DataFrame) -> DataFrame:
    """First frames as dense rasters: ``(fov, y, x, v)``."""
    values = stacks.where("t = 0").select("fov", "w", F.posexplode("data").alias("pos", "v"))
    return values.select("fov", F.floor(F.col("pos") / F.col("w")).cast("int").alias("y"), (F.col("pos") % F.col("w")).cast("int").alias("x"), F.col("v").cast("double").alias("v"))


def label_pixels(stacks: DataFrame) -> DataFrame:
    """First frames read as label rasters: ``(fov, y, x, label)`` without background."""
    return raster_pixels(stacks).where("v > 0").select("fov", "y", "x", F.col("v").cast("int").alias("label"))
