"""Near-duplicate vectors through product quantisation.

Vectors are scaled by their largest component, so neither tiny nor huge ones lose their
length; equal ones (told by two 64-bit hashes) are one entry with a weight and a number of
its own.  Vectors of each length are compared among themselves.  Coarse centroids and codebooks for the
subspaces of the residuals are fitted on a bounded sample; every entry is then put into
the list of its nearest centroid with its residual's codes and the exact length of what
the codes miss.  Each entry also asks the lists of its ``probes`` nearest centroids.  In
a list the distance of a query to an entry's code is a sum of table look-ups; as the
missed length is known, a pair may be as near as wanted only if that distance is at most
the wanted one plus the missed length, so the filter loses nothing.  What passes is
compared by exact cosine in double precision.

A pair met in the lists of both its sides is counted in the smaller list only, so counts
add up without any pair being written; of links each block sends back a spanning forest.
Large lists are split into blocks of bounded size on both sides.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing, nor do vectors of different lengths; repeated rows link with each other; a null
id takes part but never names a component; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweave.deploy import ship
from pixelweave.llm.common import connected_components, discard, materialize

COSINE = 0.9
#: Lists: the square root of the number of entries, at most this many.
MAX_LISTS = 4096
#: Sample for fitting: this many entries a list, and at least LEAST_SAMPLE.
SAMPLE_PER_LIST = 40
LEAST_SAMPLE = 10_000
SUBSPACES = 16
CODEWORDS = 64
#: Lists that an entry asks at least; with many lists half the root of their number.
PROBES = 12
#: Entries and queries in a block of a list.
BLOCK = 2048


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Plain Lloyd iterations from distinct sample points; empty clusters keep theirs."""
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        some = n > 0
        centres[some] = sums[some] / n[some, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, block: int = 8192) -> np.ndarray:
    half = 0.5 * (centres**2).sum(1)
    return np.concatenate([(x[i : i + block] @ centres.T - half).argmax(1) for i in range(0, len(x), block)]) if len(x) else np.zeros(0, np.int64)


class Quantiser:
    """Coarse centroids and residual codebooks."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int = 5):
        self.centres = kmeans(sample, min(lists, len(sample)), 8, seed).astype(np.float32)
        residual = sample - self.centres[nearest(sample, self.centres)]
        parts = np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))
        self.edges = [0, *np.cumsum([len(p) for p in parts]).tolist()]
        self.books = [kmeans(residual[:, a:b], min(CODEWORDS, len(sample)), 6, seed + 1 + i).astype(np.float32) for i, (a, b) in enumerate(zip(self.edges, self.edges[1:]))]

    def probes(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n nearest lists of each row, nearest first."""
        score = 0.5 * (self.centres**2).sum(1) - x @ self.centres.T
        n = min(n, len(self.centres))
        some = np.argpartition(score, n - 1, axis=1)[:, :n]
        return np.take_along_axis(some, np.take_along_axis(score, some, 1).argsort(1, kind="stable"), 1)

    def codes(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of residuals and the length that they miss."""
        code = np.empty((len(residual), len(self.books)), np.uint8)
        missed = np.zeros(len(residual))
        for m, (book, a, b) in enumerate(zip(self.books, self.edges, self.edges[1:])):
            code[:, m] = nearest(residual[:, a:b], book)
            missed += ((residual[:, a:b] - book[code[:, m]]) ** 2).sum(1)
        return code, np.sqrt(missed)

    def distances(self, queries: np.ndarray, which: int, code: np.ndarray) -> np.ndarray:
        """Distance of each query to the coded entries of a list, by table look-up."""
        rest = queries - self.centres[which]
        total = np.zeros((len(queries), len(code)), np.float32)
        for m, (book, a, b) in enumerate(zip(self.books, self.edges, self.edges[1:])):
            part = rest[:, a:b]
            table = (part**2).sum(1)[:, None] + (book**2).sum(1)[None, :] - 2 * part @ book.T
            total += np.take(table, code[:, m], axis=1)
        return np.sqrt(np.maximum(total, 0))


def _unit(raw: np.ndarray) -> np.ndarray:
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _index(model, dim: int, probes: int):
    def run(batches):
        q: Quantiser = model.value
        for batch in batches:
            x = _unit(_matrix(batch.column(2), dim))
            own = q.probes(x.astype(np.float32), probes)
            code, missed = q.codes((x - q.centres[own[:, 0]]).astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(own.astype(np.int32).tolist(), pa.list_(pa.int32())), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(missed + 1e-5)],
                names=["rep", "weight", "vector", "probes", "code", "missed"],
            )

    return run


def _compare(model, radius: float, cosine: float):
    """One block of queries against one block of a list's entries."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        q: Quantiser = model.value
        which = int(pdf["list"].iloc[0])
        entry, query = pdf[pdf["is_entry"]], pdf[~pdf["is_entry"]]
        if not len(entry) or not len(query):
            return _found([], [], [], [])
        xs, qs = np.stack([np.frombuffer(v) for v in entry["vector"]]), np.stack([np.frombuffer(v) for v in query["vector"]])
        code = np.stack([np.frombuffer(c, np.uint8) for c in entry["code"]])
        xr, qr = entry["rep"].to_numpy(), query["rep"].to_numpy()
        xw, qw = entry["weight"].to_numpy(), query["weight"].to_numpy()
        home = np.array([p[0] for p in query["probes"]])
        asked = {h: np.array([h in p for p in entry["probes"]]) for h in np.unique(home) if h != which}
        missed = entry["missed"].to_numpy()
        links_x, links_q = np.zeros(len(xr), np.int64), np.zeros(len(qr), np.int64)
        parent = {}

        def root(v):
            while parent.setdefault(v, v) != v:
                parent[v] = parent[parent[v]]
                v = parent[v]
            return v

        for lo in range(0, len(qr), 256):
            rows = slice(lo, lo + 256)
            maybe = q.distances(qs[rows].astype(np.float32), which, code) <= radius + missed[None, :]
            if maybe.mean() > 0.02:
                hit = maybe & (qs[rows] @ xs.T >= cosine)
            else:
                hit = np.zeros(maybe.shape, bool)
                i, j = np.nonzero(maybe)
                hit[i, j] = np.einsum("ij,ij->i", qs[lo + i], xs[j]) >= cosine
            i, j = np.nonzero(hit)
            i = i + lo
            once = qr[i] != xr[j]
            same_list = home[i] == which
            once &= ~same_list | (qr[i] < xr[j])
            for h in np.unique(home[i]):
                if h != which and h < which:
                    once &= ~((home[i] == h) & asked[h][j])
            i, j = i[once], j[once]
            np.add.at(links_q, i, xw[j])
            np.add.at(links_x, j, qw[i])
            for a, b in zip(qr[i].tolist(), xr[j].tolist()) if len(i) < 4096 else _few(qr[i], xr[j]):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        tree = [(v, root(v)) for v in parent]
        tree = [(a, b) for a, b in tree if a != b]
        reps, links = np.concatenate([qr, xr]), np.concatenate([links_q, links_x])
        some = links > 0
        return _found(reps[some], links[some], [a for a, _ in tree], [b for _, b in tree])

    return run


def _found(reps, links, a, b) -> pd.DataFrame:
    """Counts of links and, marked as edges, a spanning forest; ids stay integers."""
    whole = lambda *parts: np.concatenate([np.asarray(p, np.int64) for p in parts])
    return pd.DataFrame({"rep": whole(reps, a), "links": whole(links, np.zeros(len(a))), "other": whole(np.zeros(len(reps)), b), "edge": np.arange(len(reps) + len(a)) >= len(reps)})


def _few(a: np.ndarray, b: np.ndarray):
    """A spanning set of many links: label by least neighbour until nothing changes."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return zip(nodes[moved].tolist(), nodes[label[moved]].tolist())


def vector_groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, probes: int | None = None) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    ``probes`` are the lists that an entry asks; None lets them follow the number of lists.
    """
    spark = vectors.sparkSession
    ship(spark)
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.withColumn("most", F.when(v.isNotNull() & finite, F.array_max(F.transform(v, F.abs))))
    rows = rows.withColumn("sound", F.coalesce(F.col("most") > 0, F.lit(False)))
    scaled = F.when(F.col("sound"), F.transform(v, lambda c: c / F.col("most")))
    rows = materialize(rows.select("vec_id", "sound", scaled.alias("v")), "vectors")
    keyed = rows.where("sound").select("vec_id", F.size("v").alias("dim"), F.xxhash64("v").alias("key"), F.xxhash64(F.lit(1), "v").alias("key2"), "v")
    entries = keyed.groupBy("dim", "key", "key2").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least_id"), F.first("v").alias("v"))
    entries = materialize(entries.withColumn("rep", F.monotonically_increasing_id()), "vector-entries")
    counts = parts = None
    for dim, n in sorted(tuple(r) for r in entries.groupBy("dim").count().where("count > 1").collect()):
        found = _links(entries.where(F.col("dim") == dim), dim, n, cosine, probes)
        counts = found if counts is None else counts.unionByName(found)
    if counts is not None:
        edges = counts.where("edge").select(F.col("rep").alias("a"), F.col("other").alias("b"))
        parts = connected_components(edges, "vector").withColumnsRenamed({"node": "rep", "component": "root"})
        links = counts.where("NOT edge").groupBy("rep").agg(F.sum("links").alias("links"))
        rooted = entries.drop("v").join(parts, "rep", "left").withColumn("root", F.coalesce("root", "rep")).join(links, "rep", "left")
    else:
        rooted = entries.drop("v").select("*", F.col("rep").alias("root"), F.lit(0).cast("long").alias("links"))
    rooted = materialize(rooted, "vector-rooted")
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = rooted.join(least, "root").select("dim", "key", "key2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    out = keyed.drop("v").join(named, ["dim", "key", "key2"]).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
    alone = rows.where("NOT sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(alone)


def _links(entries: DataFrame, dim: int, n: int, cosine: float, probes: int | None) -> DataFrame:
    """``(rep, links, other, edge)``: links of the entries of one length, counted, and a
    spanning forest of them."""
    spark = entries.sparkSession
    lists = max(1, min(MAX_LISTS, int(n**0.5)))
    probes = probes or max(PROBES, int(0.5 * lists**0.5))
    sample = entries.orderBy(F.xxhash64("key", "key2"), "rep").limit(max(LEAST_SAMPLE, SAMPLE_PER_LIST * lists)).select("v").toArrow().column("v").combine_chunks()
    fitted = Quantiser(_unit(_matrix(sample, dim)).astype(np.float32), lists)
    model = spark.sparkContext.broadcast(fitted)
    schema = "rep long, weight long, vector binary, probes array<int>, code binary, missed double"
    indexed = materialize(entries.select("rep", "weight", "v").mapInArrow(_index(model, dim, probes), schema), "vector-index")
    asked = indexed.select(F.explode("probes").alias("list"), *indexed.columns)
    entry_sizes = indexed.groupBy(F.col("probes")[0].alias("list")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("xb"))
    query_sizes = asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("qb"))
    blocks = F.broadcast(entry_sizes.join(query_sizes, "list").where(F.col("list") < MAX_LISTS).select("list", F.col("xb").cast("int"), F.col("qb").cast("int")))
    spot = lambda c: F.pmod(F.xxhash64("rep", F.lit(c)), F.col(c)).cast("int")
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    cols = ["list", "rep", "weight", "vector", "probes", "code", "missed"]
    as_entry = indexed.withColumn("list", F.col("probes")[0]).join(blocks, "list").withColumn("x", spot("xb")).select(*cols, "x", upto("qb").alias("q"), F.lit(True).alias("is_entry"))
    as_query = asked.join(blocks, "list").withColumn("q", spot("qb")).select(*[c if c not in ("code", "missed") else F.lit(None).cast(dict(indexed.dtypes)[c]).alias(c) for c in cols], upto("xb").alias("x"), "q", F.lit(False).alias("is_entry"))
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    both = as_entry.unionByName(as_query)
    found = materialize(both.groupBy("list", "x", "q").applyInPandas(_compare(model, radius, cosine), "rep long, links long, other long, edge boolean"), "vector-links")
    model.destroy()
    discard(indexed)
    return found
