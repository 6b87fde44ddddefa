"""Operators over listings of files, fields of view, images and losses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def pair_files(files: DataFrame) -> DataFrame:
    """Pair stacks with polygon archives in each directory: ``(dir, tif, zip, strategy)``.

    A: equal names before ``_mc.tif`` and ``_RoiSet.zip``.  B: exactly one ``RoiSet.zip`` and one left-over stack.  C: one
    left-over of each.  ``files`` is ``(dir, kind, name)`` with kinds ``tif`` and ``zip``.
    """
    tif = files.where("kind = 'tif'").select("dir", F.col("name").alias("tif"), F.replace("name", F.lit("_mc.tif"), F.lit("")).alias("base"))
    archive = files.where("kind = 'zip'").select("dir", F.col("name").alias("zip"), F.replace("name", F.lit("_RoiSet.zip"), F.lit("")).alias("base"))
    last = lambda df, c: df.groupBy("dir", "base").agg(F.max(c).alias(c))
    a = last(tif, "tif").join(last(archive, "zip"), ["dir", "base"]).select("dir", "tif", "zip", F.lit("A").alias("strategy"))
    tif_left = tif.join(a, ["dir", "tif"], "left_anti")
    zip_left = archive.join(a, ["dir", "zip"], "left_anti")
    alone = tif_left.groupBy("dir").agg(F.max("tif").alias("tif"), F.count(F.lit(1)).alias("n")).where("n = 1")
    bare = zip_left.where("zip = 'RoiSet.zip'").groupBy("dir").agg(F.max("zip").alias("zip"), F.count(F.lit(1)).alias("m")).where("m = 1")
    b = alone.join(bare, "dir").select("dir", "tif", "zip", F.lit("B").alias("strategy"))
    rest = zip_left.groupBy("dir").agg(F.max("zip").alias("zip"), F.count(F.lit(1)).alias("m")).where("m = 1")
    c = alone.join(rest, "dir").join(b, "dir", "left_anti").select("dir", "tif", "zip", F.lit("C").alias("strategy"))
    return a.unionByName(b).unionByName(c)


def session_files(paths: DataFrame, root: str) -> DataFrame:
    """Stacks and polygon archives ``(dir, kind, name)`` among the paths of a tree
    ``root/animal/session/file``, or in folders ``PRE Files`` below a session.

    Animals whose name starts with a dot are left out.  A listing shows no symbolic links,
    so these must be left out where it is made.
    """
    quoted = "".join(c if c.isalnum() or c in "/_" else "\\" + c for c in root.rstrip("/"))
    inside = F.col("path").rlike(f"^{quoted}/(?!\\.)[^/]+/[^/]+(/PRE Files)*/[^/]+$")
    kind = F.when(F.col("name").endswith("_mc.tif"), "tif").when(F.col("name").endswith("RoiSet.zip"), "zip")
    parts = paths.where(inside).select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"))
    return parts.select("dir", kind.alias("kind"), "name").where("kind IS NOT NULL")


def pairing_report(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("strategy").agg(F.count(F.lit(1)).alias("n"))


def collisions(files: DataFrame) -> DataFrame:
    """Destination names that more than one directory would write, with the sources."""
    return files.groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("dir")).alias("dirs")).where("n > 1")


def move_plan(pairs: DataFrame, source_root: str, target_root: str) -> DataFrame:
    """Moves that a pairing implies; only sources under the root; nothing is moved here."""
    each = pairs.select("dir", F.explode(F.array("tif", "zip")).alias("name"))
    return each.where(F.col("dir").cast("string").startswith(source_root)).select(F.concat_ws("/", "dir", "name").alias("source"), F.concat_ws("/", F.lit(target_root), "name").alias("target"))


def resolve_fields(known: DataFrame, wanted: str) -> DataFrame:
    """Fields named by ``__all__``, a comma list of globs and names; distinct, with a flag.

    A glob matches the start of a field's stack name, up to its ``_mc``; a name may bear
    ``_mc`` itself.  Names that no field matches come back with ``found`` false.
    """
    names = known.select("fov").distinct()
    if wanted == "__all__":
        return names.select("fov", F.lit(True).alias("found"))
    parts = [p.strip() for p in wanted.split(",")]
    globs = [p for p in parts if "*" in p or "?" in p]
    plain = [n for n in dict.fromkeys(p.replace("_mc", "") for p in parts if p not in globs) if n]
    test = F.col("fov").isin(*plain) if plain else F.lit(False)
    for g in globs:
        test = test | F.concat("fov", F.lit("_mc.tif")).rlike(glob_pattern(g + "*_mc.tif"))
    hits = names.where(test).select("fov", F.lit(True).alias("found"))
    if not plain:
        return hits
    asked = known.sparkSession.createDataFrame([(p,) for p in plain], "fov string")
    return hits.unionByName(asked.join(names, "fov", "left_anti").select("fov", F.lit(False).alias("found")))


def glob_pattern(glob: str) -> str:
    """A whole-name expression for ``*``, ``?`` and ``[...]``."""
    out, at = "", 0
    while at < len(glob):
        c = glob[at]
        end = glob.find("]", at + 2) if c == "[" else -1
        if end > 0:
            inner = glob[at + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]"
            at = end
        else:
            out += {"*": ".*", "?": "."}.get(c, c if c.isalnum() or c == "_" or ord(c) > 127 else "\\" + c)
        at += 1
    return "(?s)^" + out + "\\z"


def validate_dataset(masks: DataFrame, images: DataFrame) -> DataFrame:
    """Issue per mask: no image, another shape, empty; null where all is well.

    ``masks``: ``(name, h, w, n_labels)``; ``images``: ``(name, h, w)``.
    """
    other = images.select("name", F.col("h").alias("ih"), F.col("w").alias("iw"))
    issue = F.when(F.col("ih").isNull(), "no image").when((F.col("h") != F.col("ih")) | (F.col("w") != F.col("iw")), "shape").when(F.col("n_labels") == 0, "empty")
    return masks.join(other, "name", "left").select("name", issue.alias("issue"), (F.col("ih").isNotNull() & (F.col("n_labels") > 0)).alias("is_pair"))


def complete_fields(activity: DataFrame, anatomy: DataFrame, rasters: DataFrame) -> DataFrame:
    """Fields with all three inputs in both passes, equal frames and a mean raster."""
    out = activity.join(anatomy, ["fov", "ly", "lx"], "left_semi")
    return out.join(rasters.where("kind = 'mean'").select("fov").distinct(), "fov", "left_semi").select("fov", "ly", "lx")


def first_candidate(rasters: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Per field the raster name that comes first in the order of preference."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("suffix"))
    ranked = rasters.where(rank > 0).withColumn("k", F.row_number().over(Window.partitionBy("fov").orderBy(rank)))
    return ranked.where("k = 1").drop("k")


def prefix_match(masks: DataFrame, stacks: DataFrame) -> DataFrame:
    """Each mask with the first stack, by path, whose name starts with the mask's stem."""
    stems = masks.select("stem").distinct()
    starts = stacks.select("path", F.explode(F.sequence(F.lit(0), F.length("path"))).alias("n")).join(stems.select(F.length("stem").alias("n")).distinct(), "n")
    first = starts.groupBy(F.expr("substring(path, 1, n)").alias("stem")).agg(F.min("path").alias("path"))
    return stems.join(first, "stem", "left").select("stem", "path")


def image_mask_pairs(masks: DataFrame, images: DataFrame) -> DataFrame:
    """Masks with each projection of theirs that exists, and a flag for those missing."""
    wanted = masks.select("fov", F.explode(F.array(F.lit("mean"), F.lit("max"))).alias("proj"))
    return wanted.join(images.select("fov", "proj", F.lit(True).alias("have")), ["fov", "proj"], "left").select("fov", "proj", F.coalesce("have", F.lit(False)).alias("present"))


def train_val_split(items: DataFrame, key: str = "k", fraction: float = 0.15, seed: int = 0) -> DataFrame:
    """Seeded order of all items, the first ``max(1, int(n * fraction))`` for validation.

    The order is that of a portable integer hash, so any engine splits alike.  Only the
    4,096 counts by range of hashes reach the driver, and one range is put in order.
    """
    hashed = items.select(key, F.pmod((F.col(key) + seed) * F.lit(2654435761), F.lit(4294967296)).alias("h"))
    # the hash under which the last chosen item falls, from counts by range of hashes
    counts = {r["r"]: r["n"] for r in hashed.groupBy(F.shiftright("h", 20).alias("r")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n_val = max(1, int(sum(counts.values()) * fraction))
    full, before = 0, 0
    for full in sorted(counts):
        if before + counts[full] >= n_val:
            break
        before += counts[full]
    edge = hashed.where(F.shiftright("h", 20) == full).withColumn("place", F.row_number().over(Window.partitionBy(F.shiftright("h", 20)).orderBy("h", key)))
    chosen = edge.where(F.col("place") <= n_val - before).select(key, F.lit(True).alias("chosen"))
    out = hashed.join(chosen, key, "left")
    return out.select(key, ((F.shiftright("h", 20) < full) | F.coalesce("chosen", F.lit(False))).alias("is_val"))


def best_checkpoint(losses: DataFrame) -> DataFrame:
    """Epoch of the least recorded (positive) loss, the earliest of ties."""
    return losses.where("loss > 0").agg(F.min(F.struct("loss", "epoch")).alias("b")).select(F.col("b.epoch").alias("epoch"), F.col("b.loss").alias("loss"))


def resume_pending(wanted: DataFrame, done: DataFrame, key: str = "fov") -> DataFrame:
    """Inputs that have no output yet."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")


def batch_status(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
