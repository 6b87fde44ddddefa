"""Written tables in the shared folder, to compute once what is read several times."""

from __future__ import annotations

import itertools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_serial = itertools.count()
_run = uuid.uuid4().hex[:12]


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    ``spark.checkpoint.dir`` wins.  Where it is unset, local mode gets a temporary folder;
    a cluster, whose machines do not share one, is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tables-{_run}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` itself if it is a scratch table, else written as one."""
    return df if getattr(df, "scratch_path", None) else materialize(df, tag)


def clear(spark: SparkSession) -> None:
    """Delete all scratch tables of this process; results that read them must be written."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Unlike ``checkpoint()`` this computes the rows once, prunes columns on later reads
    and gives exact sizes to the optimizer.  The lineage ends at the files, so later
    plans stay small and a lost executor costs a task.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{next(_serial):05d}-{tag}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more."""
    for df in frames:
        path = getattr(df, "scratch_path", None)
        if path:
            spark = df.sparkSession
            jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
