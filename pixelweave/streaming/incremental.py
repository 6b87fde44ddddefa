"""A landing folder as a file stream, worked off by ``availableNow`` triggers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pixelweave.operators.planning import resume_pending
from pixelweave.sources.tables import write_by_field


def process_landed(spark: SparkSession, landing: str, schema: str, output: str, checkpoint: str, operator: Callable[[DataFrame], DataFrame], skip_done: bool = True, whole_fields: bool = False) -> None:
    """Apply ``operator`` to rows that landed since the checkpoint and write by field.

    The checkpoint remembers files, so each is read once; a batch replaces only its own
    fields, so a batch that is tried again has the same effect.  Fields that have output
    already are skipped unless told otherwise: a field's rows then must land together.
    With ``whole_fields`` a field that gets more rows later is worked out again from all
    its rows in the landing folder, so no row is lost whenever it lands.
    """

    def batch(df: DataFrame, _: int) -> None:
        if whole_fields:
            df = spark.read.schema(schema).parquet(landing).join(df.select("fov").distinct(), "fov", "left_semi")
        elif skip_done:
            try:
                done = spark.read.parquet(output)
            except Exception as e:
                if "PATH_NOT_FOUND" not in str(e):
                    raise
            else:
                df = resume_pending(df, done.select(done["fov"].cast(dict(df.dtypes)["fov"]).alias("fov")))
        write_by_field(operator(df), output)

    stream = spark.readStream.schema(schema).parquet(landing).writeStream.foreachBatch(batch)
    stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
