"""Streams of rows into Parquet, in bounded micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

from loamcast.plans.write_plan import plan_write


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 8, glob: str | None = None) -> DataFrame:
    """A stream over the Parquet files of a folder; a batch takes so many files at most."""
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return (r.option("pathGlobFilter", glob) if glob else r).parquet(path)


def write_stream(stream: DataFrame, path: str, checkpoint: str, specs=(), **layout) -> None:
    """Write all that is there, batch after batch, and return; a rerun takes up what is new.

    The next batch starts only when the one before is committed, which is the backpressure.
    """
    plan = plan_write(specs, schema=stream.schema, **layout)
    if plan.custom:
        raise ValueError(f"a stream can't have: {', '.join(plan.custom)}")
    q = stream.writeStream.format("parquet").options(**plan.options).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
