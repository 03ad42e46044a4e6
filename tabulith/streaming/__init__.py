"""Incremental runs: Structured Streaming over files that arrive, with last-write-wins results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Step = Callable[[DataFrame], DataFrame]


def ingest(spark: SparkSession, source: str, schema: str, checkpoint: str, target: str, step: Step | None = None, files_a_batch: int = 1000, name_filter: str | None = None) -> None:
    """Read the Parquet files below source that no earlier run has read, apply step, append to target, and stop.

    The checkpoint knows which files are done, so a run that died or a later run continues there;
    batches are files_a_batch files, which bounds what is in flight.
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    rows = reader.parquet(source)
    query = (step(rows) if step else rows).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def upsert_stream(spark: SparkSession, source: str, schema: str, checkpoint: str, target: str, step: Step, merge: Step, files_a_batch: int = 1000) -> None:
    """Last-write-wins in increments: each batch's facts are appended under their batch, and merge gives the next version of the state from all of them.

    Facts are immutable and a batch that is run again overwrites its own folder, so a lost executor
    or driver can't count twice.
    """

    def store(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{target}/facts/batch={number}")

    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch)
    query = reader.parquet(source).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    done = versions(spark, target)
    merge(spark.read.parquet(f"{target}/facts")).write.mode("overwrite").parquet(f"{target}/state-{max(done, default=-1) + 1}")


def versions(spark: SparkSession, target: str) -> list[int]:
    """The versions of a state that were written to the end."""
    marks = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/state-*/_SUCCESS")
    found = marks.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(marks) or []
    return sorted(int(f.getPath().getParent().getName().removeprefix("state-")) for f in found)


def state(spark: SparkSession, target: str) -> DataFrame:
    """The last whole version of the state of ``upsert_stream``; a run that dies while it writes one leaves the version before."""
    return spark.read.parquet(f"{target}/state-{versions(spark, target)[-1]}")
