"""Running streams: files that arrive in order, sinks by batch, restarts, counters, stops after some batches."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: For foreachBatch.
Write = Callable[[DataFrame, int], None]


def replay(table: DataFrame, ts: str, folder: str, days: list[int]) -> None:
    """Adds a table to a folder as files in the order of time: one write for each span of days of the month."""
    for lo, hi in zip(days, days[1:], strict=False):
        table.where((F.dayofmonth(ts) >= lo) & (F.dayofmonth(ts) < hi)).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.02)  # files are taken by their times of change


def file_stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def latest_windows(path: str) -> Write:
    """For streams in update mode: each batch's windows in a folder of its own, with the batch's number."""

    def write(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{path}/part-{batch:08d}")

    return write


def read_latest(spark: SparkSession, path: str, keys: list[str], value: str) -> DataFrame:
    """The last value that any batch has written for the keys."""
    rows = spark.read.parquet(f"{path}/part-*")
    return rows.groupBy(*keys).agg(F.max_by(value, "batch").alias(value))


class Counter:
    """For foreachBatch: counts batches and their rows on the driver, one number a batch, and passes them on."""

    def __init__(self, then: Write | None = None) -> None:
        self.batches = self.rows = 0
        self.then = then

    def __call__(self, df: DataFrame, batch: int) -> None:
        df = df.persist()
        try:
            self.rows += df.count()
            self.batches += 1
            if self.then:
                self.then(df, batch)
        finally:
            df.unpersist()


def run_batches(stream: DataFrame, write: Write, checkpoint: str, mode: str = "append", timeout: int = 300) -> None:
    """Runs a stream over what its source has; the same checkpoint goes on where the last run ended."""
    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        if not query.awaitTermination(timeout):
            raise TimeoutError("the stream did not end")
    finally:
        query.stop()


def run_some(stream: DataFrame, write: Write, checkpoint: str, batches: int, mode: str = "append", timeout: int = 300) -> None:
    """Runs a stream until so many batches have been written, and stops it; later batches leave no trace.

    A batch that begins too late is refused, so it is not committed to the checkpoint unread: a restart takes it up again.
    """
    done, refused = 0, False

    def counted(df: DataFrame, batch: int) -> None:
        nonlocal done, refused
        if done >= batches:
            refused = True
            raise StopIteration(f"{batches} batches are written")
        write(df, batch)
        done += 1

    query = stream.writeStream.foreachBatch(counted).outputMode(mode).option("checkpointLocation", checkpoint).start()
    end = time.time() + timeout
    try:
        while done < batches and query.isActive:
            if time.time() > end:
                raise TimeoutError("the batches did not come")
            query.awaitTermination(1)
        if query.exception():
            raise query.exception()
    except StreamingQueryException:
        if not refused:
            raise
    finally:
        query.stop()
