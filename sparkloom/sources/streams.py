"""Streaming sources: folders whose files arrive one after the other."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def text_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """line: lines of the text files of a folder, a few files in each micro-batch."""
    if folder.startswith(("/", "file:")) and not os.path.isdir(folder.removeprefix("file://")):
        raise NotADirectoryError(folder)
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder).withColumnRenamed("value", "line")


def table_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A Parquet table, file by file; its schema is read once."""
    schema = spark.read.parquet(path).schema
    glob = {"pathGlobFilter": "*.parquet"}
    folder, _, name = path.rstrip("/").rpartition("/")
    if name.endswith(".parquet") and _is_file(spark, path):
        folder, glob = folder, {"pathGlobFilter": name}
    else:
        folder = path
    return spark.readStream.schema(schema).options(maxFilesPerTrigger=files_per_batch, **glob).parquet(folder)


def _is_file(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile()
