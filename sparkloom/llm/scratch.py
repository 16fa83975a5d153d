"""Tables in the shared folder that cut lineage and survive lost executors."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.plans.lineage import shared_folder


#: Drops the shuffle files of a query when it ends; a table that has been cut needs them no more.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Writes DataFrames as Parquet below the shared folder and rereads them.

    Intermediate tables are dropped as soon as the tables made from them are
    written; the tables a returned, lazy result still reads are kept.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def cut(self, df: DataFrame, compression: str = "zstd", by: str | None = None) -> DataFrame:
        """``df`` as a table; with ``by``, in a folder for each value of that column."""
        return self.cut_parts([df], compression, by)

    def cut_parts(self, parts: Iterable[DataFrame], compression: str = "zstd", by: str | None = None) -> DataFrame:
        """Parts of one schema as one table, written one after the other: the shuffle files of one part alone are on disk."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        for df in parts:
            schema = df.schema
            before = self.spark.conf.get(CLEANUP, "false")
            self.spark.conf.set(CLEANUP, "true")
            try:
                writer = df.write.mode("append").option("compression", compression)
                (writer.partitionBy(by) if by else writer).parquet(path)
            finally:
                self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch_path = path  # type: ignore[attr-defined]
        return out

    def drop_part(self, table: DataFrame, by: str, value: int) -> None:
        """The folder of one value of a table cut ``by`` a column."""
        self._delete(f"{table._scratch_path}/{by}={value}")  # type: ignore[attr-defined]

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path = getattr(t, "_scratch_path", None)
            if path:
                self._delete(path)

    def _delete(self, path: str) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
