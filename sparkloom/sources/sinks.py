"""Writers; all replace what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_text(df: DataFrame, path: str, sep: str = "\t") -> None:
    """Delimited lines."""
    df.write.mode("overwrite").csv(path, sep=sep, emptyValue="")


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parquet, one folder for each value where partition columns are given."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_sorted(df: DataFrame, path: str, key: str, partitions: int) -> None:
    """Parquet dealt by the key's hash and sorted within files, so that a lookup skips row groups."""
    df.repartition(partitions, key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def write_tuples(df: DataFrame, path: str) -> None:
    """Lines '(a,b,...)'."""
    row = F.concat(F.lit("("), F.concat_ws(",", *[F.col(c).cast("string") for c in df.columns]), F.lit(")"))
    df.select(row.alias("value")).write.mode("overwrite").text(path)


def show_rows(df: DataFrame) -> None:
    """Prints the rows one by one as they come."""
    for row in df.toLocalIterator():
        print("(" + ",".join(str(x) for x in row) + ")")


def snapshots(path: str):
    """For foreachBatch: each batch becomes a folder part-NNNNNNNN."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/part-{batch:08d}")

    return write
