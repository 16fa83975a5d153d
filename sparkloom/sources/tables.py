"""Readers: Parquet and delimited tables, text lines, features, models, graphs, trips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the delimited tables, in file order; a closing delimiter makes one more, empty column.
TBL_SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz, l_commitdate string, "
    "l_receiptdate string, l_shipinstruct string, l_shipmode string, l_comment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
    "o_orderpriority string, o_clerk string, o_shippriority int, o_comment string",
    "customer": "c_custkey bigint, c_name string, c_address string, c_nationkey int, c_phone string, c_acctbal double, c_mktsegment string, c_comment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int, n_comment string",
    "part": "p_partkey bigint, p_name string, p_mfgr string, p_brand string, p_type string, p_size int, p_container string, p_retailprice double, p_comment string",
    "supplier": "s_suppkey bigint, s_name string, s_address string, s_nationkey int, s_phone string, s_acctbal double, s_comment string",
}


def load_table(spark: SparkSession, folder: str, name: str, fmt: str = "parquet") -> DataFrame:
    """A table as Parquet, or as delimited text where fmt is 'text'."""
    if fmt != "text":
        return spark.read.parquet(f"{folder}/{name}.parquet")
    schema = TBL_SCHEMAS[name] + ", _rest string"
    table = spark.read.csv(f"{folder}/{name}.tbl", sep="|", schema=schema, ignoreTrailingWhiteSpace=True)
    return table.drop("_rest")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """line: the lines of text files."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def labelled_features(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, label, features (ints) of space-delimited lines."""
    f = F.split(F.trim("value"), " ")
    return spark.read.text(path).where(F.length(F.trim("value")) > 0).select(
        f[0].alias("doc_id"), f[1].alias("label"), F.slice(f, 3, F.size(f)).cast("array<int>").alias("features")
    )


def read_weights(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    """model, feature, weight of lines '(feature,weight)'; without a name, each file is a model."""
    name = F.lit(model) if model is not None else F.element_at(F.split(F.input_file_name(), "/"), -1)
    pair = r"\(\s*([^,]+)\s*,\s*([^)]+)\s*\)"
    return spark.read.text(path).select(
        name.alias("model"),
        F.regexp_extract("value", pair, 1).cast("int").alias("feature"),
        F.regexp_extract("value", pair, 2).cast("double").alias("weight"),
    )


def adjacency(spark: SparkSession, path: str) -> DataFrame:
    """line: adjacency lists 'node neighbour neighbour ...'; see operators.graph.edges_from_adjacency."""
    return text_lines(spark, path).where(F.length(F.trim("line")) > 0)


def trips(lines: DataFrame) -> DataFrame:
    """kind, x, y of comma-separated trips; where the place stands depends on the kind. Lines may stream."""
    f = F.split("line", ",")
    yellow = f[0] == "yellow"
    kept = [c for c in lines.columns if c != "line"]
    at = lambda a, b: F.when(yellow, F.get(f, F.lit(a))).otherwise(F.get(f, F.lit(b))).try_cast("double")
    return lines.select(*kept, f[0].alias("kind"), at(10, 8).alias("x"), at(11, 9).alias("y"))
