"""Graphs as edge tables: building, partitioning, personalized PageRank, top nodes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.plans.lineage import cut_lineage


def edges_from_adjacency(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: node; edges: src, dst) of lines 'node neighbour ...'; a bare node has no edges."""
    parts = lines.select(F.split(F.trim("line"), r"\s+").cast("array<bigint>").alias("p")).where(F.size("p") > 0)
    edges = parts.select(F.col("p")[0].alias("src"), F.explode(F.expr("slice(p, 2, size(p))")).alias("dst"))
    return parts.select(F.col("p")[0].alias("node")).distinct(), edges


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes, edges, active_nodes (those with an edge), one row."""
    n = nodes.agg(F.count("*").alias("nodes"))
    e = edges.agg(F.count("*").alias("edges"), F.count_distinct("src").alias("active_nodes"))
    return n.crossJoin(e)


def missing_targets(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose target is no node."""
    return edges.join(nodes.select(F.col("node").alias("dst")), "dst", "left_anti")


def range_partition_of(node, count: int, partitions: int):
    """Partition of a node id below ``count``: equal ranges, in order."""
    return (F.floor(node.cast("double") / count * partitions) % partitions).cast("int")


def partition_graph(nodes: DataFrame, partitions: int, range_nodes: int | None = None) -> DataFrame:
    """node, partition: by hash, or by id range where the number of nodes is given; dealt out so."""
    if range_nodes is None:
        part = F.pmod(F.hash("node"), F.lit(partitions)).cast("int")
    else:
        part = range_partition_of(F.col("node"), range_nodes, partitions)
    return nodes.withColumn("partition", part).repartition(partitions, "partition")


def store_edges(edges: DataFrame, table: str, buckets: int) -> None:
    """Edges as a table in buckets by their start: joins and sums by it need no shuffle, in later jobs neither."""
    edges.repartition(buckets, "src").write.bucketBy(buckets, "src").sortBy("src").mode("overwrite").saveAsTable(table)


def personalized_pagerank(
    nodes: DataFrame, edges: DataFrame, sources: list[int], iterations: int, alpha: float = 0.15, cut_every: int = 5
) -> DataFrame:
    """source, node, rank after ``iterations`` steps, for every node and source.

    A step moves the rank of each node to its targets in equal parts; what is
    not received by any node returns to the source, and every step jumps to
    the source with probability alpha.  Only ranks that are not zero are kept.
    A step is one join with the edges, which stay dealt by their start, and one
    map-side combined sum: a received part counts for its node and, negatively,
    for what the source gets back, so the missing mass needs no second pass.
    """
    spark = nodes.sparkSession
    degree = edges.groupBy("src").agg(F.count("*").alias("degree"))
    real = edges.join(nodes.select(F.col("node").alias("dst")).distinct(), "dst", "left_semi")
    moves = cut_lineage(real.join(degree, "src").select(F.col("src").alias("node"), "dst", (1 / F.col("degree")).alias("part")))
    start = spark.createDataFrame([(s, s, 1.0) for s in dict.fromkeys(sources)], "source bigint, node bigint, rank double")
    ranks = start
    for k in range(1, iterations + 1):
        got = ranks.join(moves, "node").select("source", "dst", (F.col("rank") * F.col("part") * (1 - alpha)).alias("x"))
        both = F.explode(F.array(F.struct(F.col("dst").alias("node"), F.col("x")), F.struct(F.col("source").alias("node"), (-F.col("x")).alias("x"))))
        sent = got.select("source", both.alias("s")).select("source", "s.node", "s.x")
        ranks = sent.unionByName(start.withColumnRenamed("rank", "x")).groupBy("source", "node").agg(F.sum("x").alias("rank"))
        if k % cut_every == 0:
            ranks = cut_lineage(ranks)
    grid = nodes.select("node").distinct().select(F.explode(F.array(*[F.lit(s).cast("bigint") for s in dict.fromkeys(sources)])).alias("source"), "node")
    return grid.join(ranks, ["source", "node"], "left").select("source", "node", F.coalesce("rank", F.lit(0.0)).alias("rank"))


def top_ppr(ranks: DataFrame, k: int) -> DataFrame:
    """source, node, rank_text (five decimals), rn: the k highest ranks of each source."""
    w = Window.partitionBy("source").orderBy(F.desc("rank"), "node")
    top = ranks.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
    return top.select("source", "node", F.format_string("%.5f", "rank").alias("rank_text"), "rn")


def log_sum_exp(df: DataFrame, keys: list[str], log_col: str) -> DataFrame:
    """keys, log_sum: the logarithm of the sum of exponentials, taken from the largest term for range."""
    top = df.groupBy(*keys).agg(F.max(log_col).alias("_top"))
    return df.join(top, keys).groupBy(*keys).agg((F.first("_top") + F.log(F.sum(F.exp(F.col(log_col) - F.col("_top"))))).alias("log_sum"))


def unite(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
