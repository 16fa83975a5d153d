"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from sparkloom.llm.scratch import Scratch


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _counted(edges: DataFrame) -> tuple[DataFrame, Observation]:
    """Count and checksum of a table, taken while it is written."""
    seen = Observation()
    return edges.observe(seen, F.count("*").alias("n"), F.expr("sum(cast(xxhash64(u, v) as decimal(38, 0)))").alias("sum")), seen


def connected_components(links: DataFrame, scratch: Scratch, max_rounds: int = 100) -> DataFrame:
    """Component of every node that has a link.

    links: columns a, b (long); duplicates, both directions and a = b allowed.
    Returns node, component (the smallest node reachable), a table of ``scratch``.
    An empty input gives an empty table.  Each round is two map-side combined minima and
    equi-joins with one row for each node on one side; it ends when a round
    changes nothing.  The number of rounds grows with the logarithm of the
    longest path; stars take two.  Nothing but a count and a checksum reaches
    the driver.
    """
    first = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    first, seen = _counted(first)
    edges, before = scratch.cut(first), seen.get
    for _ in range(max_rounds):
        if not before["n"]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = large.join(_least(large), "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")
        )
        after, seen = _counted(small.select("e.u", "e.v").where("u <> v").distinct())
        after = scratch.cut(after)
        scratch.drop(edges)
        edges, now = after, seen.get
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    top = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = scratch.cut(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(top))
    scratch.drop(edges)
    return out
