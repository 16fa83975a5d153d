"""Mixing sources to target weights by pivotal dependent rounding (operator 9).

Every source gets a target of words; a document of a source of S words is to be
taken target / S times.  The whole part is taken as it is.  The fractions are
rounded together: two documents pass mass (fraction times words) between them
in a random direction, with the chances that keep each document's expected
number of copies, until one of the two fractions is 0 or 1; the other document
goes on to the next pair.  So the words of a source are kept up to the last
document.

Level 0 does this within bounded chunks of each source (documents dealt by a
hash), which leaves one fractional document for each chunk; these residuals are
combined by the same step, chunk by chunk, level by level, until each source has
one, which is rounded by its own chance.  All random numbers are hashes of
doc_id, a number that tells equal rows apart, and level: reruns and lost
executors give the same result.

The targets are a table with a row for each source, however many there are.
Sources are numbered by a range-partitioned sort; the words for one unit of
weight are found by sums over that table, one row of which reaches the driver a
round, until no free source is above its limit.

A null text has size 0.  A null source is a source of its own, the last one.
Null and repeated doc_ids are allowed: rows with one source, doc_id and size are
interchangeable, so they are counted and numbered, and then dealt and rounded
like all others; none of them can fill a chunk alone.  Ties in size are decided
by doc_id and number.  Texts of any length are counted whole.  An empty table
gives an empty result; extra columns may have any name and are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.scratch import Scratch

#: Documents that one task rounds together.
CHUNK = 10_000
#: Fractions nearer to a whole number than this count as whole.
TINY = 1e-12


def source_targets(sizes: DataFrame, scratch: Scratch, share: float, weights: tuple[float, ...], most: float) -> DataFrame:
    """``sizes`` (source, size) with weight and target of words for each source.

    Sources by code point, null last, get the weights in turn; a target stops
    at ``most`` times the source's size, and the excess is shared again by
    weight among the others until none is above.
    """
    # The upper bits of the id are the partition of the sort, the lower 33 the place in it.
    ordered = scratch.cut(sizes.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()))
    parts = ordered.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before.alias("before"))
    nth = (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth + 1).cast("int"))
    rows = scratch.cut(ordered.join(parts, F.shiftright("at", 33) == F.col("part")).drop("part").withColumn("weight", weight).drop("at", "before"))
    scratch.drop(ordered)
    wanted = share * (rows.agg(F.sum("size")).first()[0] or 0)
    unit = 0.0
    while True:
        above = F.col("weight") * F.lit(unit) > most * F.col("size")
        held, free = rows.agg(F.sum(F.when(above, most * F.col("size"))), F.sum(F.when(~above, F.col("weight")))).first()
        now = max(unit, (wanted - (held or 0)) / free) if free else unit
        if now <= unit:
            break
        unit = now
    target = F.least(F.col("weight") * F.lit(unit), most * F.col("size")).cast("double")
    return rows.withColumn("target", target)


def _pivot(size: np.ndarray, part: np.ndarray, chance: np.ndarray) -> tuple[np.ndarray, int]:
    """Rounds fractions of documents in order; returns the parts and the one still fractional (or -1)."""
    part = part.copy()
    held = -1
    for j in range(len(part)):
        if part[j] <= TINY or part[j] >= 1 - TINY or size[j] == 0:
            part[j] = round(part[j])
            continue
        if held < 0:
            held = j
            continue
        i = held
        up = min(size[i] * (1 - part[i]), size[j] * part[j])
        down = min(size[i] * part[i], size[j] * (1 - part[j]))
        mass = up if chance[j] * (up + down) < down else -down
        part[i] += mass / size[i]
        part[j] -= mass / size[j]
        open_ = [k for k in (i, j) if TINY < part[k] < 1 - TINY]
        for k in (i, j):
            if k not in open_:
                part[k] = round(part[k])
        held = open_[0] if open_ else -1
    return part, held


ROW = "doc_id long, nr long, source string, size long, chunk long, part double, open boolean"


def _round_group(df: pd.DataFrame) -> pd.DataFrame:
    # Large documents first: what is left open at the end then is small, mostly.
    df = df.sort_values(["size", "doc_id", "nr"], ascending=[False, True, True], na_position="last", kind="stable").reset_index(drop=True)
    part, held = _pivot(df["size"].to_numpy(float), df["part"].to_numpy(float), df["chance"].to_numpy(float))
    df["part"] = part
    df["open"] = np.arange(len(df)) == held
    return df[["doc_id", "nr", "source", "size", "chunk", "part", "open"]]


def _chance(level: int, seed: int):
    return (F.pmod(F.xxhash64("doc_id", "nr", "source", "chunk", F.lit(level), F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)).alias("chance")


def dealt_rows(sized: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """doc_id, nr, source, size, chunk, part (fraction to round), chance of every row of ``sized``."""
    counted = sized.groupBy("source", "doc_id", "size").agg(F.count("*").alias("times"))
    # Numbers of equal rows in two steps, so that no array is long.
    some = counted.withColumn("block", F.explode(F.sequence(F.lit(0), F.expr("cast((times - 1) div 100000 as int)"))))
    rows = some.withColumn("nr", F.explode(F.expr("sequence(block * 100000L, least(times, (block + 1) * 100000L) - 1)")))
    known = rows.join(plan, F.col("source").eqNullSafe(F.col("p_source")))
    chunk = F.pmod(F.xxhash64("doc_id", "nr", F.lit(seed)), F.col("chunks")).alias("chunk")
    return known.select("doc_id", "nr", "source", "size", chunk, (F.col("rate") - F.floor("rate")).alias("part")).withColumn("chance", _chance(0, seed))


def mix_sources(
    docs: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (3, 1, 2), most: float = 2.0, seed: int = 1, chunk: int = CHUNK
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every row of ``docs``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    sized = scratch.cut(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
        )
    )
    sums = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs"))
    rate = F.when(F.col("size") > 0, F.col("target") / F.col("size")).otherwise(0.0)
    plan = scratch.cut(source_targets(sums, scratch, share, weights, most).select(
        F.col("source").alias("p_source"), F.col("size").alias("source_size"), "target", rate.alias("rate"), F.expr(f"(docs + {chunk - 1}) div {chunk}").alias("chunks")
    ))
    rounded = scratch.cut(dealt_rows(sized, plan, seed).groupBy("source", "chunk").applyInPandas(_round_group, ROW))
    scratch.drop(sized)
    # The residual of chunk c is found again by (source, c).
    level, done = 0, None
    rest = scratch.cut(rounded.where("open").select("source", "size", "doc_id", "nr", "part", F.col("chunk").alias("home"), "chunk"))
    while True:
        level += 1
        widest = rest.agg(F.max("chunk")).first()[0]
        last = widest is None or widest < chunk
        step = rest.select("*", F.floor(F.col("chunk") / chunk).alias("next"), _chance(level, seed))
        out = scratch.cut(step.groupBy("source", "next").applyInPandas(
            _round_residuals(last), "source string, size long, doc_id long, nr long, part double, home long, chunk long, open boolean"
        ))
        scratch.drop(rest)
        closed = out.where("not open").select(F.col("source").alias("r_source"), "home", F.col("part").alias("r_part"))
        done = closed if done is None else done.unionByName(closed)
        if last:
            break
        rest = scratch.cut(out.where("open").drop("open"))
    final = rounded.join(
        done, F.col("source").eqNullSafe(F.col("r_source")) & (F.col("chunk") == F.col("home")) & F.col("open"), "left"
    ).select("doc_id", "source", "size", F.when(F.col("open"), F.col("r_part")).otherwise(F.col("part")).alias("part"))
    copies = (F.floor("rate") + F.round("part")).cast("long")
    return final.join(plan, F.col("source").eqNullSafe(F.col("p_source"))).select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def _round_residuals(last: bool):
    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["size", "home"], ascending=[False, True], kind="stable").reset_index(drop=True)
        part, held = _pivot(df["size"].to_numpy(float), df["part"].to_numpy(float), df["chance"].to_numpy(float))
        if held >= 0 and last:
            # Its own chance decides, with a number that no pair has used.
            part[held] = float((df["chance"].iloc[held] * 1e6) % 1 < part[held])
            held = -1
        df["part"], df["open"] = part, np.arange(len(df)) == held
        df["chunk"] = df["next"]
        return df[["source", "size", "doc_id", "nr", "part", "home", "chunk", "open"]]

    return run


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op9_mixing": op9_mixing}
ORACLES: dict[str, str] = {}
