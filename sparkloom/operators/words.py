"""Word statistics over lines: counts, followers, bigram frequencies, pointwise mutual information.

All take a DataFrame with a text column; null and empty lines have no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import tokens
from sparkloom.plans.lineage import cut_lineage

#: Pairs that are counted at once in a task, and the logarithm of the bits by which rare words are told from others.
PAIRS, SIEVE = 1 << 24, 23


def word_count(lines: DataFrame, text_col: str = "line") -> DataFrame:
    """word, count; partial counts are combined before the shuffle."""
    return lines.select(F.explode(tokens(text_col)).alias("word")).groupBy("word").count()


def _bigrams() -> Column:
    pairs = F.arrays_zip(F.expr("slice(w, 1, size(w) - 1)").alias("left"), F.expr("slice(w, 2, size(w) - 1)").alias("right"))
    return F.when(F.size("w") > 1, pairs)


def bigrams(lines: DataFrame, text_col: str = "line") -> DataFrame:
    """left, right: neighbouring words of each line; nothing is shuffled."""
    words = lines.select(F.explode(F.array(tokens(text_col))).alias("w"))
    pairs = words.select(F.explode(_bigrams()).alias("b"))
    # No word is null; said so, joins add no filter that would make two tables of one.
    return pairs.select(*[F.coalesce(f"b.{c}", F.lit("")).alias(c) for c in ("left", "right")])


def follow_count(lines: DataFrame, trigger: str, min_count: int = 2, text_col: str = "line") -> DataFrame:
    """word, count: words right after ``trigger``, the trigger itself left out, seen ``min_count`` times at least."""
    pairs = bigrams(lines, text_col).where((F.col("left") == trigger) & (F.col("right") != trigger))
    return pairs.groupBy(F.col("right").alias("word")).count().where(F.col("count") >= min_count)


def bigram_relfreq(lines: DataFrame, text_col: str = "line") -> DataFrame:
    """left, right, value: '*' has the count of left as a first word, others their share of it."""
    pairs = bigrams(lines, text_col).groupBy("left", "right").count()
    # Summed before the shuffle and joined, so followers of a frequent word need not meet in one task.
    total = pairs.groupBy("left").agg(F.sum("count").alias("total"))
    shares = pairs.join(total, "left").select("left", "right", (F.col("count") / F.col("total")).alias("value"))
    return shares.unionByName(total.select("left", F.lit("*").alias("right"), F.col("total").cast("double").alias("value")))


def first_count(lines: DataFrame, text_col: str = "line") -> DataFrame:
    """left, n: how often a word is the first of two; the '*' rows of ``bigram_relfreq`` alone."""
    return bigrams(lines, text_col).groupBy("left").agg(F.count("*").alias("n"))


def _named(counts: DataFrame) -> tuple[DataFrame, int]:
    """``counts`` with h, a hash of the word that no other word has, and its seed, which is moved until this holds."""
    for seed in range(100):
        named = counts.withColumn("h", F.xxhash64(F.lit(seed), "word"))
        if not named.groupBy("h").count().where("count > 1").limit(1).count():
            return named, seed
    raise RuntimeError("words can't be told apart by hashes")


def _sieve(frequent: DataFrame) -> np.ndarray:
    """A bit for each hash modulo 2**SIEVE, set where a word of ``frequent`` has it: 1 MB at most."""
    bits = frequent.select(F.expr(f"h & {(1 << SIEVE) - 1}").alias("b")).groupBy(F.expr("shiftright(b, 6)").alias("at"))
    out = np.zeros(1 << (SIEVE - 6), np.int64)
    for r in bits.agg(F.expr("bit_or(shiftleft(1L, cast(b & 63 as int)))").alias("x")).collect():
        out[r.at] = r.x
    return out


def _count_pairs(lines: list[pa.Array], sieve: np.ndarray) -> pa.RecordBatch:
    """hx, hy, n: the pairs of different words of each line, the smaller hash first."""
    words = pa.concat_arrays(lines)
    size = np.asarray(words.value_lengths().fill_null(0), np.int64)
    h, code = np.unique(np.asarray(words.flatten()), return_inverse=True)
    at = h & ((1 << SIEVE) - 1)
    kept = ((sieve[at >> 6] >> (at & 63)) & 1).astype(bool)[code]
    place = np.unique((np.repeat(np.arange(len(size)), size)[kept] << 32) | code[kept])
    line, code = place >> 32, place & 0xFFFFFFFF
    keys = [np.empty(0, np.int64)]
    for k in range(1, len(place)):
        same = line[k:] == line[:-k]
        if not same.any():
            break
        keys.append((code[:-k][same] << 32) | code[k:][same])
    key, n = np.unique(np.concatenate(keys), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(h[key >> 32], pa.int64()), pa.array(h[key & 0xFFFFFFFF], pa.int64()), pa.array(n, pa.int64())], ["hx", "hy", "n"])


def _pair_counts(sieve: np.ndarray):
    """For mapInArrow over arrays of hashes: the counts of their pairs, for about ``PAIRS`` pairs at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, pairs = [], 0
        for batch in batches:
            held.append(batch.column(0))
            size = np.asarray(held[-1].value_lengths().fill_null(0), np.int64)
            pairs += int((size * (size - 1) // 2).sum())
            if pairs >= PAIRS:
                yield _count_pairs(held, sieve)
                held, pairs = [], 0
        if held:
            yield _count_pairs(held, sieve)

    return run


def pmi_pairs(lines: DataFrame, threshold: int = 1, max_tokens: int = 40, unigram_cap: int | None = None, text_col: str = "line") -> DataFrame:
    """x, y, pmi, count of ordered pairs of words that share ``threshold`` lines at least.

    pmi = log10((c_xy / N) / ((c_x / N) (c_y / N))), N being the number of
    lines, empty ones included.  Words are the first ``max_tokens`` of a line.
    A pair is only as frequent as its words, so rarer words are dropped before
    pairs are made, and each pair is counted in one order and mirrored after.
    Pairs are counted as two numbers, hashes that are checked to be names of words.
    """
    cap = unigram_cap or max_tokens
    total = lines.agg(F.count("*").alias("n"))
    counts = lines.select(F.explode(F.array_distinct(F.slice(tokens(text_col), 1, cap))).alias("word")).groupBy("word").agg(F.count("*").alias("c"))
    counts, seed = _named(cut_lineage(counts))
    # A rare word of the first ``max_tokens`` may be in frequent pairs if ``cap`` is below.
    frequent = cut_lineage(counts.where(F.col("c") >= (threshold if cap >= max_tokens else 1)))
    hashes = F.transform(F.slice(tokens(text_col), 1, max_tokens), lambda w: F.xxhash64(F.lit(seed), w))
    pairs = lines.select(hashes.alias("d")).mapInArrow(_pair_counts(_sieve(frequent)), "hx long, hy long, n long")
    # Counted before the shuffle by the batch; another map of them in each task would not get much smaller.
    both = pairs.repartition("hx", "hy").groupBy("hx", "hy").agg(F.sum("n").alias("count")).where(F.col("count") >= threshold)
    cx, cy = (frequent.select(F.col("h").alias(f"h{x}"), F.col("word").alias(x), F.col("c").alias(f"c{x}")) for x in "xy")
    scored = both.join(cx, "hx").join(cy, "hy").crossJoin(F.broadcast(total)).select(
        "x", "y", F.log10((F.col("count") / F.col("n")) / ((F.col("cx") / F.col("n")) * (F.col("cy") / F.col("n")))).alias("pmi"), "count"
    )
    order = F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y"))))
    return scored.select(order.alias("p"), "pmi", "count").select("p.x", "p.y", "pmi", "count")
