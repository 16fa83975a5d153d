"""Dedup of repeated byte strings by sampled, hashed windows (operator 3).

This replaces prefix doubling, with the code of operator 6: nothing is ranked by
pairs at growing offsets.  The smallest 25-byte gram of each 100-byte window is
its sample; windows whose sample is unique stop there.  Runs of the others are
split into cells and windows, and a window is named by the hashes of its first
and last 50 bytes; the smallest place with a name is the first.

A byte is removed when a 100-byte string that covers it also starts earlier: in
a document with a smaller ``doc_id``, or earlier in the same document.  Strings
are judged on the input.  See ``repeats.remove_repeats`` for nulls, repeated
rows and empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from sparkloom.llm.repeats import Kind, remove_repeats


def suffix_dedup(docs: DataFrame, length: int = 100) -> DataFrame:
    """Verdict of every row of ``docs``: n_bytes, n_removed, n_spans, kept_sha256, removed byte spans."""
    if length < 8 or length % 2:
        raise ValueError("length must be even and 8 at least")
    out = remove_repeats(docs, Kind(words=False, window=length, gram=max(2, length // 4), within=True, cells=(8, 1)), "suffix")
    return out.withColumnRenamed("n_units", "n_bytes")


def op3_suffix_dedup(spark, sf_dir):
    out = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES = {"op3_suffix_dedup": op3_suffix_dedup}
ORACLES: dict[str, str] = {}
