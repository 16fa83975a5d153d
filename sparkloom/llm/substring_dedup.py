"""Substring dedup by level-wise doubling (operator 6).

Windows repeated at one length alone are extended to twice that length, until
no candidates survive: the first level names sampled 25-word windows, the
second the 50-word windows that hold a surviving one.  Words are runs of
anything but space and \\t \\n \\v \\f \\r, unchanged.

A word is removed when a window that covers it also starts in a document with
a smaller ``doc_id``.  Windows are judged on the input.  See
``repeats.remove_repeats`` for nulls, repeated rows and empty tables: a null or
empty text has no words, an empty table gives an empty result, extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from sparkloom.llm.repeats import Kind, remove_repeats


def substring_dedup(docs: DataFrame, window: int = 50) -> DataFrame:
    """Verdict of every row of ``docs``: n_words, n_removed, kept_sha256, removed word spans."""
    if window < 4 or window % 2:
        raise ValueError("window must be even and 4 at least")
    out = remove_repeats(docs, Kind(words=True, window=window, gram=window // 2, within=False, cells=(4, 1)), "substring")
    return out.withColumnRenamed("n_units", "n_words")


def op6_substring_dedup(spark, sf_dir):
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


QUERIES = {"op6_substring_dedup": op6_substring_dedup}
ORACLES: dict[str, str] = {}
