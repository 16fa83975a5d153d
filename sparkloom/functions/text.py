"""Tokens and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: From the first letter to the last one of a run without white space.
WORD = r"[a-z](?:\S*[a-z])?"


def tokens(col: Column | str) -> Column:
    """Lower-cased words without non-letters at their ends; empty ones are dropped. Null gives null."""
    col = F.col(col) if isinstance(col, str) else col
    # One pass over the text; a function of each word of an array would not be compiled.
    return F.regexp_extract_all(F.lower(col), F.lit(WORD), F.lit(0))


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each line of each document: id, line_no (from 0), line."""
    return docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))


def snippet(col: Column | str, width: int = 80) -> Column:
    """The first ``width`` characters, with dots where text is left out."""
    col = F.col(col) if isinstance(col, str) else col
    return F.when(F.length(col) > width, F.concat(F.substring(col, 1, width), F.lit("..."))).otherwise(col)
