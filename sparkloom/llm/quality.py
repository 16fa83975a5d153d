"""Quality rules with cross-document line frequency (operator 2), native.

Base rules: word and symbol counts, repeated lines and repeated 5-word windows
inside a document.  Cross-document rule: normalised lines are hashed, and for
each host the distinct documents that hold a line are counted (a line counts
once for a document, and every row is a document); lines above the limit are
boilerplate of the host.  ``quality_filter`` removes them from the
texts; ``quality_rules`` counts their words.  A document that keeps too few of
its words is depleted and rejected.

The limit is the larger of ``min_docs`` and ``max_share`` of the host's
documents with a text.  So are the lines of a text that has been copied into
more documents of its host than that.  A document is depleted when fewer
than ``min_words`` words, or less than ``min_kept`` of its words, are left.

Only DataFrame and SQL functions are used.  What is shuffled are line hashes,
pre-aggregated per host and line; texts stay in their scan task.  The
frequent lines are broadcast where a count shows that they are few, and joined
back with a salted key otherwise, so a line in a third of all documents is
spread over tasks.

Null and empty texts have no words and fail the base rule.  A null host is a
host of its own.  Rows without doc_id or repeating one are documents like
others, judged each by itself from its text and host.  Ties can't occur: a line
is at the limit or above it.  Very long texts are judged whole.  An empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.scratch import Scratch

#: Words are runs of anything but space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
SALTS = 16
#: Frequent lines that are broadcast, after a count (16 bytes each and the host); more are joined with a salted key.
LOOKUP = 100_000


def word_count(text: str | Column = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _repeat_words() -> Column:
    """Words in 5-word windows that the document has twice or more.

    h has the window hashes by start.  Most documents repeat none, which a
    distinct count shows; only others sort (hash, start) pairs and add up the
    places that windows with an equal neighbour cover.
    """
    pairs = "array_sort(transform(h, (x, i) -> struct(x AS x, i AS i)))"
    twice = (
        f"transform(array({pairs}), s -> array_sort(transform(filter(sequence(0, size(s) - 1), "
        "i -> (i > 0 and s[i - 1].x = s[i].x) or (i < size(s) - 1 and s[i + 1].x = s[i].x)), i -> s[i].i)))[0]"
    )
    total = f"aggregate({twice}, struct(0L AS n, -5 AS p), (a, i) -> struct(a.n + least(5, i - a.p) AS n, i AS p), a -> a.n)"
    return F.expr(f"CASE WHEN h IS NULL OR size(h) = size(array_distinct(h)) THEN 0L ELSE {total} END").alias("n_repeat_words")


def base_counts(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; narrow, no shuffle."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(WORD)))
    staged = docs.withColumns({"w": F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), "lines": lines})
    # A generator keeps w and lines as columns, computed once for a row.
    staged = staged.select(*docs.columns, F.explode(F.array(F.struct("w", "lines"))).alias("s")).select(*docs.columns, "s.w", "s.lines")
    staged = staged.withColumn(
        "h", F.expr("CASE WHEN size(w) >= 5 THEN transform(sequence(0, size(w) - 5), i -> xxhash64(w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4])) END")
    )
    staged = staged.select(*docs.columns, F.explode(F.array(F.struct("w", "lines", "h"))).alias("s")).select(*docs.columns, "s.w", "s.lines", "s.h")
    return staged.select(
        *docs.columns,
        F.size("w").cast("long").alias("n_words"),
        F.expr("aggregate(w, 0L, (a, x) -> a + length(x))").alias("word_chars"),
        F.coalesce(F.regexp_count("text", F.lit(SYMBOL)), F.lit(0)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(),
    )


def host_key(host: str) -> Column:
    """A text that is equal for equal hosts, null included."""
    return F.coalesce(F.concat(F.lit("h"), F.col(host).cast("string")), F.lit("n"))


def _slim(docs: DataFrame, host: str) -> DataFrame:
    """host (key), text, t (name of the text); rows without text are left out."""
    text = F.col("text").cast("string")
    return docs.select(host_key(host).alias("host"), text.alias("text"), F.xxhash64(text).alias("t")).where("text is not null")


def _lines(slim: DataFrame) -> DataFrame:
    """host, t, line (name of the normalised line), n: its words; one row for each line with a word."""
    rows = slim.select("host", "t", F.explode(F.split("text", "\n")).alias("line")).where(F.regexp_like("line", F.lit(WORD)))
    return rows.select("host", "t", F.xxhash64(_norm("line")).alias("line"), word_count("line").alias("n"))


def _norm(line: str | Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")))


def boilerplate_lines(docs: DataFrame, host: str, min_docs: int, max_share: float) -> DataFrame:
    """host (key), line (name of the normalised line) of every line above its host's limit; a table in the shared folder."""
    slim = _slim(docs, host)
    total = slim.groupBy("host").agg(F.count("*").alias("total"))
    # Lines without a word have the name of the empty one, which is left out.
    own = F.array_distinct(F.transform(F.split("text", "\n"), lambda x: F.xxhash64(_norm(x))))
    held = slim.select("host", F.explode(own).alias("line")).where(F.col("line") != F.xxhash64(F.lit(""))).groupBy("host", "line").agg(F.count("*").alias("docs"))
    many = held.where(F.col("docs") > min_docs).join(total, "host").where(F.col("docs") > max_share * F.col("total")).select("host", "line")
    return Scratch(docs.sparkSession, "quality").cut(many)


def boilerplate_words(docs: DataFrame, host: str = "source", min_docs: int = 50, max_share: float = 0.05) -> DataFrame:
    """host (key), t (xxhash64 of the text), n_boilerplate: words in lines above the host's limit; other texts have no row."""
    slim = _slim(docs, host)
    copies = slim.groupBy("host", "t").agg(F.count("*").alias("copies"))
    many = boilerplate_lines(docs, host, min_docs, max_share)
    lines = _lines(slim)
    if many.count() <= LOOKUP:
        met = lines.join(F.broadcast(many), ["host", "line"])
    else:
        salted = many.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = lines.withColumn("salt", F.pmod("t", F.lit(SALTS)).cast("int")).join(salted, ["host", "line", "salt"])
    # All copies of a text on a host have added the same.
    return met.groupBy("host", "t").agg(F.sum("n").alias("n")).join(copies, ["host", "t"]).select("host", "t", F.expr("n div copies").alias("n_boilerplate"))


BASE_FAILED = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"


def depleted(min_words: int, min_kept: float) -> str:
    return f"n_words - n_boilerplate < {min_words} or n_words - n_boilerplate < {min_kept} * n_words"


def quality_rules(
    docs: DataFrame, host: str = "source", min_docs: int = 50, max_share: float = 0.05, min_words: int = 10, min_kept: float = 0.2
) -> DataFrame:
    """doc_id, the base counts, n_boilerplate, base_failed and kept of every row of ``docs``."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), host_key(host).alias("host"))
    counts = base_counts(rows).withColumn("t", F.xxhash64("text")).drop("text")
    found = boilerplate_words(docs, host, min_docs, max_share)
    return _with_boilerplate(counts, found, min_words, min_kept).drop("host", "t")


def _with_boilerplate(counts: DataFrame, found: DataFrame, min_words: int, min_kept: float) -> DataFrame:
    found = found.select(F.col("host").alias("b_host"), F.col("t").alias("b_t"), "n_boilerplate")
    out = counts.join(found, (F.col("t") == F.col("b_t")) & (F.col("host") == F.col("b_host")), "left").drop("b_host", "b_t")
    return (
        out.withColumn("n_boilerplate", F.coalesce("n_boilerplate", F.lit(0)).cast("long"))
        .withColumn("base_failed", F.expr(BASE_FAILED))
        .withColumn("kept", F.expr(f"not ({BASE_FAILED}) and not ({depleted(min_words, min_kept)})"))
    )


def quality_filter(
    docs: DataFrame, host: str = "source", min_docs: int = 50, max_share: float = 0.05, min_words: int = 10, min_kept: float = 0.2
) -> DataFrame:
    """The rows of ``docs`` that the rules keep, their texts without boilerplate lines.

    The base rule is a filter of the scan.  A host has few lines above its limit
    (its mean lines a text over ``max_share`` at most), so a row takes them as one array.
    """
    many = boilerplate_lines(docs, host, min_docs, max_share)
    hosts = many.groupBy(F.col("host").alias("b_host")).agg(F.collect_set("line").alias("b_lines"))
    # Columns of docs that have the names of the counts must not clash with them.
    part = docs.select(F.struct(*docs.columns).alias("d"), F.col("text").cast("string").alias("text"), host_key(host).alias("host"))
    good = base_counts(part).where(f"not ({BASE_FAILED})").select("d", "text", "n_words", "host")
    if many.count() <= LOOKUP:
        met = good.join(F.broadcast(hosts), F.col("host") == F.col("b_host"), "left")
    else:
        salted = hosts.withColumn("b_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("text"), F.lit(SALTS)).cast("int")
        met = good.join(salted, (F.col("host") == F.col("b_host")) & (salt == F.col("b_salt")), "left")
    rest = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~F.array_contains("b_lines", F.xxhash64(_norm(x)))), "\n")
    met = met.select("d", "n_words", F.explode(F.array(F.when(F.col("b_lines").isNull(), F.col("text")).otherwise(rest))).alias("rest"))
    kept = met.withColumn("left", word_count("rest")).where(f"not (left < {min_words} or left < {min_kept} * n_words)")
    return kept.select(*[F.col("rest").cast(docs.schema["text"].dataType).alias(c) if c == "text" else F.col("d")[c].alias(c) for c in docs.columns])


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (
  SELECT r, source, text, line, trim(lower(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS norm, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
  FROM (SELECT r, source, text, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY r),
p AS (SELECT r, unnest(range(1, len(w) - 3)) AS p, w FROM d WHERE len(w) >= 5),
k AS (SELECT r, p, count(*) OVER (PARTITION BY r, array_to_string(w[p:p + 4], ' ')) AS c FROM p),
rep AS (SELECT r, count(DISTINCT q) AS n_repeat_words FROM (SELECT r, unnest(range(p, p + 5)) AS q FROM k WHERE c > 1) GROUP BY r),
host AS (SELECT source, count(text) AS texts FROM d GROUP BY source),
f AS (SELECT source, norm, count(DISTINCT r) AS docs FROM l GROUP BY source, norm),
many AS (SELECT f.source, f.norm FROM f JOIN host h ON f.source IS NOT DISTINCT FROM h.source WHERE docs > 50 AND docs > 0.05 * texts),
boil AS (SELECT r, sum(n) AS n_boilerplate FROM l JOIN many m ON l.source IS NOT DISTINCT FROM m.source AND l.norm = m.norm GROUP BY r),
c AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(n_boilerplate, 0) AS BIGINT) AS n_boilerplate
  FROM d LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN boil USING (r))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
       AND NOT (n_words - n_boilerplate < 10 OR n_words - n_boilerplate < 0.2 * n_words) AS kept
FROM c
"""

QUERIES = {"op2_quality_rules": op2_quality_rules}
ORACLES = {"op2_quality_rules": ORACLE}
