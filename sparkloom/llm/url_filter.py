"""URL filters with a temporal list join (operator 7), native.

The list is a log of dated entries (kind, pattern, action): ``add`` puts a
pattern on the list, ``remove`` takes it off.  The log of each pattern becomes
validity intervals [from, to); every capture is then judged as of its fetch
time: it is blocked when an interval of any of its keys holds that time.  The
keys of a URL are

domain  its host and every parent domain of two labels or more
prefix  its host with each path prefix that ends at a slash, and the whole path

Hosts are lower-cased, without port, user and a leading ``www.``; query and
fragment are ignored.  Of entries for one pattern at one time the last by action
(``remove`` after ``add``) holds.  An interval without end is open.

Captures are reduced to distinct (url, time) pairs, and those of their keys that
are listed at all are found by a salted equi-join.  The as-of join is one sorted
union: captures and interval starts of a pattern are ordered by time, and each
capture takes the last start before it or at its time.  So that no pattern is
the work of one task, time is cut into ``RANGES`` ranges of equal width and the
captures into ``SALTS`` salts; the interval that holds when a range begins is
carried into it (one row for a pattern and range at most).  Intervals are closed
range by range in the same way.  Two numbers, the first and last time of the
log, reach the driver.  Only DataFrame and SQL functions are used.

A null url or time matches nothing (n_active 0, not blocked); entries with a
null pattern, kind, action or time are ignored; repeated entries and captures
change nothing but their own rows.  Captures at the very time of an entry see
it.  Urls of any length are judged whole.  An empty list blocks nothing, an
empty table of captures gives an empty result.  Extra columns may have any name;
those named _active and _blocked are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.scratch import Scratch

SALTS = 8
RANGES = 64


def url_host(url: str | Column = "url") -> Column:
    """Host of an http(s) URL as the list writes it; null where there is none."""
    authority = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    host = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", "")
    host = F.regexp_replace(host, r"^www\.", "")
    return F.when(F.length(host) > 0, host)


def _keys() -> Column:
    """All (kind, pattern) keys of the columns host and path."""
    labels = "split(host, '\\\\.')"
    domains = (
        f"transform(sequence(1, greatest(size({labels}) - 1, 1)), "
        f"i -> struct('domain' AS kind, array_join(slice({labels}, i, size({labels})), '.') AS pattern))"
    )
    parts = "split(path, '/')"
    prefixes = (
        f"transform(sequence(1, size({parts})), i -> struct('prefix' AS kind, "
        f"concat(host, array_join(slice({parts}, 1, i), '/'), IF(i < size({parts}), '/', '')) AS pattern))"
    )
    return F.expr(f"array_distinct(concat({domains}, {prefixes}))")


class _Ranges:
    """Ranges of equal width between the first and the last time of a log."""

    def __init__(self, first: int | None, last: int | None) -> None:
        self.first = first or 0
        self.width = max(1, -(-((last or 0) - self.first + 1) // RANGES))

    def of(self, at: str) -> Column:
        return F.least(F.greatest(F.floor((F.col(at) - self.first) / self.width), F.lit(0)), F.lit(RANGES - 1)).cast("int")


def validity_intervals(log: DataFrame, ranges: _Ranges) -> DataFrame:
    """kind, pattern, range, from, to: when a pattern is on the list, by the range in which that begins.

    log: kind, pattern, at, action; one row for each pattern and time.
    """
    log = log.withColumn("range", ranges.of("at"))
    # What ends the last entry of a range is the first of the next range that has one.
    firsts = log.groupBy("kind", "pattern", "range").agg(F.min("at").alias("first"))
    after = firsts.withColumn("after", F.lead("first").over(Window.partitionBy("kind", "pattern").orderBy("range"))).drop("first")
    w = Window.partitionBy("kind", "pattern", "range").orderBy("at")
    spans = log.withColumn("next", F.lead("at").over(w)).where("action = 'add'")
    return spans.join(after, ["kind", "pattern", "range"]).select("kind", "pattern", "range", F.col("at").alias("from"), F.coalesce("next", "after").alias("to"))


def _as_of(keyed: DataFrame, spans: DataFrame, ranges: _Ranges) -> DataFrame:
    """The rows of ``keyed`` (u, t, kind, pattern, salt) whose pattern is on the list at t."""
    pattern, cell = ["kind", "pattern"], ["kind", "pattern", "range", "salt"]
    keyed = keyed.withColumn("range", ranges.of("t"))
    # The interval that a range begins with: the last one of the ranges before.
    latest = spans.groupBy(*pattern, "range").agg(F.max(F.struct("from", "to")).alias("last"))
    asked = keyed.select(*pattern, "range").distinct().withColumn("last", F.lit(None).cast("struct<from:bigint,to:bigint>"))
    both = latest.unionByName(asked).groupBy(*pattern, "range").agg(F.max("last").alias("last"))
    before = Window.partitionBy(*pattern).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.select(*pattern, "range", F.last("last", ignorenulls=True).over(before).alias("span")).where("span is not null")
    starts = spans.select(*pattern, "range", F.struct("from", "to").alias("span")).unionByName(carried)
    salted = starts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # Starts come before captures of the same time.
    rows = salted.select(*cell, F.col("span.from").alias("at"), F.lit(0).alias("nr"), "span", F.lit(None).cast("string").alias("u")).unionByName(
        keyed.select(*cell, F.col("t").alias("at"), F.lit(1).alias("nr"), F.lit(None).cast("struct<from:bigint,to:bigint>").alias("span"), "u")
    )
    order = Window.partitionBy(*cell).orderBy("at", "nr").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = rows.select("u", F.col("at").alias("t"), *pattern, "nr", F.last("span", ignorenulls=True).over(order).alias("span"))
    return met.where("nr = 1 and span.from <= t and (span.to is null or t < span.to)").drop("nr", "span")


def url_filter(captures: DataFrame, entries: DataFrame, url: str = "url", at: str = "fetch_at") -> DataFrame:
    """``captures`` with _active (kind:pattern, sorted) and _blocked.

    entries: kind, pattern, action, at (long).
    """
    scratch = Scratch(captures.sparkSession, "urls")
    log = entries.select("kind", "pattern", "action", F.col("at").cast("long").alias("at")).where(
        "kind is not null and pattern is not null and action in ('add', 'remove') and at is not null"
    )
    log = scratch.cut(log.groupBy("kind", "pattern", "at").agg(F.max("action").alias("action")))
    ranges = _Ranges(*log.agg(F.min("at"), F.max("at")).first())
    spans = scratch.cut(validity_intervals(log, ranges))
    scratch.drop(log)
    rows = captures.select(F.struct(*[captures[c] for c in captures.columns]).alias("d"), captures[url].cast("string").alias("u"), captures[at].cast("long").alias("t"))
    seen = rows.select("u", "t").where("u is not null and t is not null").distinct()
    path = F.regexp_extract("u", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    keyed = seen.select("u", "t", url_host("u").alias("host"), path.alias("path")).where("host is not null")
    keyed = keyed.select("u", "t", F.explode(_keys()).alias("k"), F.pmod(F.xxhash64("u", "t"), F.lit(SALTS)).cast("int").alias("salt"))
    listed = spans.select("kind", "pattern").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    keyed = keyed.select("u", "t", "k.kind", "k.pattern", "salt").join(listed, ["kind", "pattern", "salt"], "left_semi")
    met = _as_of(scratch.cut(keyed), spans, ranges)
    active = met.groupBy("u", "t").agg(F.array_sort(F.collect_set(F.concat_ws(":", "kind", "pattern"))).alias("active"))
    return rows.join(active, ["u", "t"], "left").select(
        *[F.col("d")[c].alias(c) for c in captures.columns if c not in ("_active", "_blocked")],
        F.coalesce("active", F.array().cast("array<string>")).alias("_active"),
        F.col("active").isNotNull().alias("_blocked"),
    )


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures: all ``pages``, fetched at second page_id * 104729 mod 30 days.

    List log: every row of ``events`` is an entry about the page whose id is
    its user_id: errors block the host, signups free it; clicks block the
    registered domain's parent key (last three labels), purchases free it;
    views of a value of 50 or more block the path prefix, others free it.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "user_id", "event_type", "value")
    captures = pages.withColumn("fetch_at", F.expr("page_id * 104729 % 2592000"))
    about = events.join(pages, events.user_id == pages.page_id).withColumn("host", url_host("url"))
    entries = about.select(
        F.expr("IF(event_type = 'view', 'prefix', 'domain')").alias("kind"),
        F.expr(
            "CASE event_type WHEN 'view' THEN concat(host, '/', split_part(url, '/', 4), '/') "
            "WHEN 'error' THEN host WHEN 'signup' THEN host "
            "ELSE array_join(slice(split(host, '\\\\.'), -3, 3), '.') END"
        ).alias("pattern"),
        F.expr("CASE event_type WHEN 'error' THEN 'add' WHEN 'click' THEN 'add' WHEN 'view' THEN IF(value >= 50, 'add', 'remove') ELSE 'remove' END").alias("action"),
        F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts)").alias("at"),
    )
    return url_filter(captures, entries).select(
        "page_id", "url", "fetch_at", F.size("_active").cast("long").alias("n_active"), F.array_join("_active", " ").alias("active"), F.col("_blocked").alias("blocked")
    )


ORACLE = r"""
WITH p AS (
  SELECT page_id, url, page_id * 104729 % 2592000 AS t,
         regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^.*@', ''), ':[0-9]*$', ''), '^www\.', '') AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
l AS (SELECT *, string_split(host, '.') AS labels, string_split(path, '/') AS parts FROM p),
e AS (
  SELECT CASE WHEN event_type = 'view' THEN 'prefix' ELSE 'domain' END AS kind,
         CASE WHEN event_type = 'view' THEN host || '/' || split_part(url, '/', 4) || '/'
              WHEN event_type IN ('error', 'signup') THEN host
              ELSE array_to_string(labels[greatest(len(labels) - 2, 1):], '.') END AS pattern,
         CASE WHEN event_type IN ('error', 'click') OR event_type = 'view' AND value >= 50 THEN 'add' ELSE 'remove' END AS action,
         date_diff('second', TIMESTAMP '2024-01-01', date_trunc('second', ts)) AS since
  FROM events JOIN l ON user_id = page_id WHERE host <> ''),
lastone AS (SELECT kind, pattern, since, max(action) AS action FROM e GROUP BY ALL),
i AS (SELECT *, lead(since) OVER (PARTITION BY kind, pattern ORDER BY since) AS until FROM lastone),
k AS (
  SELECT page_id, t, 'domain' AS kind, array_to_string(labels[i:], '.') AS pattern
  FROM (SELECT page_id, t, labels, unnest(range(1, greatest(len(labels) - 1, 1) + 1)) AS i FROM l WHERE host <> '')
  UNION
  SELECT page_id, t, 'prefix', host || array_to_string(parts[:i], '/') || CASE WHEN i < len(parts) THEN '/' ELSE '' END
  FROM (SELECT page_id, t, host, parts, unnest(range(1, len(parts) + 1)) AS i FROM l WHERE host <> '')),
a AS (
  SELECT page_id, count(*) AS n, string_agg(x, ' ' ORDER BY x) AS active
  FROM (SELECT DISTINCT page_id, k.kind || ':' || k.pattern AS x FROM k JOIN i ON k.kind = i.kind AND k.pattern = i.pattern AND action = 'add' AND since <= t AND (until IS NULL OR t < until))
  GROUP BY page_id)
SELECT l.page_id, url, t AS fetch_at, CAST(coalesce(n, 0) AS BIGINT) AS n_active, coalesce(active, '') AS active, n IS NOT NULL AS blocked
FROM l LEFT JOIN a USING (page_id)
"""

QUERIES = {"op7_url_filter": op7_url_filter}
ORACLES = {"op7_url_filter": ORACLE}
