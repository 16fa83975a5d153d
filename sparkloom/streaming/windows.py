"""Windowed counts, geo-fenced counts and trend alerts.

The counting functions take a streaming or a batch DataFrame; a streaming one
gets a watermark.  Window start is the group key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Name -> (x from, x to, y from, y to); edges belong to the box.
Boxes = dict[str, tuple[float, float, float, float]]


def _timed(df: DataFrame, ts: str, late: str) -> DataFrame:
    # Watermarks need a timestamp with time zone; sessions run in UTC.
    df = df.withColumn("_ts", F.col(ts).cast("timestamp"))
    return df.withWatermark("_ts", late) if df.isStreaming else df


def event_count(df: DataFrame, ts: str = "ts", size: str = "60 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """window_start, key ('all'), count of tumbling or, with a slide, sliding windows."""
    w = F.window("_ts", size, slide) if slide else F.window("_ts", size)
    out = _timed(df, ts, late).groupBy(w.alias("w")).agg(F.count("*").alias("count"))
    return out.select(F.col("w.start").alias("window_start"), F.lit("all").alias("key"), "count")


def region_of(x: Column, y: Column, boxes: Boxes) -> Column:
    """The first box that holds the point, or null."""
    out = F.lit(None).cast("string")
    for name, (x0, x1, y0, y1) in reversed(boxes.items()):
        out = F.when(x.between(x0, x1) & y.between(y0, y1), name).otherwise(out)
    return out


def region_event_count(df: DataFrame, ts: str, x: str, y: str, regions: Boxes, size: str = "60 minutes", late: str = "10 minutes") -> DataFrame:
    """window_start, region, count; points in no box are dropped."""
    placed = _timed(df, ts, late).withColumn("region", region_of(F.col(x), F.col(y), regions)).where("region is not null")
    out = placed.groupBy(F.window("_ts", size).alias("w"), "region").agg(F.count("*").alias("count"))
    return out.select(F.col("w.start").alias("window_start"), "region", "count")


def densify(counts: DataFrame, key: str, size: str) -> DataFrame:
    """counts (window_start, key, count) with zero rows for each key from its first window to the last of all."""
    last = counts.agg(F.max("window_start").alias("hi"))
    first = counts.groupBy(key).agg(F.min("window_start").alias("lo"))
    grid = first.crossJoin(F.broadcast(last)).select(key, F.explode(F.expr(f"sequence(lo, hi, interval {size})")).alias("window_start"))
    return grid.join(counts, [key, "window_start"], "left").select("window_start", key, F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def _minutes(size: str) -> str:
    return f"interval {size}"


def trend_snapshot(df: DataFrame, ts: str, key: str, size: str = "10 minutes", origin: str | None = None) -> DataFrame:
    """window_end, key, current, time_text, previous of every key and window, empty windows included.

    time_text is the window's end in milliseconds since ``origin`` (the start of
    the first window by default), eight digits at least.
    """
    timed = _timed(df, ts, "0 seconds").where(F.col(key).isNotNull())
    counts = timed.groupBy(F.window("_ts", size).alias("w"), F.col(key).alias("key")).agg(F.count("*").alias("count"))
    dense = densify(counts.select(F.col("w.start").alias("window_start"), "key", "count"), "key", size)
    before = F.lag("count", 1, 0).over(Window.partitionBy("key").orderBy("window_start"))
    end = F.expr(f"window_start + {_minutes(size)}")
    if origin is None:
        dense = dense.crossJoin(F.broadcast(dense.agg(F.min("window_start").alias("_origin"))))
    else:
        dense = dense.withColumn("_origin", F.lit(origin).cast("timestamp"))
    ms = (F.unix_millis(end) - F.unix_millis("_origin")).cast("string")
    return dense.select(
        end.alias("window_end"), "key", F.col("count").alias("current"),
        F.lpad(ms, 8, "0").alias("_short"), ms.alias("_long"), before.cast("long").alias("previous"),
    ).select(
        "window_end", "key", "current", F.when(F.length("_long") > 8, F.col("_long")).otherwise(F.col("_short")).alias("time_text"), "previous"
    )


def alert_text(key: Column, current: Column, previous: Column, at: Column) -> Column:
    return F.format_string("Number of arrivals to %s has doubled from %d to %d at %d!", key, previous, current, at)


def trend_alerts(snapshot: DataFrame, min_count: int = 10, ratio: float = 2) -> DataFrame:
    """Rows of a snapshot whose count is ``min_count`` at least and ``ratio`` times the one before; with a message."""
    hot = snapshot.where((F.col("current") >= min_count) & (F.col("current") >= ratio * F.col("previous")))
    return hot.withColumn("message", alert_text(F.col("key"), F.col("current"), F.col("previous"), F.col("time_text").cast("long")))
