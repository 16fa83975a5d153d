"""The trend detector on a stream, with keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "window_end timestamp, key string, current bigint, previous bigint"


def trending_stream(df: DataFrame, ts: str, key: str, minutes: int = 10) -> DataFrame:
    """window_end, key, current, previous: a row for each key and finished window, empty ones included.

    A window of a key is finished when an event of a later one has come; events
    of finished windows are late and dropped.  The state of a key is its open
    window, the count so far and the count before; gaps are filled with zeros.
    """
    step = minutes * 60
    events = df.select(F.col(key).alias("key"), F.unix_timestamp(F.window(F.col(ts).cast("timestamp"), f"{minutes} minutes").end).alias("end"))

    def update(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ends = pd.concat([p["end"] for p in parts]).value_counts().sort_index()
        last, count, before = state.get if state.exists else (int(ends.index[0]), 0, 0)
        out = []
        for end, n in ends.items():
            if end < last:
                continue
            while last < end:
                out.append((last, count, before))
                last, count, before = last + step, 0, count
            count += int(n)
        state.update((last, count, before))
        yield pd.DataFrame(
            {"window_end": pd.to_datetime([o[0] for o in out], unit="s"), "key": k[0], "current": [o[1] for o in out], "previous": [o[2] for o in out]}
        )

    schema = "last bigint, count bigint, before bigint"
    return events.groupBy("key").applyInPandasWithState(update, OUT, schema, "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None, timeout: int = 120) -> DataFrame:
    """Runs a stream over what its source has, into a memory table of that name."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    query = writer.start()
    try:
        if not query.awaitTermination(timeout):
            raise TimeoutError(name)
    finally:
        query.stop()
    return stream.sparkSession.table(name)
