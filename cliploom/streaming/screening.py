"""Screening of signal streams: windowed energy with late data, and turns as sessions of state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_energy(events: DataFrame, key: str = "user_id", ts: str = "ts", value: str = "value", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """key, window start, n, energy: rows later than the watermark are dropped, windows are emitted once they are closed."""
    energy = F.least(F.lit(1.0), F.col(value) / 500)
    rows = events.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", late)
    return rows.groupBy(key, F.window("_at", width)).agg(F.count(F.lit(1)).alias("n"), F.avg(energy).alias("energy")).select(key, F.col("window.start").alias("start"), "n", "energy")


def turns(spans: DataFrame, key: str = "asset_id", gap: float = 0.9) -> DataFrame:
    """key, start_sec, end_sec, span_count of closed turns, from a stream of spans (key, ts, start_sec, end_sec).

    A turn closes when a span starts more than `gap` after the last one's end, or when the watermark passes its last span.
    Spans of one key are taken in order of start within a batch.
    """

    def update(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        closed = []
        start, end, reach, n = state.get if state.exists else (None, None, None, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({key: [name[0]], "start_sec": [start], "end_sec": [reach], "span_count": [n]})
            return
        rows = pd.concat(list(frames)).sort_values(["start_sec", "end_sec"])
        for s, e in zip(rows["start_sec"], rows["end_sec"]):
            if n and s - end > gap:
                closed.append((name[0], start, reach, n))
                n = 0
            if not n:
                start, reach = s, e
            else:
                reach = max(reach, e)
            end, n = e, n + 1
        state.update((start, end, reach, n))
        state.setTimeoutTimestamp(int(rows["ts"].max().timestamp() * 1000) + max(1, int(gap * 1000)))
        yield pd.DataFrame(closed, columns=[key, "start_sec", "end_sec", "span_count"])

    kind = dict(spans.dtypes)[key]
    rows = spans.withWatermark("ts", "1 second")
    return rows.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, start_sec double, end_sec double, span_count int", "start_sec double, last_end double, reach double, span_count int", "append", GroupStateTimeout.EventTimeTimeout)
