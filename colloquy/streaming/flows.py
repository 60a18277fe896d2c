"""Streaming forms: deduplication, throttling, pairing and windows with watermarks. Times are event times."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def repeats_dropped(events: DataFrame, keys: list[str], ts: str, window: str = "30 seconds") -> DataFrame:
    """One row per key within the watermark. State may be held longer than the window, so a late repeat may go too."""
    return events.withWatermark(ts, window).dropDuplicatesWithinWatermark(keys)


def throttled(events: DataFrame, keys: list[str], ts: str, every: float, lateness: str = "1 minute") -> DataFrame:
    """Rows at least `every` seconds after the last accepted one of their key; the state is that one time, dropped when it is stale."""
    columns = [f.name for f in events.schema.fields]

    def accept(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts)).sort_values(ts, kind="stable")
        last = state.get[0] if state.exists else None
        kept = []
        for i, t in enumerate(rows[ts]):
            seconds = pd.Timestamp(t).timestamp()
            if last is None or seconds - last >= every:
                last = seconds
                kept.append(i)
        state.update((last,))
        state.setTimeoutTimestamp(max(int((last + every) * 1000), state.getCurrentWatermarkMs() + 1))
        yield rows.iloc[kept][columns]

    grouped = events.withWatermark(ts, lateness).groupBy(*keys)
    return grouped.applyInPandasWithState(accept, events.schema, "last double", "append", GroupStateTimeout.EventTimeTimeout)


def paired(requests: DataFrame, responses: DataFrame, ttl: str = "30 seconds") -> DataFrame:
    """Requests (pair_id, requested_at, request) with responses (pair_id, responded_at, response) within ttl; orphans come with nulls."""
    left = requests.withWatermark("requested_at", ttl)
    right = responses.withWatermark("responded_at", ttl).withColumnRenamed("pair_id", "its_pair")
    met = F.expr(f"pair_id = its_pair and responded_at >= requested_at and responded_at <= requested_at + interval {ttl}")
    return left.join(right, met, "left_outer").drop("its_pair")


def per_window(events: DataFrame, ts: str, length: str, lateness: str, keys: list[str], slide: str | None = None) -> DataFrame:
    """Counts per (sliding) window and keys."""
    return events.withWatermark(ts, lateness).groupBy(F.window(ts, length, slide), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")
