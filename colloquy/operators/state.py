"""Greedy state machines over ordered rows of a key, as batch jobs.

Whether a row is accepted depends on the rows accepted before it, so no window function says it. Rows are dealt by key
and sorted on disk; each task folds its rows as they stream by and keeps one key's state only (at most `limit` times),
so a hot key takes time in one task but no memory.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def greedy(df: DataFrame, keys: list[str], ts: str, tie: str, accept, name: str = "accepted") -> DataFrame:
    """Adds a boolean. accept() makes a fresh function of (seconds) for every key; it is called in order of (ts, tie)."""
    key = F.to_json(F.struct(*keys))
    rows = df.select("*", key.alias("__key")).repartition("__key").sortWithinPartitions("__key", ts, tie)
    at_key, at_ts, names = len(df.columns), df.columns.index(ts), [*df.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, fold = None, None
        for batch in batches:
            out = []
            for k, t in zip(batch.column(at_key).to_pylist(), batch.column(at_ts).to_pylist()):
                if fold is None or k != current:
                    current, fold = k, accept()
                out.append(fold(t))
            yield pa.RecordBatch.from_arrays([*batch.columns[:at_key], pa.array(out, pa.bool_())], names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return rows.mapInArrow(run, f"{fields}, `{name}` boolean")


def first_in_window(window: float):
    """Accepts a time more than window after the last accepted one: repeats don't prolong it."""

    def fresh():
        last = None

        def fold(t: float) -> bool:
            nonlocal last
            if last is None or t - last > window:
                last = t
                return True
            return False

        return fold

    return fresh


def at_most_every(window: float):
    """Accepts a time at least window after the last accepted one."""

    def fresh():
        last = None

        def fold(t: float) -> bool:
            nonlocal last
            if last is None or t - last >= window:
                last = t
                return True
            return False

        return fold

    return fresh


def burst(limit: int, window: float = 1.0):
    """Accepts at most limit times within the trailing window."""

    def fresh():
        accepted: deque = deque()

        def fold(t: float) -> bool:
            while accepted and accepted[0] < t - window:
                accepted.popleft()
            if len(accepted) >= limit:
                return False
            accepted.append(t)
            return True

        return fold

    return fresh


def deduplicated(captures: DataFrame, keys: list[str], window: float = 30.0) -> DataFrame:
    return greedy(captures, keys, "created_at", "id", first_in_window(window), "is_primary")


def throttled(beacons: DataFrame, heartbeat: float = 60.0, limit: int = 10, window: float = 1.0) -> DataFrame:
    """Beacons with `accepted`: heartbeats (no case_id) and case beacons have limits of their own per lane and target."""
    beats = greedy(beacons.where("case_id is null"), ["lane", "target"], "ts", "id", at_most_every(heartbeat))
    return beats.unionByName(greedy(beacons.where("case_id is not null"), ["lane", "target"], "ts", "id", burst(limit, window)))
