"""Reports over health snapshots, probes, snippets, rich contents and connections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: States that an alert of each threshold takes (fixed values).
ALERT_STATES = {"yellow": ("minimal", "impaired", "down"), "red": ("impaired", "down"), "none": ("down",)}
CONTENT = "attachments array<struct<type: string>>, rich_content struct<blocks: array<struct<type: string>>>"


def histogram(values: DataFrame, key: str, value: str) -> DataFrame:
    """key and histogram: `value:count` of each value, the commonest first."""
    counts = values.groupBy(key, value).agg(F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("order"), F.col(value).alias("v"))))
    return counts.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: F.concat(x["v"], F.lit(":"), (-x["order"]).cast("string"))), ",").alias("histogram"))


def rich_content(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Per provider: sessions, messages, rich messages, and histograms of attachment and block types. messages: session_id, content_json."""
    parsed = messages.join(sessions.select(F.col("id").alias("its_session"), F.coalesce("provider", F.lit("(unknown)")).alias("provider")), F.col("session_id") == F.col("its_session"))
    parsed = parsed.select("provider", "session_id", F.from_json("content_json", CONTENT).alias("c"))
    types = [F.transform("c.attachments", lambda x: x["type"]), F.transform("c.rich_content.blocks", lambda x: x["type"])]
    out = parsed.groupBy("provider").agg(F.count_distinct("session_id").alias("sessions"), F.count("*").alias("messages"), F.count_if((F.coalesce(F.size(types[0]), F.lit(0)) > 0) | (F.coalesce(F.size(types[1]), F.lit(0)) > 0)).alias("rich"))
    for name, values in zip(("attachments", "blocks"), types):
        part = histogram(parsed.select("provider", F.explode(values).alias("type")), "provider", "type")
        out = out.join(part.withColumnRenamed("histogram", name), "provider", "left")
    return out.fillna("", ["attachments", "blocks"])


def alerts(snapshot: DataFrame, threshold: str, suppress_phase_b: bool = False, suppressed: tuple[str, ...] = ()) -> DataFrame:
    """Scenarios at or beyond the threshold, with the legs that fail. Grey ones (no signal yet) raise none.

    snapshot: scenario_id, status, color, phase_b, legs (source, health).
    """
    found = snapshot.where((F.col("color") != "grey") & F.col("status").isin(*ALERT_STATES[threshold]) & ~F.col("scenario_id").isin(*suppressed))
    if suppress_phase_b:
        found = found.where(~F.col("phase_b"))
    return found.select("scenario_id", "status", F.filter("legs", lambda x: x["health"].isin("red", "yellow", "unknown")).alias("failed_legs"))


def failures(results: DataFrame, with_skips: bool = False) -> DataFrame:
    """Failed (and skipped) results by target and case."""
    return results.where(F.col("status").isin(*(["fail", "skip"] if with_skips else ["fail"]))).orderBy("target", F.asc_nulls_first("case_id"), "id")


def snippets(rows: DataFrame, category: str | None = None, domain: str | None = None, favorited_only: bool = False, holds: Column | None = None, last: int = 50) -> DataFrame:
    """The newest snippets for which every given clause holds."""
    for column, value in (("category", category), ("domain", domain)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    if favorited_only:
        rows = rows.where("favorited = 1")
    if holds is not None:
        rows = rows.where(holds)
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(last)


def domains(rows: DataFrame, include_inactive: bool = False) -> DataFrame:
    return (rows if include_inactive else rows.where("active")).orderBy("domain")


def connections(frames: DataFrame) -> DataFrame:
    """Per connection (pair_id): frames each way, bytes and seconds from the first to the last. frames: pair_id, ts, direction, body."""
    return frames.groupBy("pair_id").agg(F.count("*").alias("frames"), F.count_if(F.col("direction") == "request").alias("sent"), F.sum(F.octet_length("body")).alias("bytes"), (F.max("ts") - F.min("ts")).alias("seconds"))


def gap_sessions(events: DataFrame, key: str, ts: str, gap: float) -> DataFrame:
    """Events of a key no more than gap seconds apart are one session: key, start, end, events."""
    order = Window.partitionBy(key).orderBy(ts)
    begins = (F.col(ts) - F.lag(ts).over(order) > gap) | F.lag(ts).over(order).isNull()
    numbered = events.select(key, ts, begins.cast("int").alias("begins")).withColumn("nth", F.sum("begins").over(order))
    return numbered.groupBy(key, "nth").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("events")).drop("nth")


def result_scores(results: DataFrame, messages: DataFrame) -> DataFrame:
    """result_id and score: half the messages' mean score, and what having both roles, a key, a model and several
    messages adds, seven tenths of it beside three tenths of the normaliser's confidence.

    results: result_id, session_key, model_name, confidence; messages: result_id, role, score.
    """
    own = messages.groupBy(F.col("result_id").alias("its_id")).agg(F.avg("score").alias("mean"), F.count("*").alias("n"), (F.bool_or(F.col("role") == "user") & F.bool_or(F.col("role") == "assistant")).alias("both"))
    met = results.join(own, F.col("result_id") == F.col("its_id"), "left")
    given = lambda c, x: F.when(c, x).otherwise(0.0)
    n = F.coalesce("n", F.lit(0))
    quality = F.coalesce("mean", F.lit(0.0)) * 0.5 + given(F.col("both"), 0.15) + given(F.coalesce("session_key", F.lit("")) != "", 0.10) + given(F.coalesce("model_name", F.lit("")) != "", 0.10) + F.when(n >= 4, 0.10).when(n >= 2, 0.05).otherwise(0.0)
    return met.select("result_id", F.round(F.least(F.lit(1.0), quality * 0.7 + F.col("confidence") * 0.3), 6).alias("score"))
