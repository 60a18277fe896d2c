"""Joins that clean up and repair: orphans, missing partners, retention and resets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .selection import newest


def orphan_requests(captures: DataFrame, messages: DataFrame, min_age: float, now: float) -> DataFrame:
    """Requests older than min_age whose pair has neither a response nor a message."""
    old = captures.where((F.col("direction") == "request") & (F.col("created_at") <= now - min_age))
    answered = captures.where("direction = 'response'").select("pair_id")
    normalised = messages.select(F.col("capture_pair_id").alias("pair_id"))
    return old.join(answered, "pair_id", "left_anti").join(normalised, "pair_id", "left_anti")


def without_role(messages: DataFrame, role: str = "user") -> DataFrame:
    """Sessions that have messages but none of a role."""
    return messages.groupBy("session_id").agg(F.count_if(F.col("role") == role).alias("n")).where("n = 0").select("session_id")


def orphan_sessions(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions without messages that are no favourites."""
    return sessions.where("favorited = 0").join(messages.select(F.col("session_id").alias("id")), "id", "left_anti")


def pending_vectors(messages: DataFrame, vectors: DataFrame, backend: str, model: str) -> DataFrame:
    """Messages without a vector of this backend and model."""
    own = vectors.where((F.col("backend") == backend) & (F.col("model_name") == model)).select(F.col("message_id").alias("id"))
    return messages.where(F.coalesce("content_text", F.lit("")) != "").join(own, "id", "left_anti")


def paired(captures: DataFrame) -> DataFrame:
    """One row per pair: its request and response, the first of each, by one aggregate instead of a self-join."""
    order = F.struct("created_at", "id")
    side = lambda d: F.when(F.col("direction") == d, order)
    pick = lambda c, d: F.min_by(c, side(d))
    rows = captures.where("direction in ('request', 'response')").groupBy("pair_id").agg(
        pick("id", "request").alias("request_id"), pick("id", "response").alias("response_id"), pick("created_at", "request").alias("requested_at"), pick("created_at", "response").alias("responded_at"))
    return rows.where("request_id is not null and response_id is not null")


def rpc_pairs(messages: DataFrame) -> DataFrame:
    """JSON-RPC lines (upstream, ts, from_client, body) as requests, notifications, responses, orphan responses or server-initiated.

    A reused id takes the newest request; a response's latency is the time since then, and an error has status 500.
    """
    method, rpc_id = F.get_json_object("body", "$.method"), F.get_json_object("body", "$.id")
    rows = messages.withColumns({"method": method, "rpc_id": rpc_id})
    asked = rows.where("method is not null and rpc_id is not null and from_client").groupBy("upstream", "rpc_id").agg(F.max("ts").alias("asked_at"), F.max_by("method", "ts").alias("asked_method"))
    met = rows.join(asked, ["upstream", "rpc_id"], "left")
    kind = F.when(F.col("method").isNotNull() & ~F.col("from_client"), "server_initiated").when(F.col("method").isNotNull() & F.col("rpc_id").isNotNull(), "request").when(F.col("method").isNotNull(), "notification").when(F.col("rpc_id").isNull(), "unclassified").when(F.col("asked_at").isNull(), "orphan_response").otherwise("response")
    failed = F.get_json_object("body", "$.error").isNotNull()
    return met.withColumn("kind", kind).select("upstream", "ts", "rpc_id", F.coalesce("method", "asked_method").alias("method"), "kind", F.when(F.col("kind") == "response", F.round((F.col("ts") - F.col("asked_at")) * 1000, 3)).alias("latency_ms"), F.when(F.col("kind").isin("response", "orphan_response"), F.when(failed, 500).otherwise(200)).alias("status_code"))


def allowed_hosts(rows: DataFrame, allowlist: DataFrame, host: str = "host") -> DataFrame:
    """Rows whose host, without its port, is a listed domain or below one: an equality join on the host's suffixes."""
    bare = F.lower(F.regexp_replace(F.regexp_replace(host, r"^\[(.*)\](?::\d+)?$", "$1"), r"^([^:]+):\d+$", "$1"))
    labels = F.split(bare, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keyed = rows.withColumn("row_key", F.monotonically_increasing_id())
    listed = allowlist.select(F.lower("domain").alias("suffix")).distinct()
    hits = keyed.select(*rows.columns, "row_key", F.explode(suffixes).alias("suffix")).join(listed, "suffix")
    return hits.dropDuplicates(["row_key"]).select(*rows.columns)


def legs_filter(legs: list[tuple[str, list[str]]]) -> Column:
    """(source = ... and host in ...) or ..., false without legs."""
    out = F.lit(False)
    for source, hosts in legs:
        out = out | ((F.col("source_id") == source) & F.col("host").isin(*hosts))
    return out


def retained(captures: DataFrame, messages: DataFrame, sessions: DataFrame, cutoff: float, max_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is left of captures, messages and sessions: by age, then the newest max_rows captures, then no orphan sessions.

    """
    favourite = sessions.where("favorited = 1").select(F.col("id").alias("session_id"))
    kept_messages = messages.where(F.col("ts") >= cutoff).unionByName(messages.where(F.col("ts") < cutoff).join(favourite, "session_id", "left_semi").select(*messages.columns))
    young = captures.where(F.col("created_at") >= cutoff)
    kept_captures = newest(young, "created_at", "id", max_rows)
    kept_sessions = sessions.join(kept_messages.select(F.col("session_id").alias("id")), "id", "left_semi").unionByName(sessions.where("favorited = 1").join(kept_messages.select(F.col("session_id").alias("id")), "id", "left_anti"))
    return kept_captures, kept_messages, kept_sessions


def reset(captures: DataFrame, messages: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Everything goes but favourite sessions, their messages, and the captures these came from."""
    favourite = sessions.where("favorited = 1")
    kept = messages.join(favourite.select(F.col("id").alias("session_id")), "session_id", "left_semi")
    return captures.join(kept.select(F.col("capture_pair_id").alias("pair_id")), "pair_id", "left_semi"), kept, favourite


def pruned_log(rows: DataFrame, ts: str, cutoff: float, max_rows: int | None = None) -> DataFrame:
    young = rows.where(F.col(ts) >= cutoff)
    return young if max_rows is None else newest(young, ts, "id", max_rows)
