"""Prompts whose answer never came: requests without a response, read for what the user said."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dispatch import dispatched
from .joins import orphan_requests

MIN_AGE = 30.0
#: Whose messages a request tells for certain (fixed values).
TOLD = ("user", "system", "tool")


def recovered_prompts(captures: DataFrame, messages: DataFrame, now: float, min_age: float = MIN_AGE, reason: str = "cancelled") -> DataFrame:
    """The messages of requests older than min_age seconds that have neither a response nor a message, each marked with reason.

    captures hold id, created_at, source_id, direction, pair_id, provider, host, path, model_name and body; messages
    capture_pair_id. Of several requests of a pair the first counts (by created_at, then id). Assistants' messages are
    left out, as a request says nothing certain about them; pairs without an id or a source, and those that no parser
    reads, give nothing. Once the result is among the messages, a second run gives nothing. Two anti joins and one
    aggregate, all by pair.
    """
    fields = ("created_at", "id", "source_id", "provider", "host", "path", "model_name", "body")
    named = captures.where("pair_id <> '' and source_id <> ''")
    first = orphan_requests(named, messages, min_age, now).groupBy("pair_id").agg(F.min_by(F.struct(*fields), F.struct("created_at", "id")).alias("r"))
    requests = first.select("pair_id", "r.*").withColumn("request", F.col("body"))
    pairs = requests.select("pair_id", F.lit("request").alias("direction"), "provider", "host", "path", "request", F.lit("").alias("response"), "model_name", "created_at")
    told = dispatched(pairs).withColumn("told", F.filter("messages", lambda m: F.lower(m["role"]).isin(*TOLD)))
    rows = told.select("pair_id", "parser", "session_key", "provider", F.posexplode("told").alias("turn_index", "m"))
    known = requests.select("pair_id", "source_id", "created_at")
    return rows.join(known, "pair_id").select("pair_id", "source_id", "created_at", "parser", "session_key", "provider", "turn_index", F.col("m.role").alias("role"), F.col("m.content").alias("content_text"), F.lit(reason).alias("interaction_kind"))
