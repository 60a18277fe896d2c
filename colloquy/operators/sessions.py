"""Sessions and their messages: turns, branches, tags, counters and duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def with_turns(messages: DataFrame) -> DataFrame:
    """Numbers the messages of a session that have no turn_index, by time and id."""
    turn = F.row_number().over(Window.partitionBy("session_id").orderBy("ts", "id")) - 1
    return messages.withColumn("turn_index", F.coalesce("turn_index", turn))


def appended_turns(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """turn_index of incoming messages: on from the largest of their session and branch."""
    top = existing.groupBy("session_id", "branch_id").agg(F.max("turn_index").alias("top"))
    nth = F.row_number().over(Window.partitionBy("session_id", "branch_id").orderBy("ts", "id"))
    return incoming.join(top, ["session_id", "branch_id"], "left").withColumn("turn_index", F.coalesce("top", F.lit(-1)) + nth).drop("top")


def squash(messages: DataFrame) -> DataFrame:
    """Of consecutive messages of one role the last one."""
    order = Window.partitionBy("session_id").orderBy("ts", F.coalesce("turn_index", F.lit(-1)), "id")
    following = messages.withColumn("next_role", F.lead("role").over(order)).withColumn("is_last", F.lead("id").over(order).isNull())
    return following.where(F.col("is_last") | ~F.col("role").eqNullSafe(F.col("next_role"))).drop("next_role", "is_last")


def collapse_branches(messages: DataFrame) -> DataFrame:
    """The current path of each session: the branch with the newest message (the main one of equally new ones), after
    what the main branch has before the fork; then squashed.

    The fork is at the parent of the winning branch's first message: by turn where the parent has one, else by time and
    id; without a parent, the main branch counts up to the winning branch's first time.
    """
    rows = messages.withColumn("branch_id", F.coalesce("branch_id", F.lit("0")))
    branches = rows.groupBy("session_id", "branch_id").agg(F.max("ts").alias("newest"), F.min(F.struct("ts", "id", "branch_parent_id")).alias("first"))
    rank = F.struct("newest", (F.col("branch_id") == "0").alias("main"), "branch_id")
    winners = branches.groupBy("session_id").agg(F.max_by(F.struct("branch_id", "first"), rank).alias("w")).select("session_id", F.col("w.branch_id").alias("winner"), F.col("w.first.ts").alias("first_ts"), F.col("w.first.branch_parent_id").alias("parent_id"))
    parents = rows.where("branch_id = '0'").select("session_id", F.col("id").alias("parent_id"), F.col("turn_index").alias("parent_turn"), F.col("ts").alias("parent_ts"))
    plan = winners.join(parents, ["session_id", "parent_id"], "left")
    by_turn = F.col("turn_index") < F.col("parent_turn")
    by_time = F.struct("ts", "id") < F.struct(F.col("parent_ts").alias("ts"), F.col("parent_id").alias("id"))
    shared = F.when(F.col("parent_turn").isNotNull(), by_turn).when(F.col("parent_ts").isNotNull(), by_time).otherwise(F.col("ts") < F.col("first_ts"))
    kept = rows.join(plan, "session_id").where((F.col("branch_id") == F.col("winner")) | ((F.col("branch_id") == "0") & F.coalesce(shared, F.lit(False))))
    return squash(kept.select(*rows.columns))


def forks(messages: DataFrame) -> DataFrame:
    """Gives a branch to messages of the main branch that differ in text from the first one with their parent_uuid and role."""
    order = Window.partitionBy("session_id", "parent_uuid", "role").orderBy("ts", "id")
    first_id, first_text = F.first("id").over(order), F.first(F.coalesce("content_text", F.lit(""))).over(order)
    forked = F.col("parent_uuid").isNotNull() & (F.col("parent_uuid") != "") & (F.coalesce("content_text", F.lit("")) != F.col("first_text")) & (F.coalesce("branch_id", F.lit("0")) == "0")
    rows = messages.withColumns({"first_id": first_id, "first_text": first_text}).withColumn("forked", forked)
    return rows.withColumns({"branch_parent_id": F.when(F.col("forked"), F.coalesce("branch_parent_id", "first_id")).otherwise(F.col("branch_parent_id")), "branch_id": F.when(F.col("forked"), T.short_id(F.col("id").cast("string"), 12)).otherwise(F.col("branch_id"))}).drop("first_id", "first_text", "forked")


def branch_counts(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    n = messages.groupBy(F.col("session_id").alias("id")).agg(F.countDistinct("branch_id").alias("branches"))
    return sessions.join(n, "id", "left").withColumn("branches", F.coalesce(F.nullif("branches", F.lit(0)), F.lit(1)))


def counter_drift(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions whose stored message_count isn't what they have."""
    n = messages.groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("actual"))
    return sessions.join(n, "id", "left").select("id", F.col("message_count").alias("stored"), F.coalesce("actual", F.lit(0)).alias("actual")).where("stored <> actual")


def repeats(messages: DataFrame) -> DataFrame:
    """All but the first message of a session with the same role and first 200 characters."""
    order = Window.partitionBy("session_id", "role", F.substring(F.coalesce("content_text", F.lit("")), 1, 200)).orderBy("ts", "id")
    return messages.withColumn("nth", F.row_number().over(order)).where("nth > 1").drop("nth")


def tags(messages: DataFrame) -> DataFrame:
    """Language, topics, tokens and models of each session. Texts are never gathered: counts and hits per message are summed."""
    text = F.coalesce("content_text", F.lit(""))
    n = lambda p: F.sum(F.regexp_count(text, F.lit(p)))
    hits = {t: [F.max(h.cast("int")).alias(f"{t}_{i}") for i, h in enumerate(T.keyword_hits(F.col("content_text"), t))] for t in T.TOPICS}
    per = messages.groupBy("session_id").agg(n(T.HAN).alias("han"), n(T.KANA).alias("kana"), n(T.HANGUL).alias("hangul"), n("[A-Za-z]").alias("latin"), F.coalesce(F.sum("token_estimate"), F.lit(0)).alias("total_tokens"), F.array_join(F.array_sort(F.collect_set("model_name")), ",").alias("models"), *[h for hs in hits.values() for h in hs])
    score = lambda t: sum((F.col(f"{t}_{i}") for i in range(1, len(hits[t]))), F.col(f"{t}_0"))
    found = F.concat_ws(",", *[F.when(score(t) >= 2, F.lit(t)) for t in sorted(T.TOPICS)])
    return per.select("session_id", T.dominant_language(F.col("han"), F.col("kana"), F.col("hangul"), F.col("latin")).alias("language"), found.alias("topics"), "total_tokens", "models")


def newest_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the rows of each key the newest one, by a partial aggregate: no window, so a hot key is summed where it is."""
    kept = F.max_by(F.struct("*"), F.struct(*order)).alias("newest")
    return df.groupBy(*keys).agg(kept).select("newest.*")


def positional_new(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming messages that a session doesn't have yet: the nth with a key is new if the session has fewer than n such."""
    key = T.message_key(F.col("role"), F.col("content_text"))
    have = existing.groupBy("session_id", key.alias("key")).agg(F.count("*").alias("have"))
    nth = F.row_number().over(Window.partitionBy("session_id", "key").orderBy("ts", "id"))
    numbered = incoming.withColumn("key", key).withColumn("nth", nth)
    return numbered.join(have, ["session_id", "key"], "left").where(F.col("nth") > F.coalesce("have", F.lit(0))).drop("key", "nth", "have")


def set_new(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """As positional_new, but a key counts once: repeats within a session are dropped."""
    key = T.message_key(F.col("role"), F.col("content_text"))
    fresh = incoming.withColumn("key", key).join(existing.select("session_id", key.alias("key")).distinct(), ["session_id", "key"], "left_anti")
    first = F.min_by(F.struct(*incoming.columns), F.struct("ts", "id")).alias("m")
    return fresh.groupBy("session_id", "key").agg(first).select("m.*")
