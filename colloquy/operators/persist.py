"""What a better or later capture changes in stored rows: upgrades, merges, forks, evidence slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def upgraded_sessions(sessions: DataFrame, better: DataFrame) -> DataFrame:
    """sessions with weak provider, title_hint and created_via replaced by what better (id and the same columns, a row per
    id) says: nothing or `unknown`, a title that is nothing or a JSON object, and the browser extension's network capture."""
    new = better.select(F.col("id").alias("its_id"), *[F.col(c).alias(f"new_{c}") for c in ("provider", "title_hint", "created_via")])
    met = sessions.join(new, F.col("id") == F.col("its_id"), "left")
    weak = {
        "provider": (_blank(F.col("provider")) | (F.col("provider") == "unknown")) & (F.col("new_provider") != "unknown"),
        "title_hint": _blank(F.col("title_hint")) | F.col("title_hint").startswith("{"),
        "created_via": _blank(F.col("created_via")) | (F.col("created_via") == "browser_extension_network"),
    }
    for c, is_weak in weak.items():
        value = F.substring(f"new_{c}", 1, 200) if c == "title_hint" else F.col(f"new_{c}")
        met = met.withColumn(c, F.when(is_weak & ~_blank(F.col(f"new_{c}")), value).otherwise(F.col(c)))
    return met.select(*sessions.columns)


def merged_meta(meta: DataFrame, lists: tuple[str, ...], scalars: tuple[str, ...], order: str) -> DataFrame:
    """One row per session_id: lists are joined in order without repeats, of scalars the newest that says something stays."""
    out = []
    for c in lists:
        parts = F.transform(F.array_sort(F.collect_list(F.when(F.size(c) > 0, F.struct(order, c)))), lambda x: x[c])  # noqa: B023
        out.append(F.array_distinct(F.flatten(parts)).alias(c))
    out += [F.max_by(c, F.when(~_blank(F.col(c)), F.col(order))).alias(c) for c in scalars]
    return meta.groupBy("session_id").agg(*out)


def without_repeats(attachments: Column) -> Column:
    """The attachments in order, each of equal ones once (equal as canonical JSON)."""
    return F.array_distinct(F.transform(attachments, lambda x: F.to_json(x)))


def live_forks(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Completions that fork: session_id, completion, fork_of (the stored sibling) and the new branch's id.

    stored: session_id, id, parent_id, role, text, ts. incoming: the same, with completion, what arrived together. A
    completion forks where a stored message of its session has the same parent and role, but another text; the earliest
    such message is the sibling. The same text again is a replay, and a parent that nothing stored has is no fork. Of a
    completion's messages with one parent and role the first counts.
    """
    first = incoming.where("parent_id is not null").groupBy("session_id", "completion", "parent_id", "role").agg(F.min_by(F.struct(F.coalesce("text", F.lit("")).alias("text")), F.struct("ts", "id")).alias("new"))
    old = stored.where("parent_id is not null").select("session_id", "parent_id", "role", F.col("id").alias("sibling"), F.coalesce("text", F.lit("")).alias("its_text"), F.col("ts").alias("its_ts"))
    other = first.join(old, ["session_id", "parent_id", "role"]).where(F.col("new.text") != F.col("its_text"))
    found = other.groupBy("session_id", "completion").agg(F.min(F.struct("its_ts", "sibling"))["sibling"].alias("fork_of"))
    return found.withColumn("branch_id", F.substring(F.sha1(F.concat_ws(":", F.col("completion").cast("string"), "fork_of").cast("binary")), 1, 12))


def evidence_slice(chosen: DataFrame, tables: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """The rows of each table that belong to the chosen sessions (column session_id). tables: name to (rows, their session column)."""
    keys = chosen.select(F.col("session_id").alias("its_session")).distinct()
    return {name: rows.join(keys, F.col(column) == F.col("its_session"), "left_semi") for name, (rows, column) in tables.items()}


def write_slice(parts: dict[str, DataFrame], folder: str) -> None:
    """Each table of a slice as Parquet under folder/name."""
    for name, rows in parts.items():
        rows.write.mode("errorifexists").parquet(f"{folder.rstrip('/')}/{name}")
