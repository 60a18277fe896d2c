"""Quality audits of messages and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Marks in a text that call for structured content beside it.
MARKS = ["[Image]", "[File:", "[Audio", "[Document:", "[Tool call:", "[Citation]", "[Code"]


def audit(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """(provider, rule, n, total) of ten rules. Messages are counted per session first, so that one join by session suffices."""
    text = F.col("content_text")
    marked = F.lit(False)
    for m in MARKS:
        marked = marked | F.contains(F.coalesce(text, F.lit("")), F.lit(m))
    has_json = F.coalesce(F.trim("content_json"), F.lit("")) != "" if "content_json" in messages.columns else F.lit(False)
    # White space around the text doesn't count.
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    per = messages.groupBy("session_id").agg(
        F.count("*").alias("messages"), F.count_if(T.raw_json_left(text)).alias("q1"), F.count_if(T.looks_truncated(trimmed)).alias("q2"), F.count_if(F.col("role") == "user").alias("users"),
        F.count_if(F.col("role") == "assistant").alias("assistants"), F.count_if(marked & ~has_json).alias("q8"), F.count_if(F.col("token_estimate").isNull()).alias("q9"))
    repeated = messages.groupBy("session_id", "role", F.substring(F.coalesce(text, F.lit("")), 1, 200).alias("head")).agg((F.count("*") - 1).alias("more")).groupBy("session_id").agg(F.sum("more").alias("q5"))
    both = sessions.join(per.withColumnRenamed("session_id", "id"), "id", "left").join(repeated.withColumnRenamed("session_id", "id"), "id", "left")
    blank = lambda c: (F.trim(F.coalesce(c, F.lit(""))) == "").cast("int")
    none = lambda c: (F.coalesce(c, F.lit(0)) == 0).cast("int")
    figures = {"Q1": "q1", "Q2": "q2", "Q3": none("users"), "Q4": none("assistants"), "Q5": "q5", "Q6": blank("title_hint"), "Q7": blank("session_key"), "Q8": "q8", "Q9": "q9", "Q10": none("messages")}
    of_messages = {"Q1", "Q2", "Q5", "Q8", "Q9"}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.coalesce(F.col(v) if isinstance(v, str) else v, F.lit(0)).cast("long").alias("n"), (F.coalesce("messages", F.lit(0)) if k in of_messages else F.lit(1)).cast("long").alias("total")) for k, v in figures.items()]))
    return both.select("provider", each.alias("f")).groupBy("provider", "f.rule").agg(F.sum("f.n").alias("n"), F.sum("f.total").alias("total"))
