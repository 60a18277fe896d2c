"""From captured bodies to messages: parsing of requests, responses and event streams, and the merge of two views.

JSON stays text until a field is needed; what doesn't parse is null, never an error.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T

_REQUEST = "struct<model:string,messages:array<struct<role:string,content:string>>,system:string>"
_ANTHROPIC = "struct<model:string,role:string,content:array<struct<type:string,text:string>>>"
_OPENAI = "struct<model:string,choices:array<struct<message:struct<role:string,content:string>>>>"


_EVENT = "struct<choices:array<struct<delta:struct<content:string>,message:struct<content:string>>>,delta:struct<type:string,text:string>>"


def _json(c: Column, schema: str) -> Column:
    return F.from_json(c, schema, {"mode": "PERMISSIVE"})


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which stands in the plan, and is worked out, once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def plain_content(c: Column) -> Column:
    """The text of a content value: a string as it is; of a list of blocks the texts, a line each."""
    blocks = _json(c, "array<struct<type:string,text:string>>")
    return F.when(F.ltrim(c).startswith("["), F.array_join(F.filter(F.transform(blocks, lambda b: b["text"]), lambda t: t.isNotNull()), "\n")).otherwise(c)


def request_messages(body: Column) -> Column:
    """array<struct<role, content>> of a chat request in either dialect; a system text of its own comes first."""
    none = F.array().cast("array<struct<role:string,content:string>>")

    def of(r: Column) -> Column:
        listed = F.transform(F.coalesce(r["messages"], none), lambda m: F.struct(T.role_name(m["role"]).alias("role"), plain_content(m["content"]).alias("content")))
        return F.concat(F.when(r["system"].isNotNull(), F.array(F.struct(F.lit("system").alias("role"), plain_content(r["system"]).alias("content")))).otherwise(none), listed)

    return let(_json(body, _REQUEST), of)


def response_message(body: Column) -> Column:
    """struct<role, content> of a chat response in either dialect, or of an event stream of one; null if there is none."""
    whole = F.when(is_event_stream(body), stream_text(body)).otherwise(F.coalesce(F.get(_json(body, _OPENAI)["choices"], F.lit(0))["message"]["content"], _blocks(body)))
    return let(whole, lambda w: F.when(w.isNotNull() & (w != ""), F.struct(F.lit("assistant").alias("role"), w.alias("content"))))


def _blocks(body: Column) -> Column:
    content = _json(body, _ANTHROPIC)["content"]
    return F.array_join(F.transform(F.filter(content, lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")


def model_of(body: Column) -> Column:
    return F.get_json_object(body, "$.model")


def is_event_stream(body: Column) -> Column:
    return body.rlike(r"(?m)^\s*data:")


def stream_chunks(body: Column) -> Column:
    """The JSON texts of the data lines of an event stream, in order."""
    lines = F.transform(F.split(body, "\n"), lambda x: F.trim(x))
    data = F.transform(F.filter(lines, lambda x: x.startswith("data:")), lambda x: F.trim(F.substring(x, 6, 1 << 30)))
    return F.filter(data, lambda x: (x != "") & (x != "[DONE]"))


def stream_text(body: Column) -> Column:
    """The text that an event stream carries, in either dialect: all its deltas in order, without a shuffle; each line is parsed once."""
    delta = lambda e: F.coalesce(F.get(e["choices"], F.lit(0))["delta"]["content"], F.when(e["delta"]["type"] == "text_delta", e["delta"]["text"]))
    some = lambda texts: F.filter(texts, lambda t: t.isNotNull())

    def of(events: Column) -> Column:
        whole = F.get(some(F.transform(events, lambda e: F.get(e["choices"], F.lit(0))["message"]["content"])), F.lit(0))
        return let(some(F.transform(events, delta)), lambda parts: F.when(F.size(parts) > 0, F.array_join(parts, "")).otherwise(whole))

    return let(F.transform(stream_chunks(body), lambda x: _json(x, _EVENT)), of)


def fold_patches(stream: str | None) -> str | None:
    """The text after all patch events of a stream ({p, o, v}, and bare {v} that go on with the last path) are applied."""
    if not stream:
        return None
    text, path, op = "", "/message/content/parts/0", "append"
    for line in stream.split("\n"):
        line = line.strip()
        if not line.startswith("data:"):
            continue
        try:
            event = json.loads(line[5:])
        except ValueError:
            continue
        steps = event["v"] if isinstance(event, dict) and event.get("o") == "patch" and isinstance(event.get("v"), list) else [event]
        for step in steps:
            if not isinstance(step, dict) or "v" not in step:
                continue
            path, op = step.get("p", path) or path, step.get("o", op) or op
            value = step["v"]
            if isinstance(value, dict):
                parts = (((value.get("message") or {}).get("content") or {}).get("parts") or []) if isinstance(value.get("message"), dict) else []
                if parts and isinstance(parts[0], str):
                    text = parts[0]
            elif isinstance(value, str) and path.endswith("/content/parts/0"):
                text = text + value if op == "append" else value
    return text or None


def patched_text(c: Column) -> Column:
    def run(streams: pd.Series) -> pd.Series:
        return streams.map(fold_patches)

    return F.pandas_udf(run, StringType())(c)


def normalised(pairs: DataFrame) -> DataFrame:
    """pairs (pair_id, ts, request, response) as messages (pair_id, turn_index, ts, role, content_text, model_name); no shuffle."""
    reply = response_message(F.col("response"))
    all_messages = F.concat(request_messages(F.col("request")), F.when(reply.isNotNull(), F.array(reply)).otherwise(F.array().cast("array<struct<role:string,content:string>>")))
    rows = pairs.select("pair_id", "ts", F.coalesce(model_of(F.col("response")), model_of(F.col("request"))).alias("model_name"), F.posexplode(all_messages).alias("turn_index", "m"))
    return rows.select("pair_id", "turn_index", "ts", F.col("m.role").alias("role"), F.col("m.content").alias("content_text"), "model_name")


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two views of sessions (session_id, role, content_text, model_name, token_estimate, ts) as one.

    Messages meet by role and first 200 characters; of two the longer text stays, and what one lacks the other gives.
    """
    key = T.message_key(F.col("role"), F.col("content_text"))

    def one(df: DataFrame, name: str) -> DataFrame:
        kept = F.min_by(F.struct("content_text", "model_name", "token_estimate", "ts"), F.struct("ts", "content_text")).alias(name)
        return df.withColumn("key", key).groupBy("session_id", "role", "key").agg(kept)

    both = one(a, "x").join(one(b, "y"), ["session_id", "role", "key"], "full_outer")
    length = lambda c: F.coalesce(F.length(c), F.lit(-1))
    text = F.when(length("y.content_text") > length("x.content_text"), F.col("y.content_text")).otherwise(F.col("x.content_text"))
    return both.select("session_id", "role", text.alias("content_text"), *[F.coalesce(f"x.{c}", f"y.{c}").alias(c) for c in ("model_name", "token_estimate")], F.least("x.ts", "y.ts").alias("ts"))
