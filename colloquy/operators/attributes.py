"""Messages as flat, indexed attributes of a span, and back.

A span's attributes name a message's fields by paths: `llm.input_messages.0.message.role`, `....message.content`, and for
its parts `....message.contents.1.message_content.type`. `spans` flattens the messages of a pair into one map;
`messages_of` folds the paths back into nested messages, whatever the order of the keys. Both work within a row, by
built-in expressions; only gathering a pair's messages into its span is an aggregation.

Defined cases: indices need not be without gaps, and are ordered as numbers; keys that aren't such paths are left aside;
null attributes are none; a part of an unknown type keeps its metadata as raw; a message with neither text nor parts keeps its role.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .normalise import let

SIDES = ("llm.input_messages", "llm.output_messages")
PART = "struct<type:string,text:string,url:string,raw:string>"
MESSAGE = f"struct<role:string,content_text:string,parts:array<{PART}>>"
_TYPE, _TEXT, _URL, _META = "message_content.type", "message_content.text", "message_content.image.image.url", "message_content.metadata"


def _entry(key: Column, value: Column) -> Column:
    return F.struct(key.alias("key"), value.alias("value"))


def _joined(*parts: Column | str) -> Column:
    return F.concat_ws(".", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _of_part(path: Column, p: Column) -> Column:
    kind = F.when(p["type"] == "image_url", "image").otherwise(F.coalesce(p["type"], F.lit("unknown")))
    body = F.when(kind == "image", _entry(_joined(path, _URL), p["url"])).when(kind == "text", _entry(_joined(path, _TEXT), p["text"])).otherwise(_entry(_joined(path, _META), p["raw"]))
    return F.array(_entry(_joined(path, _TYPE), kind), body)


def flattened(messages: Column) -> Column:
    """map<string, string> of an array of messages (MESSAGE): those of the assistant are the output, the others the input."""

    def side(name: str, own: Column) -> Column:
        def of(m: Column, i: Column) -> Column:
            path = _joined(name, i)
            head = F.array(_entry(_joined(path, "message.role"), m["role"]), _entry(_joined(path, "message.content"), m["content_text"]))
            parts = F.flatten(F.transform(F.coalesce(m["parts"], F.array().cast(f"array<{PART}>")), lambda p, j: _of_part(_joined(path, "message.contents", j), p)))
            return F.concat(head, parts)

        return F.flatten(F.transform(own, of))

    answers = lambda m: m["role"].eqNullSafe("assistant")
    entries = F.concat(side(SIDES[0], F.filter(messages, lambda m: ~answers(m))), side(SIDES[1], F.filter(messages, answers)))
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def rebuilt(attributes: Column) -> Column:
    """array of messages (MESSAGE): the input's by index, then the output's."""
    return let(F.map_entries(attributes), lambda entries: F.concat(*[_side(entries, s) for s in SIDES]))


def _side(entries: Column, name: str) -> Column:
    pattern = "^" + name.replace(".", r"\.") + r"\.(\d{1,9})\.message\.(.+)$"
    under = F.filter(entries, lambda e: e["key"].rlike(pattern))
    parsed = F.transform(under, lambda e: F.struct(F.regexp_extract(e["key"], pattern, 1).cast("int").alias("i"), F.regexp_extract(e["key"], pattern, 2).alias("sub"), e["value"].alias("value")))

    def of(known: Column) -> Column:
        indices = F.array_sort(F.array_distinct(F.transform(known, lambda e: e["i"])))
        return F.transform(indices, lambda i: let(F.filter(known, lambda e: e["i"] == i), _message))

    return let(parsed, of)


def _value(entries: Column, sub: str) -> Column:
    return F.get(F.filter(entries, lambda e: e["sub"] == sub), F.lit(0))["value"]


def _message(own: Column) -> Column:
    inside = r"^contents\.(\d{1,9})\.(.+)$"
    parts = F.transform(F.filter(own, lambda e: e["sub"].rlike(inside)), lambda e: F.struct(F.regexp_extract(e["sub"], inside, 1).cast("int").alias("i"), F.regexp_extract(e["sub"], inside, 2).alias("sub"), e["value"].alias("value")))

    def of(known: Column) -> Column:
        indices = F.array_sort(F.array_distinct(F.transform(known, lambda e: e["i"])))
        return F.transform(indices, lambda i: let(F.filter(known, lambda e: e["i"] == i), _part))

    return F.struct(_value(own, "role").alias("role"), _value(own, "content").alias("content_text"), let(parts, of).alias("parts"))


def _part(own: Column) -> Column:
    kind = F.coalesce(_value(own, _TYPE), F.lit("unknown"))
    is_image, is_text = kind == "image", kind == "text"
    cells = {"type": F.when(is_image, "image_url").otherwise(kind), "text": F.when(is_text, F.coalesce(_value(own, _TEXT), F.lit(""))), "url": F.when(is_image, F.coalesce(_value(own, _URL), F.lit(""))), "raw": F.when(~is_image & ~is_text, F.coalesce(_value(own, _META), F.lit("")))}
    return F.struct(*[c.alias(n) for n, c in cells.items()])


def spans(messages: DataFrame) -> DataFrame:
    """pair_id, start_time, attributes of messages (pair_id, turn_index, ts, role, content_text, parts), a row per pair."""
    cell = F.struct("turn_index", F.struct("role", "content_text", F.col("parts").cast(f"array<{PART}>").alias("parts")).alias("m"))
    gathered = messages.groupBy("pair_id").agg(F.min("ts").alias("start_time"), F.array_sort(F.collect_list(cell)).alias("all"))
    return gathered.select("pair_id", "start_time", flattened(F.transform("all", lambda x: x["m"])).alias("attributes"))


def messages_of(found: DataFrame) -> DataFrame:
    """pair_id, turn_index, ts, role, content_text, parts of spans (pair_id, start_time, attributes)."""
    rows = found.select("pair_id", F.col("start_time").alias("ts"), F.posexplode(rebuilt(F.col("attributes"))).alias("turn_index", "m"))
    return rows.select("pair_id", "turn_index", "ts", "m.role", "m.content_text", "m.parts")
