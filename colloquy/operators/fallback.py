"""Messages from request and response bodies in none of the dialects that `normalise` knows, with a confidence.

Four shapes are tried in order: a `messages` list with `choices`; an assistant inside another product (`aiSessionId`, or
a `prompt` sent to such a host); `contents` of parts with `candidates`; and a bare `prompt` with a completed text. All of
it is one pass of built-in expressions over the pairs, without a shuffle.

Defined cases: a null or malformed request fits no shape and gives no row; a null or malformed response gives the
request's messages where the shape allows one side; blank messages are left out; repeated pairs give repeated rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .normalise import plain_content

_PARTS = "array<struct<text:string>>"
_TURN = "struct<role:string,content:string>"
_REQUEST = f"struct<model:string,messages:array<{_TURN}>,conversation_id:string,session_id:string,prompt:string,context:string,aiSessionId:string,contents:array<struct<role:string,parts:{_PARTS}>>>"
_RESPONSE = f"struct<model:string,modelVersion:string,choices:array<struct<message:{_TURN},delta:{_TURN}>>,candidates:array<struct<content:struct<parts:{_PARTS}>>>,completion:string,text:string,output:string,generated_text:string>"
_MESSAGES = f"array<{_TURN}>"


def _turn(role: Column | str, content: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), content.alias("content"))


def _listed(c: Column) -> Column:
    """A list without nulls and blank contents, empty for null."""
    return F.filter(F.coalesce(c, F.array().cast(_MESSAGES)), lambda m: F.trim(F.coalesce(m["content"], F.lit(""))) != "")


def _one(role: str, content: Column) -> Column:
    return _listed(F.array(_turn(role, content)))


def _text(*columns: Column) -> Column:
    """The first one that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def _part_text(parts: Column) -> Column:
    return F.array_join(F.filter(F.transform(parts, lambda p: p["text"]), lambda t: t.isNotNull()), "\n")


def _both_roles(messages: Column) -> Column:
    return F.exists(messages, lambda m: m["role"] == "user") & F.exists(messages, lambda m: m["role"] == "assistant")


def _points(*points: tuple[Column, int]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(condition, n).otherwise(0) for condition, n in points])


def recovered(pairs: DataFrame) -> DataFrame:
    """pairs (pair_id, host, request, response) as pair_id, shape, messages, model_name, session_key, title, confidence.

    A row per pair that fits a shape.
    """
    q, r = F.from_json("request", _REQUEST), F.from_json("response", _RESPONSE)
    asked = F.transform(q["messages"], lambda m: _turn(F.coalesce(m["role"], F.lit("user")), plain_content(m["content"])))
    reply = lambda c: F.coalesce(c["message"], c["delta"])
    chosen = F.transform(r["choices"], lambda c: _turn(F.coalesce(reply(c)["role"], F.lit("assistant")), plain_content(reply(c)["content"])))
    chat = F.concat(_listed(asked), _listed(chosen))
    chat_confidence = 30 + _points((_both_roles(chat), 20), (F.coalesce(r["model"], q["model"]).isNotNull(), 5), (F.size(F.coalesce(r["choices"], F.array())) > 0, 10), (F.size(chat) >= 4, 5))

    prompt, context = _text(q["prompt"]), _text(q["context"])
    with_context = F.when(prompt.isNotNull() & context.isNotNull(), F.concat(F.lit("[Context: "), F.substring(context, 1, 200), F.lit("]\n\n"), prompt)).otherwise(F.coalesce(prompt, context))
    is_object = F.json_object_keys("response").isNotNull()
    raw = F.when(~is_object & F.try_parse_json("response").isNull() & (F.length("response") > 5), F.col("response"))
    embedded = F.concat(_one("user", with_context), _one("assistant", F.when(F.coalesce(is_object, F.lit(False)), _text(r["completion"], r["text"])).otherwise(raw)))
    inside = _text(q["aiSessionId"]).isNotNull() | (prompt.isNotNull() & F.coalesce(F.contains(F.col("host"), F.lit("notion")), F.lit(False)))

    given = F.transform(q["contents"], lambda c: _turn(F.when(F.coalesce(c["role"], F.lit("user")) == "user", "user").otherwise("assistant"), _part_text(c["parts"])))
    offered = F.transform(r["candidates"], lambda c: _turn("assistant", _part_text(c["content"]["parts"])))
    parts = F.concat(_listed(given), _listed(offered))

    bare = F.concat(_one("user", F.when(F.length(q["prompt"]) > 3, q["prompt"])), _one("assistant", _text(r["completion"], r["text"], r["output"], r["generated_text"])))

    def shape(name: str, fits: Column, messages: Column, model: Column, key: Column, confidence: Column) -> Column:
        return F.when(fits, F.struct(F.lit(name).alias("shape"), messages.alias("messages"), model.alias("model_name"), key.alias("session_key"), (confidence / 100).alias("confidence")))

    none = F.lit(None).cast("string")
    found = F.coalesce(
        shape("chat", (F.size(F.coalesce(q["messages"], F.array().cast(_MESSAGES))) > 0) & (F.size(chat) > 0), chat, _text(r["model"], q["model"]), _text(q["conversation_id"], q["session_id"]), chat_confidence),
        shape("embedded", inside & (F.size(embedded) > 0), embedded, F.coalesce(_text(q["model"]), F.lit("notion-ai")), _text(q["aiSessionId"]), F.when(F.size(embedded) >= 2, 60).otherwise(40)),
        shape("parts", (F.size(F.coalesce(q["contents"], F.array())) > 0) & (F.size(parts) > 0), parts, _text(r["modelVersion"], q["model"]), none, 55 + _points((_both_roles(parts), 15))),
        shape("bare", (F.size(bare) >= 2) & (F.get(bare, F.lit(0))["role"] == "user"), bare, _text(q["model"]), none, F.lit(35)),
    )
    rows = pairs.select("pair_id", found.alias("found")).where("found is not null").select("pair_id", "found.*")
    title = F.substring(F.get(F.filter("messages", lambda m: m["role"] == "user"), F.lit(0))["content"], 1, 100)
    return rows.withColumn("title", title)


def recovered_messages(pairs: DataFrame) -> DataFrame:
    """The messages of `recovered`, a row each: pair_id, shape, turn_index, role, content_text, confidence."""
    rows = recovered(pairs).select("pair_id", "shape", "confidence", F.posexplode("messages").alias("turn_index", "m"))
    return rows.select("pair_id", "shape", "turn_index", F.col("m.role").alias("role"), F.col("m.content").alias("content_text"), "confidence")
