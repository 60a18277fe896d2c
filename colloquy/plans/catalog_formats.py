"""Queries of the parsers' dispatch over bodies in every format, and their SQL. Importing it registers them.

The bodies are built from the conversations: a tenth of them in each format.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import attributes, dispatch, recovery
from ..sources.folders import fresh_folder
from .catalog import ORACLE_SQL, QUERIES
from .standins import cte, frame

#: provider, host, path of each tenth.
PLACES = [
    (None, "local-copilot-chat", "/"), (None, "local-cursor-chat", "/"), (None, "local-codex-cli", "/"), (None, "local-gemini-cli", "/"), ("openai", "api.openai.com", "/v1/chat/completions"),
    ("anthropic", "api.anthropic.com", "/v1/messages"), ("deepseek", "chat.deepseek.com", "/c"), (None, "local-agent-mode", "/app/agent-transcript/unknown/1"), ("unknown", "page.example", "/"), ("mcp:files", "stdio", "tools/call"),
]


def _json(**cells: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in cells.items()]))


def _fields(m: Column, role: str, text: str) -> Column:
    return F.struct(m["role"].alias(role), m["text"].alias(text))


def bodies(conversations: DataFrame) -> DataFrame:
    """A pair a conversation, in the format of its tenth."""
    rows = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("all"))
    every, key = F.col("all"), F.concat(F.lit("s"), F.col("conv_id"))
    first, last = F.get(every, F.lit(0)), F.element_at(every, -1)
    ends = last["role"] == "assistant"
    before = F.when(ends, F.slice(every, 1, F.size(every) - 1)).otherwise(every)
    asked = F.filter(F.transform(every, lambda m, i: F.struct(m["role"].alias("role"), F.struct(m["text"].alias("text")).alias("message"), F.when(F.get(every, i + 1).isNotNull(), F.array(F.struct(F.lit("markdown").alias("kind"), F.get(every, i + 1)["text"].alias("value")))).alias("response"))), lambda r: r["role"] == "user")
    kind = lambda m: F.when(m["role"] == "user", 1).otherwise(2)
    block = lambda m: F.array(F.struct(F.lit("text").alias("type"), m["text"].alias("text")))
    choices = F.when(ends, _json(choices=F.array(F.struct(_fields(last, "role", "content").alias("message")))))
    chat = _json(model=F.lit("m-1"), messages=F.transform(before, lambda m: _fields(m, "role", "content")))
    requests = [
        _json(sessionId=key, requests=asked), _json(composer_id=key, name=F.lit("A name"), bubbles=F.transform(every, lambda m: F.struct(m["text"].alias("text"), kind(m).alias("bubble_type")))),
        _json(session_id=key, model=F.lit("m-2"), turns=F.transform(every, lambda m: _fields(m, "role", "content_text"))),
        _json(session_id=key, messages=F.transform(every, lambda m: F.struct(F.when(m["role"] == "user", "user").otherwise("gemini").alias("type"), m["text"].alias("content")))), chat,
        _json(model=F.lit("claude-x"), messages=F.transform(before, lambda m: F.struct(m["role"].alias("role"), block(m).alias("content")))), _json(conversation_id=key, title=F.lit("Page"), messages=F.transform(every, lambda m: _fields(m, "role", "content"))),
        _json(type=first["role"], sessionId=key, message=_fields(first, "role", "content")), _json(request_body=chat, response_body=choices, url=F.lit("https://api.openai.com:443/v1/chat/completions?x=1")),
        _json(id=F.col("conv_id"), params=F.struct(F.lit("echo").alias("name"), F.struct(F.col("conv_id").alias("k")).alias("arguments"))),
    ]
    none = F.lit(None).cast("string")
    responses = [none, none, none, none, choices, F.when(ends, _json(model=F.lit("claude-x"), content=block(last))), none, none, none, _json(result=F.struct(block(first).alias("content")))]
    at = (F.col("conv_id") % 10 + 1).cast("int")
    pick = lambda values: F.element_at(F.array(*[F.lit(v) if v is None or isinstance(v, str) else v for v in values]), at)
    place = [pick([p[i] for p in PLACES]) for i in range(3)]
    cells = {"pair_id": F.concat(F.lit("p"), F.col("conv_id")), "direction": F.when(at == 9, "network_intercept").otherwise("conversation"), "provider": place[0], "host": place[1], "path": place[2], "request": pick(requests), "response": pick(responses), "model_name": none, "created_at": F.lit(1704067200.0)}
    return rows.select(*[c.alias(n) for n, c in cells.items()])


def _dispatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Captured bodies are stored before they are read.
    folder = fresh_folder(spark, "bodies")
    bodies(spark.read.parquet(f"{sf_dir}/conversations.parquet")).write.parquet(folder)
    found = dispatch.dispatched_messages(spark.read.parquet(folder))
    return found.select("pair_id", "parser", "session_key", F.round("confidence", 4).alias("confidence"), "turn_index", "role", "content_text")


QUERIES["nrm_01_dispatch"] = _dispatched
ORACLE_SQL["nrm_01_dispatch"] = """WITH c AS (SELECT conv_id, turn, role, text, conv_id % 10 AS k, count(*) OVER w AS n, avg(length(text)) OVER w AS mean, max(turn) OVER w AS top, min(turn) OVER w AS first,
  bool_or(role = 'assistant') OVER w AS answered, bool_or(role = 'assistant') OVER w AND bool_or(role = 'user') OVER w AS both_roles FROM conversations WINDOW w AS (PARTITION BY conv_id)),
x AS (SELECT *, concat('p', conv_id) AS pair_id, concat('s', conv_id) AS s, bool_or(turn = top AND role = 'assistant') OVER (PARTITION BY conv_id) AS ends FROM c),
chat AS (SELECT pair_id, CASE WHEN k = 5 THEN 'content_blocks' WHEN k = 8 AND NOT answered THEN 'fallback_chat' ELSE 'chat_completions' END AS parser, NULL AS session_key,
  CASE WHEN k = 8 AND NOT answered THEN 0.35 + CASE WHEN n >= 4 THEN 0.05 ELSE 0 END ELSE 0.55 + CASE WHEN both_roles THEN 0.15 ELSE 0.05 END + CASE WHEN ends THEN 0.2 ELSE 0 END END AS confidence, turn, role, text FROM x WHERE k IN (4, 5, 8)),
page AS (SELECT pair_id, 'page_conversation' AS parser, s AS session_key, CASE WHEN both_roles THEN 0.45 ELSE 0.3 END + 0.35 + CASE WHEN n >= 4 THEN 0.10 WHEN n >= 2 THEN 0.05 ELSE 0 END + CASE WHEN mean > 20 THEN 0.1 ELSE 0 END AS confidence, turn, role, text FROM x WHERE k = 6),
tool AS (SELECT pair_id, 'remote_call' AS parser, 'mcp-proxy:files:2024-01-01' AS session_key, 0.95 AS confidence, unnest([0, 1]) AS turn, unnest(['assistant', 'tool']) AS role, unnest([concat('[tools/call] files.echo {"k":', conv_id, '} #mcp_files_tool_', conv_id), text]) AS text FROM x WHERE k = 9 AND turn = first),
own AS (SELECT pair_id, CASE k WHEN 0 THEN 'editor_chat' WHEN 1 THEN 'composer_chat' WHEN 2 THEN 'turns_dump' WHEN 3 THEN 'typed_dump' ELSE 'transcript_line' END AS parser, s AS session_key, 0.95 AS confidence, turn, CASE WHEN role = 'system' THEN 'assistant' ELSE role END AS role, text FROM x WHERE (k < 4 OR k = 7 AND turn = first) AND (role <> 'system' OR k IN (1, 3)))
SELECT pair_id, parser, session_key, CAST(round(confidence, 4) AS DOUBLE) AS confidence, CAST(row_number() OVER (PARTITION BY pair_id ORDER BY turn) - 1 AS INTEGER) AS turn_index, role, text AS content_text
FROM (SELECT * FROM chat UNION ALL SELECT * FROM page UNION ALL SELECT * FROM tool UNION ALL SELECT * FROM own)"""  # fmt: skip


def _with_parts(m: DataFrame) -> DataFrame:
    """Messages with a picture in every third turn, and with a picture, a text and a file in every fifth."""
    part = lambda kind, **c: F.struct(F.lit(kind).alias("type"), *[c.get(n, F.lit(None).cast("string")).alias(n) for n in ("text", "url", "raw")])
    picture, text, file = part("image_url", url=F.concat(F.lit("https://x/"), "id")), part("text", text=F.lit("t.1")), part("file", raw=F.lit("{}"))
    parts = F.when(F.col("turn_index") % 5 == 4, F.array(picture, text, file)).when(F.col("turn_index") % 3 == 0, F.array(picture))
    return m.select(F.concat(F.lit("p"), "session_id").alias("pair_id"), "turn_index", "ts", "role", "content_text", parts.alias("parts"))


def _rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans written as lines of JSON and read back, then folded into messages."""
    folder = fresh_folder(spark, "spans")
    spans = attributes.spans(_with_parts(frame(spark, sf_dir, "messages")))
    spans.write.json(folder)
    back = spark.read.schema("pair_id string, start_time double, attributes map<string,string>").json(folder)
    return attributes.messages_of(back).select("pair_id", "turn_index", "ts", "role", "content_text", F.array_join(F.transform("parts", lambda p: F.concat_ws("=", p["type"], F.coalesce(p["url"], p["text"], p["raw"]))), ",").alias("parts"))


QUERIES["nrm_16_rebuilt"] = _rebuilt
ORACLE_SQL["nrm_16_rebuilt"] = cte("messages") + """ SELECT concat('p', session_id) AS pair_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY role = 'assistant', turn_index) - 1 AS INTEGER) AS turn_index, min(ts) OVER (PARTITION BY session_id) AS ts, role, content_text,
CASE WHEN turn_index % 5 = 4 THEN concat('image_url=https://x/', id, ',text=t.1,file={}') WHEN turn_index % 3 = 0 THEN concat('image_url=https://x/', id) ELSE '' END AS parts FROM messages"""


def _cancelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chats in two dialects: of half the twenties the response came, every third conversation has its messages; each request is there twice."""
    folder = fresh_folder(spark, "requests")
    pairs = bodies(spark.read.parquet(f"{sf_dir}/conversations.parquet")).withColumn("n", F.substring("pair_id", 2, 20).cast("long")).where("n % 10 in (4, 5)")
    rows = pairs.select("n", "pair_id", "provider", "host", "path", "model_name", "request", "response")
    sent = lambda at, body: F.struct(F.lit(at).alias("created_at"), F.lit("request").alias("direction"), body.alias("body"))
    answer = F.struct(F.lit(5.0).alias("created_at"), F.lit("response").alias("direction"), F.col("response").alias("body"))
    each = rows.withColumn("e", F.explode(F.array_compact(F.array(sent(1.0, F.col("request")), sent(2.0, F.lit("{}")), F.when(F.col("n") % 20 < 10, answer)))))
    each.select(F.monotonically_increasing_id().alias("id"), F.lit("proxy").alias("source_id"), "pair_id", "provider", "host", "path", "model_name", "e.*").write.parquet(folder)
    known = rows.where("n % 3 = 0").select(F.col("pair_id").alias("capture_pair_id"))
    found = recovery.recovered_prompts(spark.read.parquet(folder), known, now=100.0)
    return found.select("pair_id", "parser", "turn_index", "role", "content_text", "interaction_kind")


QUERIES["nrm_14_recovered"] = _cancelled
ORACLE_SQL["nrm_14_recovered"] = """SELECT concat('p', conv_id) AS pair_id, CASE conv_id % 10 WHEN 4 THEN 'chat_completions' ELSE 'content_blocks' END AS parser, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS turn_index, role, text AS content_text, 'cancelled' AS interaction_kind
FROM conversations WHERE conv_id % 20 IN (14, 15) AND conv_id % 3 <> 0 AND role <> 'assistant'"""
