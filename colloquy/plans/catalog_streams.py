"""Queries that run as streams over what Spark derives from the tables, and their SQL. Importing it registers them.

Each query writes its input as files, batch by batch, into a fresh folder that the session shares, runs its stream over
what is there after each batch, and returns what the stream has written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tail
from ..sources.folders import fresh_folder
from ..streaming import pairing, patches, store
from .catalog import ORACLE_SQL, QUERIES

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def available(rows: DataFrame, folder: str) -> None:
    """Appends what a streaming source has now; a later call goes on from the folder's checkpoint."""
    spark = rows.sparkSession
    kind = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(kind, None)
    spark.conf.set(kind, ROCKS)
    try:
        rows.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(kind, before) if before else spark.conf.unset(kind)


def _results(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Each conversation's first two turns, and later all of it; the first batch comes a second time with the later one."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    message = F.struct(F.col("role"), F.col("text"), F.lit(None).cast("string").alias("content_json"), F.lit(None).cast("string").alias("model_name"), F.lit(None).cast("long").alias("token_estimate"), (F.col("conv_id") * 100.0 + F.col("turn") * 10).alias("ts"), F.lit(None).cast("string").alias("parent_uuid"))

    def results(of: DataFrame, part: str, at: float) -> DataFrame:
        lists = of.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", message.alias("m")))).alias("all"))
        cells = {
            "session_key": F.concat(F.lit("conv-"), "conv_id"), "pair_id": F.concat(F.lit(part), "conv_id"), "source_id": F.lit("proxy-default"), "created_via": F.lit("proxy"), "created_at": F.col("conv_id") * 100.0 + at,
            "provider": F.when(F.col("conv_id") % 3 == 0, "unknown").otherwise("openai") if part == "first-" else F.lit("anthropic"), "tool_family": F.lit("api"),
            "title_hint": F.when(F.col("conv_id") % 2 == 0, '{"raw"').otherwise("A title") if part == "first-" else F.lit("Another title"), "messages": F.transform("all", lambda x: x["m"]),
        }
        return lists.select(*[c.alias(n) for n, c in cells.items()])

    first, later = results(rows.where("turn < 2"), "first-", 0.0), results(rows, "later-", 50.0)
    return [first, later.unionByName(first)]


def _store(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    folder = fresh_folder(spark, "session-store")
    for batch in _results(spark, sf_dir):
        batch.write.mode("append").parquet(f"{folder}/in")
        store.run_available(spark.readStream.schema(store.RESULT).parquet(f"{folder}/in"), folder)
    return store.stored(spark, folder)


QUERIES["nrm_12_sessions"] = lambda spark, sf_dir: _store(spark, sf_dir)[0].select("session_key", "provider", "title_hint", "started_at", "ended_at", "message_count")
ORACLE_SQL["nrm_12_sessions"] = """SELECT concat('conv-', conv_id) AS session_key, CASE WHEN min(turn) >= 2 OR conv_id % 3 = 0 THEN 'anthropic' ELSE 'openai' END AS provider,
CASE WHEN min(turn) >= 2 OR conv_id % 2 = 0 THEN 'Another title' ELSE 'A title' END AS title_hint, conv_id * 100.0::DOUBLE + CASE WHEN min(turn) >= 2 THEN 50 ELSE 0 END AS started_at,
greatest(conv_id * 100.0::DOUBLE + max(turn) * 10, conv_id * 100.0::DOUBLE + CASE WHEN min(turn) >= 2 THEN 50 ELSE 0 END) AS ended_at, count(*) AS message_count FROM conversations GROUP BY conv_id"""


def _stored_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions, messages = _store(spark, sf_dir)
    return messages.join(sessions.select(F.col("id").alias("session_id"), "session_key"), "session_id").select("session_key", "turn_index", "branch_id", "role", "text", "ts")


QUERIES["snk_02_messages"] = _stored_messages
ORACLE_SQL["snk_02_messages"] = "SELECT concat('conv-', conv_id) AS session_key, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn_index, '0' AS branch_id, role, text, conv_id * 100.0::DOUBLE + turn * 10 AS ts FROM conversations"


def _wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six kinds of exchanges, one a table row: answered, answered with a body, without answer, without request, without end, answered too late."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", F.expr("event_id % 6").alias("k"), F.col("ts").cast("timestamp").alias("t"))
    seen = "named_struct('kind', '{k}', 'after', {s}, 'is_http2', {h}, 'end_stream', {e}, 'body', {b})"
    ask = seen.format(k="request", s=0, h="k IN (1, 4)", e="false", b="event_type")
    answer = lambda s, h, e, b: seen.format(k="response", s=s, h=h, e=e, b=b)
    data = lambda s, e, b: seen.format(k="data", s=s, h="true", e=e, b=b)
    kinds = f"""CASE k WHEN 0 THEN array({ask}, {answer(5, "false", "false", "'head'")}) WHEN 1 THEN array({ask}, {answer(4, "true", "false", "CAST(NULL AS STRING)")}, {data(6, "false", "'part'")}, {data(20, "true", "'whole'")})
WHEN 2 THEN array({ask}) WHEN 3 THEN array({answer(1, "false", "false", "'alone'")}) WHEN 4 THEN array({ask}, {answer(3, "true", "false", "CAST(NULL AS STRING)")}, {data(9, "false", "'part'")}) ELSE array({ask}, {answer(40, "false", "false", "'late'")}) END"""
    each = rows.select("event_id", "user_id", "t", F.expr(f"inline({kinds})"))
    return each.select(
        F.concat(F.lit("c"), F.col("user_id") % 50).alias("connection"), F.col("event_id").alias("stream"), F.col("after").cast("long").alias("seq"), "kind", F.timestamp_micros(F.unix_micros("t") + F.col("after") * 1_000_000).alias("ts"), "is_http2", "end_stream",
        F.concat(F.lit("h"), F.col("user_id") % 9).alias("host"), "body",
    )


def _exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark, "exchanges")
    events = _wire(spark, sf_dir)
    middle = F.lit("2024-01-16").cast("timestamp")
    for batch in (events.where(F.col("ts") < middle), events.where(F.col("ts") >= middle)):
        batch.write.mode("append").parquet(f"{folder}/in")
        available(pairing.paired_exchanges(spark.readStream.schema(pairing.EVENT).parquet(f"{folder}/in"), most=100_000), folder)
    return spark.read.schema(pairing.EXCHANGE).parquet(f"{folder}/out").select("connection", "stream", "outcome", F.round(F.col("response_at") - F.col("request_at"), 3).alias("seconds"), "host", "request_body", "response_body")


QUERIES["stm_03_exchanges"] = _exchanges
ORACLE_SQL["stm_03_exchanges"] = """WITH e AS (SELECT event_id, user_id, event_type, event_id % 6 AS k, ts, (SELECT max(epoch_us(ts) + CASE event_id % 6 WHEN 0 THEN 5 WHEN 1 THEN 20 WHEN 3 THEN 1 WHEN 4 THEN 9 WHEN 5 THEN 40 ELSE 0 END * 1000000) FROM events) AS newest FROM events),
x AS (SELECT *, 'pair' AS outcome, CASE k WHEN 0 THEN 5.0 WHEN 1 THEN 4.0 ELSE 3.0 END::DOUBLE AS seconds, event_type AS request_body, CASE k WHEN 0 THEN 'head' WHEN 1 THEN 'whole' ELSE 'part' END AS response_body, CASE k WHEN 4 THEN 39 END AS until FROM e WHERE k IN (0, 1, 4)
UNION ALL SELECT *, 'orphan_request', NULL, event_type, NULL, CASE k WHEN 2 THEN 30 END FROM e WHERE k IN (2, 5)
UNION ALL SELECT *, 'orphan_response', NULL, NULL, CASE k WHEN 3 THEN 'alone' ELSE 'late' END, NULL FROM e WHERE k IN (3, 5))
SELECT concat('c', user_id % 50) AS connection, event_id AS stream, outcome, seconds, concat('h', user_id % 9) AS host, request_body, response_body FROM x WHERE until IS NULL OR epoch_us(ts) + until * 1000000 < newest - 10000000"""


def _transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as transcript files that come in two goes, with lines that are no objects; scanned after each go."""
    tail.register(spark)
    folder = fresh_folder(spark, "transcripts")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    uuid = F.when(F.col("turn") % 2 == 0, F.concat_ws("-", "conv_id", "turn"))
    line = F.when(F.col("turn") % 5 == 4, F.concat(F.lit("broken "), "role")).otherwise(F.to_json(F.struct(uuid.alias("uuid"), F.concat(F.lit("s"), "conv_id").alias("sessionId"), F.col("role").alias("type"), F.col("text").alias("message"))))
    for half in (0, 1):
        rows.where(F.col("conv_id") % 2 == half).repartition(4, "conv_id").sortWithinPartitions("conv_id", "turn").select(line.alias("value")).write.mode("append").text(f"{folder}/in")
        available(spark.readStream.format("growing_lines").option("path", f"{folder}/in").option("suffix", ".txt").load(), folder)
    found = tail.transcript_lines(spark.read.schema(tail.SCHEMA).parquet(f"{folder}/out"))
    return found.select("session_id", "line_uuid", "line_type", F.get_json_object("body", "$.message").alias("text"))


QUERIES["stm_18_transcripts"] = _transcripts
ORACLE_SQL["stm_18_transcripts"] = "SELECT concat('s', conv_id) AS session_id, CASE WHEN turn % 2 = 0 THEN concat(conv_id, '-', turn) END AS line_uuid, role AS line_type, text FROM conversations WHERE turn % 5 <> 4"


def _patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as streams of patches: a message a turn, its text in pieces of 200 characters; every other stream ends."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    event = lambda data, name="delta": F.struct(F.lit(name).cast("string").alias("event"), data.alias("data"))
    text = F.coalesce(F.col("text"), F.lit(""))
    begin = F.to_json(F.struct(F.lit("").alias("p"), F.lit("add").alias("o"), F.struct(F.struct(F.struct("role").alias("author"), F.struct(F.array(F.lit("")).alias("parts")).alias("content")).alias("message")).alias("v")))
    piece = lambda i: F.substring(text, i * 200 + 1, F.lit(200))
    first = F.to_json(F.struct(F.lit("/message/content/parts/0").alias("p"), F.lit("append").alias("o"), piece(F.lit(0)).alias("v")))
    later = F.transform(F.filter(F.sequence(F.lit(0), F.floor(F.length(text) / 200).cast("int")), lambda i: i > 0), lambda i: event(F.to_json(F.struct(piece(i).alias("v")))))
    model = F.to_json(F.struct(F.lit("").alias("p"), F.lit("patch").alias("o"), F.array(F.struct(F.lit("/message/metadata/model_slug").alias("p"), F.lit("add").alias("o"), F.concat(F.lit("m-"), "turn").alias("v"))).alias("v")))
    told = F.concat(F.array(event(begin), event(first)), later, F.array(event(model), event(F.lit('{"type":"message_stream_complete"}'), None)))
    streams = rows.select("conv_id", "turn", told.alias("told")).groupBy("conv_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("turn", "told"))), lambda t: t["told"])).alias("all"))
    ended = F.when(F.col("conv_id") % 2 == 0, F.concat("all", F.array(event(F.lit("[DONE]"), None)))).otherwise(F.col("all"))
    each = streams.select(F.concat(F.lit("c"), "conv_id").alias("stream"), F.posexplode(ended).alias("seq", "e"))
    return each.select("stream", F.col("seq").cast("long").alias("seq"), "e.event", "e.data", F.lit("2024-01-01").cast("timestamp").alias("ts"))


_MESSAGE = ("stream", "message", "role", "text", "model")


def _folding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The patches in three batches, out of order; the first comes once more with the last."""
    folder = fresh_folder(spark, "patches")
    told = _patches(spark, sf_dir)
    for parts in ([1], [2], [0, 1]):
        told.where((F.col("seq") % 3).isin(parts)).write.mode("append").parquet(f"{folder}/in")
        available(patches.folding(spark.readStream.schema(patches.EVENT).parquet(f"{folder}/in")), folder)
    return patches.newest(spark.read.schema(patches.MESSAGE).parquet(f"{folder}/out")).select(*_MESSAGE, "ended")


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The patches as bodies of event streams, which are told apart into events again and folded."""
    lines = F.concat(F.when(F.col("event").isNotNull(), F.concat(F.lit("event: "), F.col("event"), F.lit("\n"))).otherwise(""), F.lit("data: "), F.col("data"))
    bodies = _patches(spark, sf_dir).groupBy("stream", "ts").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", lines.alias("line")))), lambda x: x["line"]), "\n\n").alias("response"))
    return patches.folded(patches.events_of(bodies, "stream")).select(*_MESSAGE)


_SAID = """SELECT concat('c', conv_id) AS stream, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS message, role, text, concat('m-', turn) AS model{more} FROM conversations QUALIFY text <> ''"""
QUERIES["stm_12_folding"] = _folding
ORACLE_SQL["stm_12_folding"] = _SAID.format(more=", CASE WHEN conv_id % 2 = 0 THEN 'complete' END AS ended")
QUERIES["nrm_10_folded"] = _folded
ORACLE_SQL["nrm_10_folded"] = _SAID.format(more="")
