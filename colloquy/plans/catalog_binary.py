"""Queries over binary forms: stores of sorted tables and messages in wire format, and their SQL. Importing it registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import wire
from ..sources import sorted_tables
from ..sources.folders import fresh_folder
from . import binaries
from .catalog import ORACLE_SQL, QUERIES

#: Conversations a store.
STORE = 500


def _store_rows(conversations: DataFrame, folder: str) -> DataFrame:
    """Each turn as entries of its store: tables 5 and 7 and log 9 count; table 3 was removed, log 4 is older than the log number."""
    text, turn = F.coalesce(F.col("text"), F.lit("")), F.col("turn")
    files = [
        (3, "ldb", F.lit(True), F.lit(False), F.concat(F.lit("removed "), text), 5000), (4, "log", turn % 3 == 0, F.lit(False), F.concat(F.lit("earlier "), text), 6000),
        (5, "ldb", F.lit(True), F.lit(False), F.concat(F.lit("old "), text), 1), (7, "ldb", turn % 2 == 0, turn % 6 == 0, text, 1000), (9, "log", turn % 5 == 1, F.lit(False), F.concat(F.lit("log "), text), 10000),
    ]
    entry = lambda n, kind, there, gone, value, first: F.when(there, F.struct(F.lit(n).alias("number"), F.lit(kind).alias("kind"), (turn + first).cast("long").alias("sequence"), gone.alias("deleted"), F.when(~gone, value).cast("binary").alias("value")))
    rows = conversations.select("conv_id", "turn", F.explode(F.array_compact(F.array(*[entry(*f) for f in files]))).alias("e"))
    key = F.concat_ws("/", F.concat(F.lit("c"), "conv_id"), F.lpad(turn.cast("string"), 6, "0")).cast("binary")
    path = F.format_string(f"{folder}/store-%d/%06d.%s", F.floor(F.col("conv_id") / STORE), F.col("e.number"), F.col("e.kind"))
    return rows.select(path.alias("path"), "e.kind", "e.sequence", "e.deleted", key.alias("key"), "e.value")


def _store(spark: SparkSession, sf_dir: str) -> DataFrame:
    sorted_tables.register(spark)
    folder = fresh_folder(spark, "stores")
    binaries.write_files(_store_rows(spark.read.parquet(f"{sf_dir}/conversations.parquet"), folder), [5, 7], [3], 9)
    records = spark.read.format("sorted_tables").option("path", folder).load().withColumn("store", F.regexp_extract("file", r"/store-(\d+)/", 1).cast("long"))
    return sorted_tables.newest(records, "store").select("store", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "sequence")


QUERIES["src_11_store"] = _store
ORACLE_SQL["src_11_store"] = f"""SELECT conv_id // {STORE} AS store, concat('c', conv_id, '/', lpad(CAST(turn AS VARCHAR), 6, '0')) AS key,
CASE WHEN turn % 5 = 1 THEN 'log ' || coalesce(text, '') WHEN turn % 2 = 0 THEN coalesce(text, '') ELSE 'old ' || coalesce(text, '') END AS value,
CAST(turn + CASE WHEN turn % 5 = 1 THEN 10000 WHEN turn % 2 = 0 THEN 1000 ELSE 1 END AS BIGINT) AS sequence
FROM conversations WHERE turn % 6 <> 0 OR turn % 5 = 1"""

#: The kind of a turn as a number, in Spark SQL and in DuckDB.
_ROLE = "CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 300 END"
_ID = "concat(lpad(CAST(conv_id AS STRING), 8, '0'), '-0000-7000-8000-', lpad(CAST(conv_id AS STRING), 12, '0'))"


def _messages(conversations: DataFrame) -> DataFrame:
    """Each conversation as a message: its id (1), a head (2) with model and number of turns, and a message (4) a turn, whose text stands two deep; the first turn's text once more at the end (5)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    turn = binaries.sized_field(4, F.concat(binaries.number_field(1, F.expr(_ROLE)), binaries.sized_field(3, F.concat(binaries.number_field(1, F.col("turn")), binaries.sized_field(2, text)))))
    rows = conversations.withColumn("bytes", turn)
    each = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.hex("bytes").alias("bytes")))).alias("turns"), F.min_by(text, "turn").alias("first"))
    head = F.concat(binaries.sized_field(1, F.concat(F.lit("model gpt-"), F.col("conv_id") % 7)), binaries.number_field(2, F.size("turns")))
    body = F.concat(binaries.sized_field(1, F.expr(_ID)), binaries.sized_field(2, head), F.unhex(F.array_join(F.transform("turns", lambda t: t["bytes"]), "")), binaries.sized_field(5, F.col("first")))
    # Every other body comes in a frame.
    frame = F.concat(F.unhex(F.lit("00")), F.unhex(F.lpad(F.hex(F.length(body)), 8, "0")), body)
    return each.select("conv_id", F.when(F.col("conv_id") % 2 == 0, body).otherwise(frame).alias("body"))


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Captured bodies are stored before they are read.
    folder = fresh_folder(spark, "wire-bodies")
    _messages(spark.read.parquet(f"{sf_dir}/conversations.parquet")).write.parquet(folder)
    return spark.read.parquet(folder)


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _bodies(spark, sf_dir).select("conv_id", F.posexplode(wire.fields(F.col("body"))).alias("nth", "f"))
    return rows.select("conv_id", "nth", "f.*")


QUERIES["scl_33_fields"] = _fields
ORACLE_SQL["scl_33_fields"] = f"""WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations),
f AS (SELECT conv_id, 0 AS nth, '1' AS path, 'text' AS kind, NULL AS number, {_ID} AS text FROM c WHERE pos = 1 UNION ALL SELECT conv_id, 1, '2.1', 'text', NULL, concat('model gpt-', conv_id % 7) FROM c WHERE pos = 1
UNION ALL SELECT conv_id, 2, '2.2', 'varint', n, NULL FROM c WHERE pos = 1 UNION ALL SELECT conv_id, 3 * pos, '4.1', 'varint', {_ROLE}, NULL FROM c UNION ALL SELECT conv_id, 3 * pos + 1, '4.3.1', 'varint', turn, NULL FROM c
UNION ALL SELECT conv_id, 3 * pos + 2, '4.3.2', 'text', NULL, text FROM c UNION ALL SELECT conv_id, 3 * n + 3, '5', 'text', NULL, text FROM c WHERE pos = 1)
SELECT conv_id, CAST(nth AS INTEGER) AS nth, path, kind, CAST(number AS BIGINT) AS number, text FROM f"""

QUERIES["scl_33_summaries"] = lambda spark, sf_dir: wire.summaries(_bodies(spark, sf_dir)).select("conv_id", "model_name", "identifier", F.size("fields").alias("n_fields"))
ORACLE_SQL["scl_33_summaries"] = f"SELECT conv_id, concat('gpt-', conv_id % 7) AS model_name, {_ID} AS identifier, CAST(4 + 3 * count(*) AS INTEGER) AS n_fields FROM conversations GROUP BY conv_id"
