"""The logical tables of the engine, derived from the event and conversation tables.

Each table is a list of (column, expression); expressions are common to Spark SQL and DuckDB, except for the seconds of
a timestamp. `frame` gives a table as a DataFrame, `cte` as a common table expression for the SQL beside a query.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

#: Seconds since the epoch of a timestamp column, in Spark SQL and in DuckDB.
SECONDS = {"spark": "unix_micros(CAST({c} AS TIMESTAMP)) / 1e6", "duckdb": "epoch_us({c}) / 1e6"}

_PROVIDER = "CASE WHEN user_id % 7 = 0 THEN NULL WHEN user_id % 3 = 0 THEN 'openai' WHEN user_id % 3 = 1 THEN 'anthropic' ELSE 'google' END"

TABLES: dict[str, tuple[str, str | None, list[tuple[str, str]]]] = {
    "captures": ("events", None, [
        ("id", "event_id"), ("created_at", "seconds(ts)"),
        ("source_id", "CASE event_id % 4 WHEN 0 THEN 'proxy-default' WHEN 1 THEN 'browser-extension' WHEN 2 THEN 'clipboard' ELSE 'local-hook' END"),
        ("direction", "CASE WHEN event_type = 'purchase' THEN 'conversation' WHEN event_type = 'signup' THEN 'network_intercept' WHEN event_id % 2 = 0 THEN 'request' ELSE 'response' END"),
        ("pair_id", "concat('p', event_id - event_id % 2)"), ("host", "concat('host-', user_id % 40, '.example')"), ("path", "concat('/v', event_id % 3, '/', event_type)"),
        ("provider", _PROVIDER), ("model_name", "CASE WHEN user_id % 5 = 0 THEN NULL ELSE concat('model-', user_id % 6) END"),
        ("status_code", "CASE WHEN event_type = 'error' THEN 500 ELSE 200 END"), ("latency_ms", "CAST(value AS DOUBLE)"), ("body", "props"), ("session_hint", "concat('s', user_id)"),
    ]),
    "messages": ("conversations", None, [
        ("id", "concat(conv_id, '-', turn)"), ("session_id", "conv_id"), ("capture_pair_id", "concat('p', conv_id * 2)"),
        ("ts", "CAST(1704067200 + conv_id * 100 + turn * 10 AS DOUBLE)"), ("role", "role"), ("content_text", "text"),
        ("model_name", "CASE WHEN role = 'assistant' THEN concat('model-', conv_id % 4) END"),
        ("token_estimate", "CASE WHEN turn % 5 = 4 THEN NULL ELSE length(text) % 500 END"), ("turn_index", "turn"),
        ("branch_id", "CASE WHEN conv_id % 3 = 0 AND turn >= 4 THEN 'b1' ELSE '0' END"),
        ("branch_parent_id", "CASE WHEN conv_id % 3 = 0 AND turn = 4 THEN concat(conv_id, '-', 2) END"),
    ]),
    "sessions": ("conversations", "conv_id", [
        ("id", "conv_id"), ("source_id", "CASE conv_id % 2 WHEN 0 THEN 'proxy-default' ELSE 'clipboard' END"), ("started_at", "CAST(1704067200 + conv_id * 100 + min(turn) * 10 AS DOUBLE)"),
        ("ended_at", "CAST(1704067200 + conv_id * 100 + max(turn) * 10 AS DOUBLE)"), ("provider", "CASE conv_id % 3 WHEN 0 THEN 'openai' WHEN 1 THEN 'anthropic' ELSE 'google' END"),
        ("session_key", "CASE WHEN conv_id % 11 = 0 THEN NULL ELSE concat('k', conv_id) END"), ("message_count", "count(*) + CASE WHEN conv_id % 10 = 0 THEN 1 ELSE 0 END"),
        ("title_hint", "CASE WHEN conv_id % 8 = 0 THEN ' ' ELSE concat('Title ', conv_id % 13) END"), ("favorited", "CASE WHEN conv_id % 9 = 0 THEN 1 ELSE 0 END"),
    ]),
    "beacons": ("events", None, [
        ("id", "event_id"), ("lane", "CASE user_id % 4 WHEN 0 THEN 'browser' WHEN 1 THEN 'desktop' WHEN 2 THEN 'cli' ELSE 'mcp' END"), ("layer", "concat('L', event_id % 3)"),
        ("target", "concat('t', user_id % 9)"), ("case_id", "CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('T0', event_id % 7) END"),
        ("status", "CASE event_type WHEN 'click' THEN 'pass' WHEN 'view' THEN 'pass' WHEN 'signup' THEN 'skip' WHEN 'purchase' THEN CASE WHEN user_id % 9 = 4 THEN 'degraded' ELSE 'pass' END ELSE CASE WHEN user_id % 9 < 3 THEN 'fail' ELSE 'infra_error' END END"),
        ("ts", "seconds(ts)"),
    ]),
    "errors": ("events", None, [("id", "event_id"), ("ts", "seconds(ts)"), ("stage", "CASE event_id % 3 WHEN 0 THEN 'ingest' WHEN 1 THEN 'normalize' ELSE 'reconcile' END"), ("level", "CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'WARNING' END")]),
    "tls": ("events", None, [("id", "event_id"), ("created_at", "seconds(ts)"), ("host", "concat('host-', (user_id * 3) % 40, '.example')"), ("error_category", "CASE event_type WHEN 'error' THEN 'handshake_failure' WHEN 'click' THEN 'cert_unknown_ca' ELSE 'tls_other' END"), ("kind", "event_type")]),
}


def _spelt(expression: str, dialect: str) -> str:
    return SECONDS[dialect].format(c="ts") if expression == "seconds(ts)" else expression


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, key, columns = TABLES[name]
    source = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if key is None:
        return source.selectExpr(*[f"{_spelt(e, 'spark')} AS {c}" for c, e in columns])
    from pyspark.sql import functions as F

    return source.groupBy(key).agg(*[F.expr(e).alias(c) for c, e in columns]).drop(key)


def cte(*names: str) -> str:
    """`WITH a AS (...), b AS (...)` in DuckDB."""
    out = []
    for name in names:
        table, key, columns = TABLES[name]
        fields = ", ".join(f"{_spelt(e, 'duckdb')} AS {c}" for c, e in columns)
        out.append(f"{name} AS (SELECT {fields} FROM {table}{f' GROUP BY {key}' if key else ''})")
    return "WITH " + ", ".join(out)
