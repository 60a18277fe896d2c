"""The engine's queries on the driver's tables, and DuckDB SQL for each that SQL can express.

`now` is the newest time of the events, pinned in the data; every query runs over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rich as C
from ..functions import text as T
from ..functions import traffic as K
from ..operators import analytics as A
from ..operators import fallback as B
from ..operators import health as H
from ..operators import joins as J
from ..operators import normalise as N
from ..operators import quality as Q
from ..operators import schemas as M
from ..operators import search as R
from ..operators import sessions as S
from ..operators import state as G
from ..sources import exchange as X
from .standins import cte, frame

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The end of the tables' time span: the pinned `now`.
NOW = 1706659200.0
HOUR = 3600
SOURCES = ["proxy-default", "browser-extension", "clipboard", "local-hook", "mcp"]
LAYERS = ["L0", "L1", "L2"]


def query(name: str, sql: str | None = None, *tables: str):
    """Registers a query of (frames of tables) with its SQL, which may use the tables by name."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(*[frame(spark, sf_dir, t) if t in LOGICAL else spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables])
        if sql is not None:
            own = [t for t in tables if t in LOGICAL]
            ORACLE_SQL[name] = (cte(*own) + (", " if sql.lstrip().startswith("with ") else " ") + sql.lstrip().removeprefix("with ")) if own else sql
        return f

    return register


from .standins import TABLES as LOGICAL  # noqa: E402

_DAY = "strftime(date_trunc('{u}', make_timestamp(CAST({c} * 1e6 AS BIGINT))), '%Y-%m-%d %H:%M:%S')"


def _bucket(c: str, unit: str) -> str:
    return _DAY.format(c=c, u=unit)


# --- time series, top lists, usage ---

for _unit in A.BUCKETS:
    query(f"agg_01_timeseries_{_unit}", f"""
with c AS (SELECT {_bucket('created_at', _unit)} AS bucket, count(*) AS captures FROM captures WHERE created_at >= (SELECT max(created_at) FROM captures) - 365 * 86400 GROUP BY 1),
m AS (SELECT {_bucket('ts', _unit)} AS bucket, count(*) AS messages, count(DISTINCT session_id) AS sessions FROM messages WHERE ts >= (SELECT max(ts) FROM messages) - 365 * 86400 GROUP BY 1)
SELECT coalesce(c.bucket, m.bucket) AS bucket, coalesce(captures, 0) AS captures, coalesce(messages, 0) AS messages, coalesce(sessions, 0) AS sessions FROM c FULL JOIN m ON c.bucket = m.bucket""",
        "captures", "messages")(lambda c, m, u=_unit: A.timeseries(c, m, u, 365))

query("agg_02_top_models", """SELECT coalesce(model_name, '(unknown)') AS model, coalesce(provider, '(unknown)') AS by_provider, count(*) AS n FROM captures
WHERE direction IN ('response', 'conversation', 'network_intercept') AND created_at >= (SELECT max(created_at) FROM captures) - 30 * 86400
GROUP BY model_name, captures.provider ORDER BY n DESC, model, by_provider LIMIT 20""", "captures")(A.top_models)  # fmt: skip
query("agg_03_top_hosts", "SELECT host, count(*) AS n, count(DISTINCT pair_id) AS pairs, max(created_at) AS last_seen FROM captures WHERE created_at >= (SELECT max(created_at) FROM captures) - 30 * 86400 AND host <> '' GROUP BY host ORDER BY n DESC, host LIMIT 20", "captures")(A.top_hosts)
query("agg_04_token_usage", f"SELECT {_bucket('ts', 'day')} AS bucket, CAST(coalesce(sum(token_estimate), 0) AS BIGINT) AS tokens, count(token_estimate) AS counted, count(*) AS messages FROM messages WHERE ts >= (SELECT max(ts) FROM messages) - 365 * 86400 GROUP BY 1", "messages")(A.token_usage)
query("agg_05_stats", "SELECT 'total' AS dimension, NULL AS name, count(*) AS n FROM captures UNION ALL SELECT 'provider', provider, count(*) FROM captures GROUP BY 2 UNION ALL SELECT 'source_id', source_id, count(*) FROM captures GROUP BY 2 UNION ALL SELECT 'direction', direction, count(*) FROM captures GROUP BY 2", "captures")(A.stats)
query("agg_06_source_activity", "SELECT source_id, count(*) AS n, max(created_at) AS last_seen FROM captures GROUP BY 1", "captures")(A.source_activity)
query("agg_07_capture_windows", "with t AS (SELECT max(created_at) AS now FROM captures) SELECT source_id, direction, count(*) FILTER (created_at >= now - 300) AS n_5m, count(*) FILTER (created_at >= now - 3600) AS n_1h, count(*) FILTER (created_at >= now - 86400) AS n_24h, count(*) AS n FROM captures, t GROUP BY 1, 2", "captures")(A.capture_windows)
query("agg_07_normalisation_ratio", "SELECT pairs, sessions, round(sessions / pairs, 4) AS ratio FROM (SELECT count(DISTINCT pair_id) AS pairs FROM captures), (SELECT count(DISTINCT session_id) AS sessions FROM messages)", "captures", "messages")(A.normalisation_ratio)
query("agg_08_channel_status", f"""with k(channel) AS (VALUES ('proxy-default'), ('browser-extension'), ('local*'), ('mcp')), l AS (SELECT source_id, max(created_at) AS last_seen, count(*) AS n FROM captures GROUP BY 1),
j AS (SELECT channel, max(last_seen) AS last_seen, CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM k LEFT JOIN l ON source_id = channel OR (channel LIKE '%*' AND starts_with(source_id, rtrim(channel, '*'))) GROUP BY 1)
SELECT channel, n, CASE WHEN last_seen IS NULL THEN 'never' WHEN {NOW} - last_seen <= 300 THEN 'active' WHEN {NOW} - last_seen <= 3600 THEN 'idle' WHEN {NOW} - last_seen <= 86400 THEN 'stale' ELSE 'inactive' END AS status FROM j""", "captures")(lambda c: A.channel_status(c, ["proxy-default", "browser-extension", "local*", "mcp"], NOW))  # fmt: skip
query("agg_09_error_counts", "SELECT stage, level, count(*) AS n FROM errors WHERE ts >= (SELECT max(ts) FROM errors) - 7 * 86400 GROUP BY 1, 2", "errors")(lambda e: A.error_counts(e, 7 * A.DAY))
_PINNING = f"""with f AS (SELECT host, count(*) FILTER (created_at >= {NOW} - 2592000) AS failures, arg_max(error_category, (created_at, id)) AS last_category FROM tls WHERE kind <> 'view' GROUP BY 1),
s AS (SELECT host, count(DISTINCT pair_id) AS ok FROM captures WHERE source_id = 'proxy-default' AND created_at >= {NOW} - 2592000 GROUP BY 1)
SELECT f.host AS host, failures, coalesce(ok, 0) AS successes, round(failures / (failures + coalesce(ok, 0)), 4) AS rate, last_category, failures >= 5 AND failures / (failures + coalesce(ok, 0)) > 0.20 AS suspect FROM f LEFT JOIN s ON f.host = s.host WHERE failures > 0"""
query("agg_10_pinning", _PINNING, "tls", "captures")(lambda t, c: A.pinning(t.where("kind <> 'view'"), c, 30 * A.DAY, NOW))
query("agg_11_suspect_hosts", f"SELECT host, count(*) AS n FROM tls WHERE created_at >= {NOW} - 864000 GROUP BY 1 HAVING count(*) >= 5", "tls")(lambda t: t.where(F.col("created_at") >= NOW - 10 * A.DAY).groupBy("host").agg(F.count("*").alias("n")).where("n >= 5"))
_PCT = "list_sort(list(latency_ms))[CAST(round_even({p} / 100.0 * (count(latency_ms) - 1), 0) AS BIGINT) + 1]"
query("agg_12_source_health", f"""with k(source_id) AS (VALUES {', '.join(f"('{s}')" for s in SOURCES)}), c AS (SELECT source_id, count(*) AS n, count(*) FILTER (status_code >= 400) AS failed, max(created_at) AS last_seen, {_PCT.format(p=50)} AS p50, {_PCT.format(p=95)} AS p95 FROM captures GROUP BY 1)
SELECT k.source_id AS source_id, coalesce(n, 0) AS n, coalesce(failed, 0) AS failed, round(CASE WHEN coalesce(n, 0) > 0 THEN failed / (n + failed) END, 4) AS drop_rate, last_seen, p50, p95 FROM k LEFT JOIN c ON k.source_id = c.source_id""", "captures")(lambda c: A.source_health(c, None, SOURCES))  # fmt: skip
query("agg_13_percentiles", f"SELECT host, {_PCT.format(p=50)} AS p50, {_PCT.format(p=95)} AS p95 FROM captures GROUP BY 1", "captures")(lambda c: A.exact_percentiles(c, "host", "latency_ms"))
query("agg_19_export_summary", "SELECT * FROM (SELECT count(*) AS captures, count(DISTINCT pair_id) AS pairs, CAST(sum(length(body)) AS BIGINT) AS body_chars FROM captures), (SELECT count(*) AS messages, count(DISTINCT session_id) AS sessions FROM messages)", "captures", "messages")(A.export_summary)
query("agg_20_first_of_pair", "SELECT pair_id, min(created_at) AS first_at, arg_min(session_hint, (created_at, id)) AS session_hint FROM captures GROUP BY 1", "captures")(A.first_of_pair)
query("agg_21_provider_directions", "SELECT coalesce(captures.provider, '(unknown)') AS provider, count(*) FILTER (direction = 'request') AS request, count(*) FILTER (direction = 'response') AS response, count(*) FILTER (direction = 'conversation') AS conversation, count(*) FILTER (direction = 'network_intercept') AS network_intercept FROM captures GROUP BY 1", "captures")(A.provider_directions)
query("agg_23_host_report", """with c AS (SELECT host, count(*) AS n, count(*) FILTER (direction = 'request') AS requests, count(*) FILTER (direction = 'response') AS responses, round(avg(coalesce(length(body), 0)), 4) AS avg_body, max(coalesce(length(body), 0)) AS max_body,
count(DISTINCT path) AS n_paths, array_to_string(list_sort(list(DISTINCT path))[1:3], ',') AS paths FROM captures GROUP BY 1) SELECT * FROM c ORDER BY n DESC, host LIMIT 20""", "captures")(A.host_report)  # fmt: skip
_WANT = {"openai": ["proxy-default", "sdk", "clipboard"], "anthropic": ["mcp", "local-hook"], "nobody": ["clipboard"]}
query("agg_24_missing_sources", """with w(provider, expected) AS (VALUES ('openai', ['proxy-default', 'sdk', 'clipboard']), ('anthropic', ['mcp', 'local-hook']), ('nobody', ['clipboard'])), s AS (SELECT provider, list(DISTINCT source_id) AS seen FROM captures GROUP BY 1)
SELECT w.provider AS provider, coalesce(array_to_string(list_sort(list_filter(expected, lambda x: list_contains(seen, x))), ','), '') AS detected, coalesce(array_to_string(list_sort(list_filter(expected, lambda x: NOT coalesce(list_contains(seen, x), false))), ','), '') AS missing FROM w LEFT JOIN s ON w.provider = s.provider""", "captures")(lambda c: A.missing_expected(c, _WANT))  # fmt: skip
query("agg_26_singletons", "SELECT pair_id FROM captures WHERE status_code = 200 GROUP BY 1 HAVING count(*) = 1", "captures")(lambda c: A.singletons(c.where("status_code = 200"), "pair_id"))
query("agg_27_vector_coverage", "SELECT label, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM embeddings), 2) AS pct FROM embeddings GROUP BY 1", "embeddings")(lambda e: e.groupBy("label").agg(F.count("*").alias("n")).join(F.broadcast(e.agg(F.count("*").alias("total")))).select("label", "n", F.round(F.col("n") * 100.0 / F.col("total"), 2).alias("pct")))
query("agg_28_categories", "SELECT source, count(*) AS n FROM documents GROUP BY 1", "documents")(lambda d: d.groupBy("source").agg(F.count("*").alias("n")))
query("agg_29_counters", "SELECT count(*) AS n, count(DISTINCT host) AS hosts, count(DISTINCT pair_id) AS pairs FROM captures WHERE source_id = 'proxy-default'", "captures")(lambda c: c.where("source_id = 'proxy-default'").agg(F.count("*").alias("n"), F.countDistinct("host").alias("hosts"), F.countDistinct("pair_id").alias("pairs")))
query("agg_31_onboarding", f"SELECT count(*) AS n, count(*) FILTER (created_at >= {NOW} - 300) AS n_5m, max(created_at) AS last_seen FROM captures", "captures")(lambda c: c.agg(F.count("*").alias("n"), F.count_if(F.col("created_at") >= NOW - 300).alias("n_5m"), F.max("created_at").alias("last_seen")))
query("agg_32_archive_preview", f"SELECT count(*) AS n, CAST(coalesce(sum(length(body)), 0) AS BIGINT) AS chars FROM captures WHERE created_at < {NOW} - 864000", "captures")(lambda c: X.body_chars(c, NOW - 10 * A.DAY))
query("agg_33_status_histogram", "SELECT status, count(*) AS n FROM beacons GROUP BY 1", "beacons")(lambda b: b.groupBy("status").agg(F.count("*").alias("n")))

# --- filters ---

query("flt_01_recent", "SELECT id, created_at, host FROM captures ORDER BY created_at DESC, id DESC LIMIT 20", "captures")(lambda c: c.select("id", "created_at", "host").orderBy(F.desc("created_at"), F.desc("id")).limit(20))
query("flt_02_by_pair", "SELECT id, created_at, direction FROM captures WHERE pair_id = 'p100'", "captures")(lambda c: c.where("pair_id = 'p100'").select("id", "created_at", "direction"))
query("flt_03_captures", "SELECT id, host, source_id FROM captures WHERE provider = 'openai' AND direction = 'response' AND host = 'host-3.example'", "captures")(lambda c: c.where("provider = 'openai' and direction = 'response' and host = 'host-3.example'").select("id", "host", "source_id"))
query("flt_04_sessions", "SELECT id, title_hint FROM sessions WHERE provider = 'openai' AND title_hint ILIKE '%title 1%' AND message_count >= 3 AND started_at BETWEEN 1704067200 AND 1706659200", "sessions")(lambda s: s.where("provider = 'openai' and title_hint ilike '%title 1%' and message_count >= 3 and started_at between 1704067200 and 1706659200").select("id", "title_hint"))
query("flt_06_in_list", "SELECT id, session_id FROM messages WHERE session_id IN (1, 3, 5, 8, 13)", "messages")(lambda m: m.where(F.col("session_id").isin(1, 3, 5, 8, 13)).select("id", "session_id"))
_LEGS = [("proxy-default", ["host-1.example", "host-2.example"]), ("clipboard", ["host-3.example"])]
query("flt_07_legs", f"SELECT id FROM captures WHERE created_at BETWEEN {NOW} - 1728000 AND {NOW} AND ((source_id = 'proxy-default' AND host IN ('host-1.example', 'host-2.example')) OR (source_id = 'clipboard' AND host IN ('host-3.example')))", "captures")(lambda c: c.where(F.col("created_at").between(NOW - 20 * A.DAY, NOW) & J.legs_filter(_LEGS)).select("id"))
query("flt_09_beacons", f"SELECT id, status FROM beacons WHERE lane = 'cli' AND target = 't2' AND status = 'fail' AND ts >= {NOW} - 1728000 ORDER BY ts DESC, id DESC LIMIT 1000", "beacons")(lambda b: b.where((F.col("lane") == "cli") & (F.col("target") == "t2") & (F.col("status") == "fail") & (F.col("ts") >= NOW - 20 * A.DAY)).orderBy(F.desc("ts"), F.desc("id")).limit(A.clamp(5000, 1, A.MAX_ROWS)).select("id", "status"))
query("flt_12_allowlist", "SELECT id, host FROM captures WHERE host = 'host-7.example' OR host LIKE '%.host-7.example' OR host = 'host-9.example' OR host LIKE '%.host-9.example'", "captures")(lambda c: J.allowed_hosts(c.select("id", "host"), c.sparkSession.createDataFrame([("host-7.example",), ("HOST-9.example",)], "domain string")))
query("flt_13_negative_class", "SELECT doc_id FROM documents WHERE NOT regexp_matches(text, '[\\x{4e00}-\\x{9fff}]') AND length(trim(text)) < 60", "documents")(lambda d: d.where(~F.col("text").rlike(T.HAN) & (F.length(F.trim("text")) < 60)).select("doc_id"))
query("flt_14_json_path", "SELECT id, CAST(body ->> '$.k' AS BIGINT) AS k FROM captures WHERE json_valid(body) AND CAST(body ->> '$.k' AS BIGINT) % 10 = 3", "captures")(lambda c: c.where(F.try_parse_json("body").isNotNull()).select("id", F.get_json_object("body", "$.k").cast("long").alias("k")).where("k % 10 = 3"))
query("flt_17_degraded", None, "beacons")(lambda b: H.degraded(_scenarios(b)))
query("flt_19_lengths", "SELECT id, coalesce(length(body), 0) AS body_chars FROM captures", "captures")(lambda c: c.select("id", F.coalesce(F.length("body"), F.lit(0)).alias("body_chars")))

# --- joins ---

_DIM = "(VALUES ('proxy-default', 'proxy'), ('browser-extension', 'extension'), ('clipboard', 'watcher'))"
query("jon_01_sources", f"SELECT id, tool FROM captures JOIN {_DIM} AS s(source_id, tool) ON captures.source_id = s.source_id", "captures")(lambda c: c.join(F.broadcast(c.sparkSession.createDataFrame([("proxy-default", "proxy"), ("browser-extension", "extension"), ("clipboard", "watcher")], "source_id string, tool string")), "source_id").select("id", "tool"))
query("jon_02_messages_sessions", "SELECT messages.id AS id, session_id, provider FROM messages JOIN sessions ON session_id = sessions.id", "messages", "sessions")(lambda m, s: m.join(s.select(F.col("id").alias("session_id"), "provider"), "session_id").select("id", "session_id", "provider"))
query("jon_06_pending_vectors", "SELECT id FROM messages WHERE coalesce(content_text, '') <> '' AND id NOT IN (SELECT concat(vec_id, '-', vec_id % 3) FROM embeddings)", "messages", "embeddings")(lambda m, e: J.pending_vectors(m, e.selectExpr("concat(vec_id, '-', vec_id % 3) as message_id", "'hash' as backend", "'m' as model_name"), "hash", "m").select("id"))
_ORPHANS = f"SELECT id, pair_id FROM captures c WHERE direction = 'request' AND created_at <= {NOW} - 30 AND NOT EXISTS (SELECT 1 FROM captures r WHERE r.pair_id = c.pair_id AND r.direction = 'response') AND NOT EXISTS (SELECT 1 FROM messages m WHERE m.capture_pair_id = c.pair_id)"
query("jon_07_orphan_requests", _ORPHANS, "captures", "messages")(lambda c, m: J.orphan_requests(c, m, 30, NOW).select("id", "pair_id"))
query("jon_08_without_user", "SELECT session_id FROM messages GROUP BY 1 HAVING count(*) FILTER (role = 'assistant') = 0", "messages")(lambda m: J.without_role(m, "assistant"))
query("jon_09_orphan_sessions", "SELECT id FROM sessions WHERE favorited = 0 AND id NOT IN (SELECT session_id FROM messages WHERE turn_index > 2)", "sessions", "messages")(lambda s, m: J.orphan_sessions(s, m.where("turn_index > 2")).select("id"))
query("jon_11_counter_drift", "SELECT id, message_count AS stored, coalesce(n, 0) AS actual FROM sessions LEFT JOIN (SELECT session_id, count(*) AS n FROM messages GROUP BY 1) ON session_id = id WHERE message_count <> coalesce(n, 0)", "sessions", "messages")(S.counter_drift)
query("jon_12_branch_counts", "SELECT id, coalesce(nullif(n, 0), 1) AS branches FROM sessions LEFT JOIN (SELECT session_id, count(DISTINCT branch_id) AS n FROM messages GROUP BY 1) ON session_id = id", "sessions", "messages")(lambda s, m: S.branch_counts(s, m).select("id", "branches"))
query("jon_13_latest_error", "SELECT host, arg_max(error_category, (created_at, id)) AS last_category FROM tls GROUP BY 1", "tls")(lambda t: t.groupBy("host").agg(F.max_by("error_category", F.struct("created_at", "id")).alias("last_category")))
query("jon_15_session_captures", "SELECT id FROM captures WHERE pair_id IN (SELECT capture_pair_id FROM messages WHERE session_id < 50)", "captures", "messages")(lambda c, m: c.join(m.where("session_id < 50").select(F.col("capture_pair_id").alias("pair_id")), "pair_id", "left_semi").select("id"))
query("jon_16_paired", "SELECT pair_id, arg_min(id, (created_at, id)) FILTER (direction = 'request') AS request_id, arg_min(id, (created_at, id)) FILTER (direction = 'response') AS response_id FROM captures WHERE direction IN ('request', 'response') GROUP BY 1 HAVING count(DISTINCT direction) = 2", "captures")(lambda c: J.paired(c).select("pair_id", "request_id", "response_id"))
_TWICE = "SELECT id, session_id, role, content_text, ts FROM messages UNION ALL SELECT id || 'x', session_id, role, content_text, ts + 1 FROM messages WHERE turn_index % 2 = 0"
_NEW = f"with i AS ({_TWICE}), k AS (SELECT *, row_number() OVER (PARTITION BY session_id, role, substr(content_text, 1, 200) ORDER BY ts, id) AS nth FROM i), h AS (SELECT session_id, role, substr(content_text, 1, 200) AS t, count(*) AS have FROM messages WHERE turn_index < 3 GROUP BY ALL) SELECT k.id AS id FROM k LEFT JOIN h ON k.session_id = h.session_id AND k.role = h.role AND substr(content_text, 1, 200) = t WHERE nth > coalesce(have, 0)"


def _twice(m: DataFrame) -> DataFrame:
    m = m.select("id", "session_id", "role", "content_text", "ts", "turn_index")
    return m.unionByName(m.where("turn_index % 2 = 0").withColumns({"id": F.concat("id", F.lit("x")), "ts": F.col("ts") + 1}))


query("jon_19_positional_dedup", _NEW, "messages")(lambda m: S.positional_new(m.where("turn_index < 3"), _twice(m)).select("id"))

# --- windows, sorts, sets ---

query("win_01_turns", "SELECT id, row_number() OVER (PARTITION BY session_id ORDER BY ts, id) - 1 AS turn_index FROM messages", "messages")(lambda m: S.with_turns(m.withColumn("turn_index", F.lit(None).cast("int"))).select("id", F.col("turn_index").cast("long").alias("turn_index")))
query("win_02_appended", "with t AS (SELECT session_id, branch_id, max(turn_index) AS top FROM messages WHERE turn_index < 3 GROUP BY 1, 2) SELECT id, coalesce(top, -1) + row_number() OVER (PARTITION BY m.session_id, m.branch_id ORDER BY ts, id) AS turn_index FROM messages m LEFT JOIN t ON m.session_id = t.session_id AND m.branch_id = t.branch_id WHERE m.turn_index >= 3", "messages")(lambda m: S.appended_turns(m.where("turn_index < 3"), m.where("turn_index >= 3")).select("id", "turn_index"))
_SQUASH = "SELECT id, session_id, ts FROM (SELECT *, lead(role) OVER w AS nr, lead(id) OVER w AS ni FROM {t} WINDOW w AS (PARTITION BY session_id ORDER BY ts, id)) WHERE ni IS NULL OR role IS DISTINCT FROM nr"
query("win_03_squash", f"with i AS ({_TWICE}) {_SQUASH.format(t='i')}", "messages")(lambda m: S.squash(_twice(m)).select("id", "session_id", "ts"))
query("win_04_collapse", f"""with b AS (SELECT session_id, branch_id, max(ts) AS newest FROM messages GROUP BY 1, 2), w AS (SELECT session_id, arg_max(branch_id, (newest, branch_id = '0')) AS winner FROM b GROUP BY 1),
p AS (SELECT m.* FROM messages m JOIN w ON m.session_id = w.session_id WHERE branch_id = winner OR (branch_id = '0' AND turn_index < 2)) {_SQUASH.format(t='p')}""", "messages")(lambda m: S.collapse_branches(m).select("id", "session_id", "ts"))  # fmt: skip
query("win_07_latest_by_case", "SELECT lane, target, case_id, arg_max(status, (ts, id)) AS status, max(ts) AS ts FROM beacons WHERE case_id IS NOT NULL GROUP BY 1, 2, 3", "beacons")(H.latest_by_case)
query("win_08_repeats", f"with i AS ({_TWICE}) SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY session_id, role, substr(content_text, 1, 200) ORDER BY ts, id) AS nth FROM i) WHERE nth > 1", "messages")(lambda m: S.repeats(_twice(m)).select("id"))
query("win_10_newest", "SELECT id FROM captures ORDER BY created_at DESC, id DESC LIMIT 500", "captures")(lambda c: J.pruned_log(c, "created_at", 0.0, 500).select("id"))
query("srt_03_tail", "SELECT id FROM errors ORDER BY ts DESC, id DESC LIMIT 100 OFFSET 50", "errors")(lambda e: e.orderBy(F.desc("ts"), F.desc("id")).offset(50).limit(100).select("id"))
query("set_01_distinct", "SELECT DISTINCT provider, source_id FROM captures", "captures")(lambda c: c.select("provider", "source_id").distinct())

# --- scalars ---

_CJK = "length(regexp_replace({c}, '[^\\x{{4e00}}-\\x{{9fff}}\\x{{3040}}-\\x{{30ff}}\\x{{ac00}}-\\x{{d7af}}]', '', 'g'))".replace("{{", "{").replace("}}", "}")
_WORDS = "len(regexp_extract_all(coalesce({c}, ''), '[^\\s\\x0B]+'))"
query("scl_05_token_estimate", f"SELECT doc_id, CASE WHEN {_WORDS.format(c='text')} > 0 THEN greatest(CAST(trunc({_CJK.replace('{c}', 'text')} * 1.5 + ({_WORDS.format(c='text')} - {_CJK.replace('{c}', 'text')}) * 1.3) AS INTEGER), 1) END AS tokens FROM documents", "documents")(lambda d: d.select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens")))
query("scl_06_message_key", "SELECT id, concat(role, ':', substr(content_text, 1, 200)) AS k FROM messages", "messages")(lambda m: m.select("id", T.message_key(F.col("role"), F.col("content_text")).alias("k")))
query("scl_08_message_score", None, "messages")(lambda m: m.select("id", F.round(T.message_score(F.col("content_text"), F.col("model_name"), F.col("token_estimate"), F.lit(False)), 6).alias("score")))
query("scl_13_request_fingerprint", "SELECT id, sha256(concat('POST', '|', host, '|', path, '|', CAST(CAST(floor(created_at / 300) AS BIGINT) AS VARCHAR), '|', body)) AS fingerprint FROM captures", "captures")(lambda c: c.select("id", T.request_fingerprint(F.lit("post"), F.col("host"), F.col("path"), F.col("created_at"), F.col("body")).alias("fingerprint")))
query("scl_14_short_ids", "SELECT id, substr(sha256(pair_id), 1, 32) AS trace_id, substr(sha256(concat(pair_id, direction)), 1, 16) AS span_id FROM captures", "captures")(lambda c: c.select("id", T.short_id(F.col("pair_id"), 32).alias("trace_id"), T.short_id(F.concat("pair_id", "direction"), 16).alias("span_id")))
query("scl_16_scrub", None, "documents")(lambda d: d.select("doc_id", F.sha2(T.scrub(F.col("text")), 256).alias("scrubbed"), (T.scrub(F.col("text")) != F.col("text")).alias("changed")))
query("scl_22_url_parts", r"SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages WHERE regexp_matches(url, '^[a-z]+://[a-z0-9.-]+([/?#].*)?$')", "pages")(lambda p: p.where(F.col("url").rlike(r"^[a-z]+://[a-z0-9.-]+([/?#].*)?$")).select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1).alias("host")))
query("scl_32_truncated", None, "documents")(lambda d: d.where(T.looks_truncated(F.col("text"))).select("doc_id"))
query("agg_18_session_tags", "SELECT session_id, CAST(coalesce(sum(token_estimate), 0) AS BIGINT) AS total_tokens, coalesce(array_to_string(list_sort(list(DISTINCT model_name) FILTER (model_name IS NOT NULL)), ','), '') AS models FROM messages GROUP BY 1", "messages")(lambda m: S.tags(m).select("session_id", "total_tokens", "models"))
query("scl_11_topics", None, "messages")(lambda m: S.tags(m).select("session_id", "language", "topics"))

# --- traffic, failures, aliases: bodies and lines are made from the tables by number ---


def _aliases(m: DataFrame) -> DataFrame:
    attributes = F.create_map(F.lit("openinference.span.kind"), F.lit("LLM"), F.lit("llm.model_name"), F.col("model_name"), F.lit("llm.token_count.prompt"), F.col("token_estimate").cast("string"), F.lit("session.id"), F.col("session_id").cast("string"), F.concat(F.lit("llm.input_messages."), "turn_index", F.lit(".message.role")), F.col("role"))
    entries = F.transform(F.map_entries(K.genai_aliases(attributes)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return m.select("id", F.array_join(F.array_sort(entries), ",").alias("aliases"))


query("scl_29_aliases", """SELECT id, array_to_string(list_sort(list_filter(['gen_ai.operation.name=chat', 'gen_ai.request.model=' || model_name, 'gen_ai.response.model=' || model_name, 'gen_ai.usage.input_tokens=' || token_estimate, 'llm.usage.prompt_tokens=' || token_estimate,
'gen_ai.usage.total_tokens=' || token_estimate, 'llm.usage.total_tokens=' || token_estimate, 'gen_ai.conversation.id=' || session_id, 'gen_ai.prompt.' || turn_index || '.role=' || role], lambda x: x IS NOT NULL)), ',') AS aliases FROM messages""", "messages")(_aliases)  # fmt: skip


def _traffic(c: DataFrame) -> DataFrame:
    host = F.when(F.col("id") % 3 == 0, "api.openai.com").when(F.col("id") % 3 == 1, "llm-1.example").otherwise(F.col("host"))
    body = F.when(F.col("id") % 5 == 0, '{"model":"m","messages":[]}').when(F.col("id") % 5 == 1, '{"prompt":"x","temperature":1}').when(F.col("id") % 5 == 2, F.col("body")).when(F.col("id") % 5 == 3, "plain text here")
    found = c.select("id", K.ai_request(host, F.col("path"), F.lit("POST"), body).alias("found"))
    return found.select("id", "found.confidence", F.array_join("found.reasons", "|").alias("reasons"))


query("scl_30_ai_requests", r"""SELECT id, CASE WHEN id % 5 = 0 THEN 'high' WHEN id % 3 < 2 OR id % 5 = 1 THEN 'medium' END AS confidence,
concat_ws('|', CASE id % 3 WHEN 0 THEN 'domain_pattern:.*\.openai\.com$' WHEN 1 THEN 'domain_pattern:.*llm.*\..*$' END, CASE id % 5 WHEN 0 THEN 'request_fields:messages+model' WHEN 1 THEN 'request_fields:prompt+temperature' END) AS reasons FROM captures""".replace("\\\\", "\\"), "captures")(_traffic)  # fmt: skip
_MARKS = "len(regexp_extract_all(t, '(?im)^(?:{m})\\s*[:：]'))"
_STYLE = " + ".join(f"CASE WHEN regexp_matches(t, '{p.replace('(?md)', '(?m)').replace(chr(39), chr(39) * 2)}') THEN 1 ELSE 0 END" for p in K.ANSWER_STYLE)
query("scl_31_clipboard", f"""with x AS (SELECT id, concat('User: ', content_text, chr(10), 'Assistant: ', content_text) AS t FROM messages), y AS (SELECT id, length(t) AS n, {_MARKS.format(m=K.USER_MARKS)} AS u, {_MARKS.format(m=K.MODEL_MARKS)} AS a, {_STYLE} AS s, len(regexp_extract_all(t, '```')) AS f FROM x)
SELECT id, CASE WHEN n >= 100 THEN least(100, CASE WHEN u + a >= 2 THEN 40 ELSE 0 END + CASE WHEN u > 0 AND a > 0 THEN 30 ELSE 0 END + least(s, 2) * 10 + CASE WHEN f >= 2 THEN 10 ELSE 0 END + CASE WHEN n > 500 THEN 5 ELSE 0 END + CASE WHEN n > 2000 THEN 5 ELSE 0 END) / 100.0::DOUBLE ELSE 0.0 END::DOUBLE AS score FROM y""", "messages")(lambda m: m.select("id", K.conversation_score(F.concat(F.lit("User: "), F.coalesce("content_text", F.lit("")), F.lit("\nAssistant: "), F.coalesce("content_text", F.lit("")))).alias("score")))  # fmt: skip
query("scl_31_turns", None, "messages")(lambda m: m.select("id", F.size(K.conversation_messages(F.concat(F.lit("User: "), F.coalesce("content_text", F.lit("")), F.lit("\nAssistant: noted")))).alias("turns")))


def _failures(e: DataFrame) -> DataFrame:
    stderr = F.when(F.col("id") % 5 == 0, "Connection refused by peer").when(F.col("id") % 5 == 1, "KeyError: 'model'").when(F.col("id") % 5 == 2, "request timed out").when(F.col("id") % 5 == 3, "")
    found = K.failure_class(F.col("id") % 7, stderr, F.when(F.col("id") % 2 == 0, "sign in to continue"), F.col("id") % 11, F.lit(10))
    return e.select(found.alias("found")).groupBy("found.kind", "found.severity").agg(F.count("*").alias("n"))


query("scl_35_failures", """with k AS (SELECT CASE WHEN id % 7 = 0 THEN 'UNKNOWN' WHEN id % 11 = 10 THEN 'RACE_TIMEOUT' WHEN id % 5 = 0 THEN 'INFRA' WHEN id % 5 = 1 THEN 'SCHEMA_DRIFT' WHEN id % 5 = 2 THEN 'RACE_TIMEOUT' WHEN id % 2 = 0 THEN 'LOGIN_WALL' ELSE 'UNKNOWN' END AS kind FROM errors)
SELECT kind, CASE kind WHEN 'UNKNOWN' THEN 'info' WHEN 'RACE_TIMEOUT' THEN 'soft' ELSE 'hard' END AS severity, count(*) AS n FROM k GROUP BY 1, 2""", "errors")(_failures)  # fmt: skip

query("scl_34_shape", """SELECT '$' AS path, NULL AS parent, 'object' AS types, count(*) AS n, false AS required FROM captures WHERE json_valid(body)
UNION ALL SELECT '$.k', '$', 'integer', count(body ->> '$.k'), count(body ->> '$.k') >= count(*) FROM captures WHERE json_valid(body)""", "captures")(lambda c: M.shape_of(c, "body"))  # fmt: skip


def _merged_keys(m: DataFrame) -> DataFrame:
    file = lambda n: F.concat(F.lit('{"attachments":[{"type":"file","name":"f'), (F.col("turn_index") % n).cast("string"), F.lit('"}]}'))
    return m.select("id", F.array_join(C.attachment_keys(C.merged_content(file(3), file(2))), ",").alias("keys"))


query("scl_23_merged", "SELECT id, concat_ws(',', 'file:name:f' || turn_index % 3, CASE WHEN turn_index % 3 <> turn_index % 2 THEN 'file:name:f' || turn_index % 2 END) AS keys FROM messages", "messages")(_merged_keys)

# --- health ---

_COUNTS = ", ".join(f"count(*) FILTER (status = '{s}') AS n_{s}" for s in H.STATUSES)
_MATRIX = f"""with b AS (SELECT lane, target, {_COUNTS}, count(DISTINCT layer) FILTER (status = 'pass') AS planes, max(ts) FILTER (status = 'pass') AS last_pass, count(*) AS n FROM beacons WHERE ts >= {NOW} - 36000 * 24 GROUP BY 1, 2),
x AS (SELECT lane, target, {', '.join(f'n_{s}' for s in H.STATUSES)}, planes, last_pass, round(n_pass / n, 4) AS pass_rate, CASE WHEN (last_pass IS NULL OR last_pass < {NOW} - 21600) AND (n_fail > 0 OR n_degraded > 0) THEN 'red' WHEN n_pass / n < 0.8 AND (n_fail > 0 OR n_degraded > 0) THEN 'yellow' WHEN n_degraded >= 1 THEN 'yellow' WHEN n_pass / n >= 0.9 THEN 'green' ELSE 'grey' END AS colour FROM b)"""
query("agg_14_matrix", f"{_MATRIX} SELECT * FROM x", "beacons")(lambda b: H.matrix(b, NOW, 240))
query("agg_14_lane_severity", f"{_MATRIX} SELECT lane, arg_max(colour, list_position(['green', 'grey', 'yellow', 'red'], colour)) AS colour, count(*) AS targets FROM x GROUP BY 1", "beacons")(lambda b: H.lane_severity(H.matrix(b, NOW, 240)))
query("agg_15_status_series", f"SELECT CAST(floor(ts / 3600) * 3600 AS BIGINT) AS bucket, {_COUNTS} FROM beacons GROUP BY 1", "beacons")(H.status_series)
query("agg_16_signals", "SELECT lane, target, layer, max(ts) FILTER (status = 'pass') AS last_pass, max(ts) FILTER (status = 'fail') AS last_fail FROM beacons GROUP BY 1, 2, 3", "beacons")(lambda b: H.signals(b, ["lane", "target", "layer"]))
_LEG_ROWS = [("s0", "a", "t0", "browser", "L0", 2), ("s0", "b", "t0", "desktop", None, 2), ("s0", "c", "t0", None, "L2", 2), ("s1", "a", "t1", None, None, 3), ("s1", "b", "t4", "cli", "L1", 3), ("s2", "a", "nowhere", None, None, 1)]


def _scenarios(b: DataFrame) -> DataFrame:
    legs = b.sparkSession.createDataFrame(_LEG_ROWS, "scenario string, leg string, target string, lane string, layer string, wanted int")
    return H.scenario_status(legs, b, NOW, 240)


_LEG_SQL = ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in r) + ")" for r in _LEG_ROWS)
query("agg_17_scenarios", f"""with l(scenario, leg, target, lane, layer, wanted) AS (VALUES {_LEG_SQL}),
s AS (SELECT scenario, leg, wanted, max(ts) FILTER (status = 'pass') AS p, max(ts) FILTER (status = 'fail') AS f FROM l LEFT JOIN beacons b ON b.target = l.target AND (l.lane IS NULL OR l.lane = b.lane) AND (l.layer IS NULL OR l.layer = b.layer) GROUP BY 1, 2, 3),
h AS (SELECT *, coalesce(p >= {NOW} - 864000, false) AS pi, coalesce(f >= {NOW} - 864000, false) AS fi FROM s),
g AS (SELECT *, CASE WHEN NOT pi AND NOT fi THEN 'unknown' WHEN pi AND NOT fi THEN 'green' WHEN NOT pi THEN 'red' WHEN f > p THEN 'yellow' ELSE 'green' END AS health FROM h)
SELECT scenario, wanted, count(*) AS legs, count(*) FILTER (health = 'green') AS active, count(*) FILTER (health = 'yellow') AS degraded, CASE WHEN bool_and(health = 'unknown') THEN 'grey' WHEN count(*) FILTER (health = 'green') >= wanted THEN 'redundant' WHEN count(*) FILTER (health = 'green') >= 2 THEN 'minimal' WHEN count(*) FILTER (health = 'green') = 1 THEN 'impaired' ELSE 'down' END AS status FROM g GROUP BY 1, 2""", "beacons")(_scenarios)  # fmt: skip
query("scl_20_beacon_checks", f"SELECT id, CASE WHEN NOT regexp_matches(target, '^[a-z0-9_\\-]+$') THEN 'invalid_target' WHEN case_id IS NOT NULL AND NOT regexp_matches(case_id, '^[A-Z]\\d{{2}}$') THEN 'invalid_case_id' WHEN abs(ts - {NOW}) > 300 THEN 'ts_skew' END AS rejected_for FROM beacons", "beacons")(lambda b: H.validated(b.withColumn("meta_json", F.lit(None).cast("string")), NOW).select("id", "rejected_for"))
query("agg_25_audit", None, "sessions", "messages")(Q.audit)

# --- search ---

_FOLD = "strip_accents(lower(coalesce({c}, '')))"
query("srh_02_substring", "SELECT doc_id FROM documents WHERE position('license' IN lower(text)) > 0 ORDER BY n_chars DESC, doc_id LIMIT 20", "documents")(lambda d: R.substring(d, "doc_id", "text", "license", "n_chars").select("doc_id"))
_BM25 = f"""with t AS (SELECT doc_id, regexp_extract_all({_FOLD.format(c='text')}, '[\\p{{L}}\\p{{N}}]+') AS t FROM documents),
c AS (SELECT doc_id, len(t) AS n, len(list_filter(t, lambda x: x = 'apache')) AS f0, len(list_filter(t, lambda x: x = 'license')) AS f1 FROM t),
g AS (SELECT count(*) AS docs, avg(n) AS mean, count(*) FILTER (f0 > 0) AS d0, count(*) FILTER (f1 > 0) AS d1 FROM c),
lexical AS (SELECT doc_id, round(ln(1 + (docs - d0 + 0.5) / (d0 + 0.5)) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * n / mean)) + ln(1 + (docs - d1 + 0.5) / (d1 + 0.5)) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * n / mean)), 4) AS score FROM c, g WHERE f0 > 0 AND f1 > 0 ORDER BY score DESC, doc_id LIMIT {{k}})"""
_TERMS = "apache (license)"
ORACLE_SQL["srh_01_lexical"] = _BM25.replace("{k}", "20").replace("with ", "WITH ", 1) + " SELECT * FROM lexical"
query("srh_01_lexical", None, "documents")(lambda d: R.lexical(d, "doc_id", "text", _TERMS, 20))


def _query_vector(e: DataFrame) -> list[float]:
    return list(e.orderBy("vec_id").select("embedding").first()[0])


_KNN = "SELECT vec_id AS doc_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings ORDER BY vec_id LIMIT 1)), 6) AS score FROM embeddings ORDER BY score DESC, doc_id LIMIT {k}"
ORACLE_SQL["srh_05_nearest"] = _KNN.replace("{k}", "10")
query("srh_05_nearest", None, "embeddings")(lambda e: R.nearest(e.withColumnRenamed("vec_id", "doc_id"), "doc_id", "embedding", _query_vector(e), 10))
ORACLE_SQL["srh_06_hybrid"] = _BM25.replace("{k}", "30").replace("with ", "WITH ", 1) + f", semantic AS ({_KNN.replace('{k}', '30')}), u AS (SELECT doc_id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, doc_id)) AS s FROM lexical UNION ALL SELECT doc_id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, doc_id)) FROM semantic) SELECT doc_id, round(sum(s), 6) AS score FROM u GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 10"
query("srh_06_hybrid", None, "documents", "embeddings")(lambda d, e: R.fused([R.lexical(d, "doc_id", "text", _TERMS, R.depth(10)), R.nearest(e.withColumnRenamed("vec_id", "doc_id"), "doc_id", "embedding", _query_vector(e), R.depth(10))], "doc_id", 10))

# --- state machines, streams in batch form ---

_GREEDY = "with RECURSIVE "
query("stm_01_dedup", None, "captures")(lambda c: G.deduplicated(c.select("id", "created_at", "session_hint"), ["session_hint"], 6 * HOUR).where("is_primary").select("id"))
ORACLE_SQL["stm_01_dedup"] = cte("captures").replace("WITH ", "WITH RECURSIVE ", 1) + ", p AS (SELECT session_hint, min(created_at) AS t FROM captures GROUP BY 1 UNION ALL SELECT session_hint, (SELECT min(created_at) FROM captures c WHERE c.session_hint = p.session_hint AND c.created_at - p.t > 21600) FROM p WHERE t IS NOT NULL) SELECT min(id) AS id FROM captures c JOIN p ON c.session_hint = p.session_hint AND c.created_at = p.t GROUP BY c.session_hint, p.t"
query("stm_05_heartbeats", None, "beacons")(lambda b: G.throttled(b.where("case_id is null"), 2.0 * HOUR).where("accepted").select("id"))
ORACLE_SQL["stm_05_heartbeats"] = cte("beacons").replace("WITH ", "WITH RECURSIVE ", 1) + ", b AS (SELECT * FROM beacons WHERE case_id IS NULL), p AS (SELECT lane, target, min(ts) AS t FROM b GROUP BY 1, 2 UNION ALL SELECT lane, target, (SELECT min(ts) FROM b WHERE b.lane = p.lane AND b.target = p.target AND b.ts - p.t >= 7200) FROM p WHERE t IS NOT NULL) SELECT min(id) AS id FROM b JOIN p ON b.lane = p.lane AND b.target = p.target AND b.ts = p.t GROUP BY b.lane, b.target, p.t"
query("stm_06_bursts", None, "beacons")(lambda b: G.throttled(b.where("case_id is not null"), limit=3, window=3.0 * HOUR).select("id", "accepted"))
query("stm_07_tumbling", "SELECT CAST(floor(created_at / 300) * 300 AS BIGINT) AS start, host, count(*) AS n FROM captures GROUP BY 1, 2", "captures")(lambda c: c.groupBy(F.unix_timestamp(F.window(F.timestamp_seconds("created_at"), "5 minutes")["start"]).alias("start"), "host").agg(F.count("*").alias("n")))
query("stm_10_retention", f"SELECT id FROM messages WHERE ts >= 1704100000 OR session_id IN (SELECT id FROM sessions WHERE favorited = 1)", "captures", "messages", "sessions")(lambda c, m, s: J.retained(c, m, s, 1704100000.0, 1000)[1].select("id"))
query("stm_11_pruned", f"SELECT id FROM errors WHERE ts >= {NOW} - 7 * 86400 ORDER BY ts DESC, id DESC LIMIT 10000", "errors")(lambda e: J.pruned_log(e, "ts", NOW - 7 * A.DAY, 10_000).select("id"))
query("stm_14_reset", "SELECT id FROM messages WHERE session_id IN (SELECT id FROM sessions WHERE favorited = 1)", "captures", "messages", "sessions")(lambda c, m, s: J.reset(c, m, s)[1].select("id"))

# --- normalisation: bodies are made from the conversations, and must come back as they were ---


def _bodies(m: DataFrame, stream: bool) -> DataFrame:
    """Each assistant turn as a response, and the turn before it as its request."""
    order = Window.partitionBy("session_id").orderBy("turn_index")
    rows = m.withColumns({"before_role": F.lag("role").over(order), "before_text": F.lag("content_text").over(order)}).where("role = 'assistant' and before_role is not null")
    request = F.to_json(F.struct(F.lit("m1").alias("model"), F.array(F.struct(F.col("before_role").alias("role"), F.col("before_text").alias("content"))).alias("messages")))
    whole = F.to_json(F.struct(F.lit("m1").alias("model"), F.array(F.struct(F.struct(F.col("role"), F.col("content_text").alias("content")).alias("message"))).alias("choices")))
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length("content_text") - 1) / 40).cast("int")), lambda i: F.substring(F.col("content_text"), i * 40 + 1, F.lit(40)))
    events = F.transform(pieces, lambda p: F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(p.alias("content")).alias("delta"))).alias("choices")))))
    streamed = F.concat(F.array_join(events, "\n\n"), F.lit("\n\ndata: [DONE]\n"))
    return rows.select(F.col("id").alias("pair_id"), "ts", request.alias("request"), (streamed if stream else whole).alias("response"))


_BACK = "with p AS (SELECT *, lag(role) OVER w AS br, lag(content_text) OVER w AS bt FROM messages WINDOW w AS (PARTITION BY session_id ORDER BY turn_index)) SELECT id AS pair_id, 0 AS turn_index, br AS role, bt AS content_text FROM p WHERE role = 'assistant' AND br IS NOT NULL UNION ALL SELECT id, 1, role, content_text FROM p WHERE role = 'assistant' AND br IS NOT NULL AND content_text <> ''"
query("nrm_01_pairs", _BACK, "messages")(lambda m: N.normalised(_bodies(m, False)).select("pair_id", "turn_index", "role", "content_text"))
query("nrm_09_event_streams", _BACK, "messages")(lambda m: N.normalised(_bodies(m, True)).select("pair_id", "turn_index", "role", "content_text"))


def _odd_bodies(m: DataFrame) -> DataFrame:
    """Each message as the request of one of three shapes, by its turn."""
    text = F.col("content_text")
    shape = F.col("turn_index") % 3
    chat = F.to_json(F.struct(F.lit("m1").alias("model"), F.array(F.struct("role", text.alias("content"))).alias("messages")))
    parts = F.to_json(F.struct(F.array(F.struct(F.array(F.struct(text.alias("text"))).alias("parts"))).alias("contents")))
    response = F.when(shape == 0, '{"choices":[{"message":{"content":"fine"}}]}').when(shape == 1, '{"candidates":[{"content":{"parts":[{"text":"fine"}]}}]}').otherwise('{"output":"fine"}')
    request = F.when(shape == 0, chat).when(shape == 1, parts).otherwise(F.to_json(F.struct(text.alias("prompt"))))
    return m.where("length(trim(content_text)) > 3 and content_text not like '[%'").select(F.col("id").alias("pair_id"), F.lit("x.example").alias("host"), request.alias("request"), response.alias("response"))


query("nrm_06_recovered", """with p AS (SELECT *, turn_index % 3 AS s FROM messages WHERE length(trim(content_text)) > 3 AND content_text NOT LIKE '[%'),
c AS (SELECT *, CASE s WHEN 0 THEN 'chat' WHEN 1 THEN 'parts' ELSE 'bare' END AS shape, CASE s WHEN 0 THEN CASE WHEN role = 'user' THEN 0.65 ELSE 0.45 END WHEN 1 THEN 0.7 ELSE 0.35 END::DOUBLE AS confidence FROM p)
SELECT id AS pair_id, shape, 0 AS turn_index, CASE WHEN s = 0 THEN role ELSE 'user' END AS role, content_text, confidence FROM c UNION ALL SELECT id, shape, 1, 'assistant', 'fine', confidence FROM c""", "messages")(lambda m: B.recovered_messages(_odd_bodies(m)))  # fmt: skip
query("nrm_13_merged", "SELECT session_id, role, arg_max(content_text, length(content_text)) AS content_text, max(token_estimate) AS token_estimate FROM messages GROUP BY session_id, role, substr(content_text, 1, 200)", "messages")(lambda m: N.merged(m.withColumn("token_estimate", F.lit(None).cast("int")), m).select("session_id", "role", "content_text", "token_estimate"))
query("nrm_15_import", "SELECT session_id, role, substr(content_text, 1, 200) AS head FROM messages GROUP BY ALL", "messages")(lambda m: S.set_new(_twice(m).limit(0), _twice(m)).select("session_id", "role", F.substring("content_text", 1, 200).alias("head")))
query("snk_05_upsert", "SELECT id, CASE WHEN id % 3 = 0 THEN 'new' ELSE direction END AS direction FROM captures", "captures")(lambda c: X.upserted(c.select("id", "direction"), c.where("id % 3 = 0").select("id", F.lit("new").alias("direction")), ["id"]))
query("snk_10_envelopes", "SELECT CAST(id AS VARCHAR) AS session_id, provider, (SELECT count(*) FROM messages m WHERE m.session_id = sessions.id) AS n FROM sessions", "sessions", "messages")(lambda s, m: X.envelopes(s, m).select("session_id", "provider", F.size("messages").cast("long").alias("n")))
query("snk_11_markdown", None, "sessions", "messages")(X.markdown)

from . import catalog_binary, catalog_formats, catalog_more, catalog_search, catalog_streams  # noqa: E402, F401
