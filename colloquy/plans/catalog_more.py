"""Further queries and their SQL: conversions, postings, persistence and reports. Importing it registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import convert as V
from ..functions import text as T
from ..operators import persist as E
from ..operators import postings as P
from ..operators import reports as O
from ..operators import search as R
from ..operators.versions import Step, Store
from ..sources.folders import fresh_folder
from .catalog import _BM25, _FOLD, _KNN, NOW, ORACLE_SQL, _query_vector, query

# --- search over an index ---

_WORDS = "apache license"
_TWO = _BM25.replace("{k}", "20").replace("with ", "WITH ", 1)
_OF_MESSAGES = f"regexp_extract_all({_FOLD.format(c='content_text')}, '[\\p{{L}}\\p{{N}}]+')"
query("srh_01_postings", None, "documents")(lambda d: P.search(d, "doc_id", "text", _WORDS, "lexical").withColumnRenamed("key", "doc_id"))
ORACLE_SQL["srh_01_postings"] = _TWO + " SELECT * FROM lexical"
query("srh_07_degraded", None, "documents")(lambda d: P.search(d, "doc_id", "text", _WORDS, "semantic").withColumnRenamed("key", "doc_id"))
ORACLE_SQL["srh_07_degraded"] = _TWO + " SELECT * FROM lexical"
query("srh_03_cjk", "SELECT doc_id AS key, 1.0::DOUBLE AS score FROM documents WHERE position('東京' IN text) > 0 ORDER BY doc_id DESC LIMIT 20", "documents")(lambda d: P.search(d, "doc_id", "text", "東京", "lexical"))
query("srh_08_backfill", "SELECT doc_id AS key, 64 AS dimensions FROM documents d WHERE trim(text) <> '' AND NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id) ORDER BY n_chars DESC, doc_id DESC LIMIT 500", "documents", "embeddings")(lambda d, e: P.missing_vectors(d, "doc_id", "text", "n_chars", e, "vec_id").select("key", F.size("vector").alias("dimensions")))
query("srh_09_lag", "SELECT max(doc_id) AS newest, max(doc_id) FILTER (WHERE n_chars < 2000 AND regexp_matches(text, '[\\p{L}\\p{N}]')) AS indexed, max(doc_id) - max(doc_id) FILTER (WHERE n_chars < 2000 AND regexp_matches(text, '[\\p{L}\\p{N}]')) AS lag FROM documents", "documents")(lambda d: P.lag(d, "doc_id", P.build_postings(d.where("n_chars < 2000"), "doc_id", "text")))
query("srh_09_postings", f"with w AS (SELECT id, unnest({_OF_MESSAGES}) AS term FROM messages) SELECT term, count(DISTINCT id) AS holders, count(*) AS times FROM w GROUP BY 1", "messages")(lambda m: P.build_postings(m, "id", "content_text").where("term is not null").groupBy("term").agg(F.count("*").alias("holders"), F.sum("times").alias("times")))
query(
    "jon_04_matched_messages",
    f"""with m AS (SELECT *, {_OF_MESSAGES} AS t FROM messages), c AS (SELECT *, len(t) AS n, len(list_filter(t, lambda x: x = 'the')) AS f0, len(list_filter(t, lambda x: x = 'and')) AS f1 FROM m),
g AS (SELECT count(*) AS docs, avg(n) AS mean, count(*) FILTER (WHERE f0 > 0) AS d0, count(*) FILTER (WHERE f1 > 0) AS d1 FROM c),
r AS (SELECT c.id, c.session_id, round(ln(1 + (docs - d0 + 0.5) / (d0 + 0.5)) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * n / mean)) + ln(1 + (docs - d1 + 0.5) / (d1 + 0.5)) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * n / mean)), 4) AS score FROM c, g WHERE f0 > 0 AND f1 > 0)
SELECT r.id AS key, r.session_id, s.provider, s.title_hint, r.score FROM r JOIN sessions s ON r.session_id = s.id WHERE s.provider = 'openai' ORDER BY score DESC, key LIMIT 20""",
    "messages", "sessions",
)(lambda m, s: P.best_messages(P.build_postings(m, "id", "content_text"), m, s, "the and", "openai"))


def _vector_hits(e: DataFrame, m: DataFrame, s: DataFrame) -> DataFrame:
    scored = R.nearest(e.withColumnRenamed("vec_id", "doc_id"), "doc_id", "embedding", _query_vector(e), 30).withColumnRenamed("doc_id", "key")
    turns = m.where("turn_index = 0").withColumn("turn_id", F.col("session_id"))
    return P.best_vectors(e, turns, s, scored)


query("jon_03_vector_hits", None, "embeddings", "messages", "sessions")(_vector_hits)
_SESSIONS = "sessions AS (SELECT conv_id AS id, CASE conv_id % 3 WHEN 0 THEN 'openai' WHEN 1 THEN 'anthropic' ELSE 'google' END AS provider FROM conversations GROUP BY 1)"
ORACLE_SQL["jon_03_vector_hits"] = f"WITH {_SESSIONS}, semantic AS ({_KNN.replace('{k}', '30')}) SELECT doc_id AS key, c.conv_id AS session_id, provider, score FROM semantic JOIN conversations c ON doc_id = c.conv_id AND turn = 0 JOIN sessions s ON s.id = c.conv_id ORDER BY score DESC, key LIMIT 10"

# --- conversions ---

query("scl_03_times", "SELECT id, CAST(floor(created_at * 1000) AS BIGINT) AS ms, strftime(make_timestamp(CAST(created_at * 1e6 AS BIGINT)), '%Y-%m-%d %H:%M UTC') AS shown FROM captures", "captures")(lambda c: c.select("id", V.iso_to_ms(V.utc_format(F.col("created_at"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).alias("ms"), V.display_time(F.col("created_at")).alias("shown")))
query("scl_04_day_keys", "SELECT concat('mcp-proxy:', host, ':', strftime(make_timestamp(CAST(created_at * 1e6 AS BIGINT)), '%Y-%m-%d')) AS session_key, count(*) AS n FROM captures GROUP BY 1", "captures")(lambda c: c.groupBy(V.day_key("mcp-proxy", F.col("host"), F.col("created_at")).alias("session_key")).agg(F.count("*").alias("n")))
query("scl_15_short_hash", """with h AS (SELECT id, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(substr(content_text, 1, 60), ''), lambda x: unicode(x)::BIGINT)), lambda h, c: ((h * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648) AS h FROM messages)
SELECT id, concat(CASE WHEN h < 0 THEN '-' ELSE '' END, lower(to_base(abs(h), 36))) AS h FROM h""", "messages")(lambda m: m.select("id", V.short_hash(F.substring("content_text", 1, 60)).alias("h")))  # fmt: skip
query("scl_18_bodies", "SELECT id, substr(body, 1, 20) AS text, CASE WHEN regexp_matches(substr(body, 1, 20), '^\\s*[{\\[]') THEN 'json' ELSE 'text' END AS format FROM (SELECT id, coalesce(body, '') AS body FROM captures)", "captures")(lambda c: c.select("id", V.safe_body(F.col("body"), 20)[0].alias("text"), V.safe_body(F.col("body"), 20)[1].alias("format")))
_HOSTS = "list_value('api.openai.com', 'claude.ai', 'x.example', 'generativelanguage.googleapis.com', 'api.githubcopilot.com', 'grok.com', '')"
query("scl_44_providers", f"SELECT id, ({_HOSTS})[1 + id % 7] AS host, (list_value('openai', 'anthropic', 'x.example', 'google', 'github-copilot', 'xai', ''))[1 + id % 7] AS provider FROM captures", "captures")(lambda c: c.select("id", F.element_at(F.array(*[F.lit(x) for x in ("api.openai.com", "claude.ai", "x.example", "generativelanguage.googleapis.com", "api.githubcopilot.com", "grok.com", "")]), (F.col("id") % 7 + 1).cast("int")).alias("host")).withColumn("provider", V.provider_of_host(F.col("host"))))
query("scl_41_branch_ids", "SELECT id, concat(session_id, ':branch:', greatest(0, 6 - 4) + turn_index, ':', substr(sha1(concat(role, ':', substr(content_text, 1, 160))), 1, 12)) AS branch FROM messages", "messages")(lambda m: m.select("id", V.branch_id(F.col("session_id").cast("string"), V.global_index(F.lit(6), F.lit(4), F.col("turn_index")), F.col("role"), F.col("content_text")).alias("branch")))


def _older_captures(c: DataFrame) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(x) for x in ("proxy", "Browser_Extension ", "ide_plugin", "local_model", "else")]), (F.col("id") % 5 + 1).cast("int"))
    body = F.when(F.col("id") % 4 == 0, F.lit('{"a":1}')).when(F.col("id") % 4 == 1, F.lit("[1,2]")).when(F.col("id") % 4 == 2, F.lit("not json")).otherwise(F.lit(None).cast("string"))
    return c.select("id", kind.alias("source_type"), F.when(F.col("id") % 3 > 0, F.col("direction")).alias("direction"), body.alias("body_json"), F.when(F.col("id") % 8 == 4, "text").alias("body_format"), F.when(F.col("id") % 6 == 0, '{"h":"v"}').when(F.col("id") % 6 == 1, "[1]").alias("headers_json"))


query("nrm_17_events", """with c AS (SELECT id, CASE id % 5 WHEN 0 THEN 'L1_mitm' WHEN 1 THEN 'L3a_browser_ext' WHEN 2 THEN 'L3c_vscode_ext' WHEN 3 THEN 'L3e_litellm' ELSE 'L1_mitm' END AS source,
CASE WHEN id % 3 > 0 AND direction IN ('request', 'response') THEN direction ELSE 'pair' END AS direction,
CASE id % 4 WHEN 0 THEN CASE WHEN id % 8 = 4 THEN '{"text":"{\\"a\\":1}"}' ELSE '{"a":1}' END WHEN 1 THEN '{"value":[1,2]}' WHEN 2 THEN '{"text":"not json"}' END AS body, CASE id % 6 WHEN 0 THEN '{"h":"v"}' WHEN 1 THEN NULL ELSE '{}' END AS headers FROM captures)
SELECT id, source, direction, CASE WHEN direction <> 'response' THEN headers END AS request_headers, CASE WHEN direction = 'request' THEN body END AS request_body, CASE WHEN direction = 'response' THEN headers END AS response_headers, CASE WHEN direction <> 'request' THEN body END AS response_body FROM c""", "captures")(lambda c: _older_captures(c).select("id", *V.upgraded_event()))  # fmt: skip

# --- what later captures change ---


def _better(s: DataFrame) -> DataFrame:
    return s.where("id % 2 = 0").select("id", F.when(F.col("id") % 6 == 0, "unknown").otherwise("mistral").alias("provider"), F.concat(F.lit("Better "), F.col("id")).alias("title_hint"), F.lit("import").alias("created_via"))


query("snk_04_upgraded", """with w AS (SELECT id, CASE WHEN id % 4 = 0 THEN 'unknown' ELSE provider END AS provider, CASE WHEN id % 5 = 0 THEN '{"a"' ELSE title_hint END AS title_hint, CASE WHEN id % 3 = 0 THEN 'browser_extension_network' ELSE 'proxy' END AS created_via FROM sessions)
SELECT id, CASE WHEN provider = 'unknown' AND id % 2 = 0 AND id % 6 <> 0 THEN 'mistral' ELSE provider END AS provider, CASE WHEN (title_hint LIKE '{%' OR title_hint = '') AND id % 2 = 0 THEN concat('Better ', id) ELSE title_hint END AS title_hint, CASE WHEN created_via = 'browser_extension_network' AND id % 2 = 0 THEN 'import' ELSE created_via END AS created_via FROM w""", "sessions")(lambda s: E.upgraded_sessions(s.select("id", F.when(F.col("id") % 4 == 0, "unknown").otherwise(F.col("provider")).alias("provider"), F.when(F.col("id") % 5 == 0, '{"a"').otherwise(F.col("title_hint")).alias("title_hint"), F.when(F.col("id") % 3 == 0, "browser_extension_network").otherwise("proxy").alias("created_via")), _better(s)))  # fmt: skip
query("scl_37_merged_meta", "SELECT session_id, array_to_string(list_sort(list_distinct(list(concat('f', turn_index % 3)))), ',') AS files, arg_max(concat('style', turn_index), turn_index) FILTER (WHERE turn_index % 2 = 0) AS style FROM messages GROUP BY 1", "messages")(lambda m: E.merged_meta(m.select("session_id", "turn_index", F.array(F.concat(F.lit("f"), F.col("turn_index") % 3)).alias("files"), F.when(F.col("turn_index") % 2 == 0, F.concat(F.lit("style"), F.col("turn_index"))).otherwise("").alias("style")), ("files",), ("style",), "turn_index").withColumn("files", F.array_join(F.array_sort("files"), ",")))
query("set_03_attachments", "SELECT id, CASE WHEN turn_index % 2 = 0 THEN 1 ELSE 2 END AS n FROM messages", "messages")(lambda m: m.select("id", F.size(E.without_repeats(F.array(*[F.struct(F.lit(x).alias("type"), y.cast("long").alias("n")) for x, y in (("file", F.lit(1)), ("file", F.lit(1)), ("file", F.lit(1) + F.col("turn_index") % 2))]))).alias("n")))


def _with_parents(m: DataFrame) -> DataFrame:
    parent = F.when(F.col("turn_index") > 0, F.concat_ws("-", F.col("session_id").cast("string"), (F.col("turn_index") - 1).cast("string")))
    return m.select("session_id", "id", parent.alias("parent_id"), "role", F.col("content_text").alias("text"), "ts")


def _arriving(m: DataFrame) -> DataFrame:
    """Replays of all messages, in pairs; of every third odd turn the text is new, and one in seven has an unknown parent."""
    text = F.when(F.col("turn_index") % 6 == 1, F.concat(F.col("text"), F.lit(" again"))).otherwise(F.col("text"))
    parent = F.when(F.col("session_id") % 7 == 3, F.concat("parent_id", F.lit("?"))).otherwise(F.col("parent_id"))
    rows = _with_parents(m).withColumn("turn_index", F.element_at(F.split("id", "-"), -1).cast("int"))
    return rows.select("session_id", F.concat("id", F.lit("x")).alias("id"), F.concat_ws("/", F.col("session_id").cast("string"), F.floor(F.col("turn_index") / 2).cast("string")).alias("completion"), parent.alias("parent_id"), "role", text.alias("text"), "ts")


query("win_06_live_forks", """SELECT session_id, concat(session_id, '/', turn_index // 2) AS completion, min(id) AS fork_of, substr(sha1(concat(session_id, '/', turn_index // 2, ':', min(id))), 1, 12) AS branch_id
FROM messages WHERE turn_index % 6 = 1 AND session_id % 7 <> 3 AND content_text IS NOT NULL GROUP BY session_id, turn_index // 2""", "messages")(lambda m: E.live_forks(_with_parents(m), _arriving(m)))  # fmt: skip


def _slice(s: DataFrame, m: DataFrame) -> DataFrame:
    parts = E.evidence_slice(s.where("provider = 'openai'").select(F.col("id").alias("session_id")), {"sessions": (s, "id"), "messages": (m, "session_id")})
    return parts["sessions"].select(F.lit("sessions").alias("part"), F.col("id").cast("string").alias("id")).unionByName(parts["messages"].select(F.lit("messages").alias("part"), "id"))


query("snk_13_evidence", "SELECT 'sessions' AS part, CAST(id AS VARCHAR) AS id FROM sessions WHERE provider = 'openai' UNION ALL SELECT 'messages', m.id FROM messages m JOIN sessions s ON m.session_id = s.id WHERE s.provider = 'openai'", "sessions", "messages")(_slice)

# --- reports ---


def _with_content(m: DataFrame) -> DataFrame:
    typed = lambda *names: F.array(*[F.struct(F.lit(x).alias("type")) for x in names])
    content = F.when(F.col("turn_index") % 3 == 0, F.to_json(F.struct(typed("image", "file").alias("attachments"), F.struct(typed("code").alias("blocks")).alias("rich_content")))).when(F.col("turn_index") % 3 == 1, F.to_json(F.struct(typed("file").alias("attachments"))))
    return m.select("session_id", content.alias("content_json"))


query("agg_22_rich_content", """with r AS (SELECT s.provider, m.session_id, m.turn_index % 3 AS k FROM messages m JOIN sessions s ON m.session_id = s.id)
SELECT provider, count(DISTINCT session_id) AS sessions, count(*) AS messages, count(*) FILTER (WHERE k < 2) AS rich, concat('file:', count(*) FILTER (WHERE k < 2), ',image:', count(*) FILTER (WHERE k = 0)) AS attachments, concat('code:', count(*) FILTER (WHERE k = 0)) AS blocks FROM r GROUP BY 1""", "sessions", "messages")(lambda s, m: O.rich_content(s, _with_content(m)))  # fmt: skip
query("agg_30_counts", "SELECT count(*) AS captures, count(DISTINCT pair_id) AS pairs, count(DISTINCT host) AS hosts, min(created_at) AS first, max(created_at) AS last FROM captures", "captures")(lambda c: c.agg(F.count("*").alias("captures"), F.count_distinct("pair_id").alias("pairs"), F.count_distinct("host").alias("hosts"), F.min("created_at").alias("first"), F.max("created_at").alias("last")))


def _snapshot(b: DataFrame) -> DataFrame:
    legs = b.groupBy("target", "layer").agg(F.count_if(F.col("status") == "fail").alias("bad"), F.count("*").alias("n"))
    health = F.when(F.col("bad") * 5 > F.col("n"), "red").when(F.col("bad") > 0, "yellow").otherwise("green")
    return legs.groupBy(F.col("target").alias("scenario_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("layer").alias("source"), health.alias("health")))).alias("legs"), F.count_if(F.col("bad") > 0).alias("bad")).select("scenario_id", "legs", F.when(F.col("bad") == 3, "down").when(F.col("bad") > 0, "impaired").otherwise("full").alias("status"), F.when(F.col("scenario_id") == "t1", "grey").otherwise("red").alias("color"), F.col("scenario_id").isin("t0").alias("phase_b"))


query("flt_16_alerts", """with l AS (SELECT target, layer, count(*) FILTER (WHERE status = 'fail') AS bad FROM beacons GROUP BY 1, 2), s AS (SELECT target, count(*) FILTER (WHERE bad > 0) AS bad, string_agg(layer, ',' ORDER BY layer) FILTER (WHERE bad > 0) AS failed FROM l GROUP BY 1)
SELECT target AS scenario_id, CASE WHEN bad = 3 THEN 'down' ELSE 'impaired' END AS status, failed FROM s WHERE bad > 0 AND target NOT IN ('t0', 't1')""", "beacons")(lambda b: O.alerts(_snapshot(b), "red", suppress_phase_b=True).select("scenario_id", "status", F.array_join(F.transform("failed_legs", lambda x: x["source"]), ",").alias("failed")))  # fmt: skip
query("flt_18_failures", "SELECT id, target, case_id, status FROM beacons WHERE status IN ('fail', 'skip')", "beacons")(lambda b: O.failures(b, True).select("id", "target", "case_id", "status"))
query("flt_10_snippets", "SELECT doc_id AS id FROM documents WHERE lang = 'en' AND doc_id % 9 = 0 AND list_contains(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), 'the') ORDER BY n_chars DESC, doc_id DESC LIMIT 50", "documents")(lambda d: O.snippets(d.select(F.col("doc_id").alias("id"), F.col("lang").alias("category"), F.col("source").alias("domain"), F.when(F.col("doc_id") % 9 == 0, 1).otherwise(0).alias("favorited"), F.col("n_chars").alias("created_at"), "text"), category="en", favorited_only=True, holds=F.array_contains(R.tokens(F.col("text")), "the")).select("id"))
query("flt_11_domains", "SELECT host AS domain, max(created_at) > 1706659200.0 - 86400 AS active FROM captures GROUP BY 1 HAVING max(created_at) > 1706659200.0 - 86400", "captures")(lambda c: O.domains(c.groupBy(F.col("host").alias("domain")).agg((F.max("created_at") > NOW - 86400).alias("active"))))
query("stm_16_connections", "SELECT session_hint AS pair_id, count(*) AS frames, count(*) FILTER (WHERE direction = 'request') AS sent, CAST(sum(octet_length(encode(body))) AS BIGINT) AS bytes, max(created_at) - min(created_at) AS seconds FROM captures GROUP BY 1", "captures")(lambda c: O.connections(c.select(F.col("session_hint").alias("pair_id"), F.col("created_at").alias("ts"), "direction", "body")))
query("stm_13_gap_sessions", "with l AS (SELECT session_hint, created_at, CASE WHEN created_at - lag(created_at) OVER w <= 86400 THEN 0 ELSE 1 END AS b FROM captures WINDOW w AS (PARTITION BY session_hint ORDER BY created_at)), n AS (SELECT *, sum(b) OVER (PARTITION BY session_hint ORDER BY created_at) AS nth FROM l) SELECT session_hint, min(created_at) AS start, max(created_at) AS \"end\", count(*) AS events FROM n GROUP BY session_hint, nth", "captures")(lambda c: O.gap_sessions(c, "session_hint", "created_at", 86400.0))
query("scl_09_result_scores", """with r AS (SELECT session_id, avg(CASE WHEN role = 'user' THEN 0.4 ELSE 0.8 END) AS mean, count(*) AS n, bool_or(role = 'user') AND bool_or(role = 'assistant') AS both_roles FROM messages GROUP BY 1)
SELECT s.id AS result_id, round(least(1.0, (coalesce(mean, 0) * 0.5 + CASE WHEN both_roles THEN 0.15 ELSE 0 END + CASE WHEN coalesce(session_key, '') <> '' THEN 0.1 ELSE 0 END + CASE WHEN s.id % 2 = 0 THEN 0.1 ELSE 0 END + CASE WHEN n >= 4 THEN 0.1 WHEN n >= 2 THEN 0.05 ELSE 0 END) * 0.7 + 0.9 * 0.3), 6)::DOUBLE AS score FROM sessions s LEFT JOIN r ON s.id = r.session_id""", "sessions", "messages")(lambda s, m: O.result_scores(s.select(F.col("id").alias("result_id"), "session_key", F.when(F.col("id") % 2 == 0, "m").alias("model_name"), F.lit(0.9).alias("confidence")), m.select(F.col("session_id").alias("result_id"), "role", F.when(F.col("role") == "user", 0.4).otherwise(0.8).alias("score"))))  # fmt: skip


def _drafts(m: DataFrame) -> DataFrame:
    draft = F.to_json(F.struct(F.struct(F.lit("doc").alias("type"), F.array(F.struct(F.lit("p").alias("type"), F.col("content_text").alias("text"), F.col("role").alias("note"))).alias("content")).alias("state"), F.lit("text").alias("kind"), F.concat(F.lit('"text":"'), F.col("content_text")).alias("text")))
    return m.where("content_text is not null").select("id", T.drafts_redacted(draft).alias("draft"))


query("scl_36_drafts", """SELECT id, concat('{"state":{"type":"doc","content":[{"type":"p","text":"[redacted]","note":"', role, '"}]},"kind":"text","text":"[redacted]"}') AS draft FROM messages WHERE content_text IS NOT NULL""", "messages")(_drafts)


def _page(m: DataFrame) -> DataFrame:
    """Conversations with a file in every third turn, and code without a kind in every fourth."""
    fields = ("type", "file_id", "url", "name", "title", "language", "code", "output")
    of = lambda **cells: F.array(F.struct(*[cells.get(f, F.lit(None).cast("string")).alias(f) for f in fields]))
    attached = F.when(F.col("turn_index") % 3 == 0, of(type=F.lit("file"), url=F.lit(""), name=F.concat(F.lit("f"), "turn_index"))).when(F.col("turn_index") % 4 == 1, of(code=F.col("content_text")))
    return m.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn_index", "role", F.col("content_text").alias("content"), attached.alias("attachments")))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"), x["attachments"].alias("attachments"))).alias("messages"))


query("scl_39_fingerprints", """SELECT session_id, string_agg(concat(role, ':', left(content_text, 160), ':', CASE WHEN turn_index % 3 = 0 THEN concat('file:f', turn_index) WHEN turn_index % 4 = 1 THEN concat('unknown:', left(content_text, 80)) ELSE '' END), '|' ORDER BY turn_index) AS fingerprint FROM messages GROUP BY 1""", "messages")(lambda m: _page(m).select("session_id", T.page_fingerprint(F.col("messages")).alias("fingerprint")))


def _versions(s: DataFrame, m: DataFrame) -> DataFrame:
    """Two steps that are applied, and one that fails on some row: the tables are those of the second."""
    store = Store(s.sparkSession, fresh_folder(s.sparkSession, "versions"))
    store.create({"sessions": s.select("id", "provider"), "messages": m.select("session_id", "role", "token_estimate")})
    counted = lambda t: t["messages"].groupBy("session_id").agg(F.count("*").alias("n"), F.sum("token_estimate").alias("tokens"))
    steps = [
        Step(1, "add a family", lambda t: {"sessions": t["sessions"].withColumn("family", F.concat(F.lit("api-"), "provider"))}),
        Step(2, "count messages", lambda t: {"sessions": t["sessions"].join(counted(t), t["sessions"]["id"] == F.col("session_id"), "left").drop("session_id"), "messages": None}),
    ]
    fails = Step(3, "fail", lambda t: {"sessions": t["sessions"].withColumn("n", F.when(F.col("n") >= 1, F.raise_error(F.lit("step 3 fails"))).otherwise(F.col("n")))})
    try:
        store.apply([*steps, fails])
    except Exception as e:
        if "step 3 fails" not in str(e):
            raise
    return store.tables()["sessions"].withColumn("version", F.lit(store.version()))


query("scl_47_versions", "SELECT s.id, provider, concat('api-', provider) AS family, n, tokens, 2 AS version FROM sessions s LEFT JOIN (SELECT session_id, count(*) AS n, CAST(sum(token_estimate) AS BIGINT) AS tokens FROM messages GROUP BY 1) m ON s.id = m.session_id", "sessions", "messages")(_versions)
