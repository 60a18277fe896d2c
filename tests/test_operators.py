"""Operators on literal rows, where the driver's tables don't reach a case."""

import json

import pytest
from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.operators import health, joins, normalise, search, sessions, state
from colloquy.sources import exchange
from colloquy.streaming import flows

MESSAGE = "id string, session_id int, role string, content_text string, ts double, turn_index int, branch_id string, branch_parent_id string"


def ids(df):
    return [r.id for r in df.orderBy("ts", "id").collect()]


def test_collapse(spark):
    rows = [("u1", 1, "user", "a", 1.0, 0, "0", None), ("a1", 1, "assistant", "b", 2.0, 1, "0", None), ("u2", 1, "user", "c", 3.0, 2, "0", None), ("a2", 1, "assistant", "d", 4.0, 3, "0", None), ("u2x", 1, "user", "e", 5.0, 0, "alt", "u2"), ("a2x", 1, "assistant", "f", 6.0, 1, "alt", None)]
    assert ids(sessions.collapse_branches(spark.createDataFrame(rows, MESSAGE))) == ["u1", "a1", "u2x", "a2x"]
    no_turns = [(*r[:5], None, *r[6:]) for r in rows]
    assert ids(sessions.collapse_branches(spark.createDataFrame(no_turns, MESSAGE))) == ["u1", "a1", "u2x", "a2x"]
    no_parent = [(*r[:7], None) for r in rows]
    assert ids(sessions.collapse_branches(spark.createDataFrame(no_parent, MESSAGE))) == ["u1", "a1", "u2", "a2", "u2x", "a2x"]
    assert sessions.collapse_branches(spark.createDataFrame([], MESSAGE)).count() == 0


def test_squash(spark):
    rows = [("1", 1, "user", "a", 1.0, 0, "0", None), ("2", 1, "assistant", "b", 2.0, 1, "0", None), ("3", 1, "assistant", "c", 3.0, 2, "0", None), ("4", 1, None, "c", 4.0, 3, "0", None)]
    assert ids(sessions.squash(spark.createDataFrame(rows, MESSAGE))) == ["1", "3", "4"]


def test_greedy(spark):
    c = spark.createDataFrame([(1, 0.0, "k"), (2, 30.0, "k"), (3, 31.0, "k"), (4, 0.0, None), (5, 5.0, None)], "id int, created_at double, key string")
    assert {r.id: r.is_primary for r in state.deduplicated(c, ["key"]).collect()} == {1: True, 2: False, 3: True, 4: True, 5: False}
    beats = [(i, "cli", "t", None, float(t)) for i, t in enumerate((0, 59, 60))] + [(10 + i, "cli", "t", "T01", 100 + i / 100) for i in range(11)]
    b = spark.createDataFrame(beats, "id int, lane string, target string, case_id string, ts double")
    got = {r.id: r.accepted for r in state.throttled(b).collect()}
    assert [got[i] for i in range(3)] == [True, False, True]
    assert sum(got[10 + i] for i in range(11)) == 10 and not got[20]


def test_pinning_rate_is_strict(spark):
    from colloquy.operators import analytics

    failures = spark.createDataFrame([(i, 10.0, "h", "x") for i in range(5)], "id int, created_at double, host string, error_category string")
    captures = spark.createDataFrame([("proxy-default", 10.0, "h", f"p{i}") for i in range(20)], "source_id string, created_at double, host string, pair_id string")
    row = analytics.pinning(failures, captures, 100, 20.0).first()
    assert (row.rate, row.suspect) == (0.2, False)
    assert analytics.pinning(failures, captures.where("pair_id <> 'p0'"), 100, 20.0).first().suspect


def test_percentile_rounds_half_to_even(spark):
    from colloquy.operators import analytics

    df = spark.createDataFrame([("k", float(x)) for x in (1, 2, 3, 4)] + [("n", None)], "k string, v double")
    assert analytics.exact_percentiles(df, "k", "v").collect() == [("k", 3.0, 4.0)]


@pytest.mark.parametrize("text,tokens", [(None, None), ("  ", None), ("a", 1), ("one two three four", 5), ("你好", 1)])
def test_tokens(spark, text, tokens):
    assert spark.createDataFrame([(text,)], "t string").select(T.estimate_tokens(F.col("t"))).first()[0] == tokens


def test_secrets(spark):
    said = "Bearer abcdefghijk sk-ant-" + "a" * 24 + " AKIA" + "A" * 16 + " ghp_" + "b" * 24 + " plain"
    assert spark.createDataFrame([(said,)], "t string").select(T.scrub(F.col("t"))).first()[0] == "Bearer [REDACTED] [REDACTED_ANTHROPIC_KEY] [REDACTED_AWS_KEY] [REDACTED_GITHUB_TOKEN] plain"
    headers = spark.createDataFrame([('{"Cookie":"x","Accept":"y"}',)], "t string").select(T.redact_headers(F.col("t"))).first()[0]
    assert json.loads(headers) == {"Cookie": "REDACTED", "Accept": "y"}


def test_languages_and_categories(spark):
    rows = spark.createDataFrame([(4, 0, 0, 2, "zh"), (1, 4, 0, 0, "ja"), (1, 0, 4, 0, "ko"), (4, 0, 0, 5, "mixed"), (1, 0, 0, 9, "en"), (0, 0, 0, 0, "en")], "a int, b int, c int, d int, want string")
    got = rows.select("want", T.dominant_language(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("got"))
    assert got.where("want <> got").count() == 0
    tls = spark.createDataFrame([("Unknown CA", "cert_unknown_ca"), ("certificate verify failed", "cert_verify_failed"), ("timed out", "handshake_timeout"), (None, "unknown"), ("TLS alert", "tls_other")], "e string, want string")
    assert tls.where(T.tls_category(F.col("e")) != F.col("want")).count() == 0
    v = spark.createDataFrame([("v1.10.0", "1.9.3"), ("2.0", "bad"), ("1.0.1", "1.0")], "a string, b string")
    assert v.where(T.version_key(F.col("a")) > T.version_key(F.col("b"))).count() == 3


def test_beacon_checks(spark):
    rows = [("cli", "L1", "t", "pass", "T01", 0.0, None, None), ("x", "L1", "t", "pass", None, 0.0, None, "invalid_lane"), ("cli", "L1", "T!", "pass", None, 0.0, None, "invalid_target"), ("cli", "L1", "t", "pass", "t1", 0.0, None, "invalid_case_id"), ("cli", "L1", "t", "pass", None, 301.0, None, "ts_skew"), ("cli", "L1", "t", "pass", None, 0.0, '{"a":{"Token":1}}', "pii_detected"), ("cli", "L1", "t", "pass", None, 0.0, '{"a":"' + "x" * 5000 + '"}', "meta_too_large"), (None, "L1", "t", "pass", None, 0.0, None, "invalid_lane")]
    df = spark.createDataFrame(rows, "lane string, layer string, target string, status string, case_id string, ts double, meta_json string, want string")
    assert health.validated(df, 0.0).where(~F.col("want").eqNullSafe(F.col("rejected_for"))).count() == 0


def test_fusion(spark):
    a = spark.createDataFrame([(1, 9.0), (2, 8.0)], "id int, score double")
    b = spark.createDataFrame([(1, 0.9), (3, 0.8)], "id int, score double")
    assert [tuple(r) for r in search.fused([a, b], "id").collect()][0] == (1, 0.032787)
    d = spark.createDataFrame([(1, "Café crème"), (2, None), (3, "")], "id int, t string")
    assert [r.id for r in search.lexical(d, "id", "t", '"cafe" (creme)').collect()] == [1]
    assert search.lexical(d, "id", "t", "()").count() == 0


def test_event_streams(spark):
    openai = 'data: {"choices":[{"delta":{"role":"assistant","content":"Hel"}}]}\n\ndata: bad\n\ndata: {"choices":[{"delta":{"content":"lo"}}]}\n\ndata: [DONE]'
    blocks = 'event: content_block_delta\ndata: {"type":"content_block_delta","index":0,"delta":{"type":"text_delta","text":"Hi"}}\ndata: {"type":"content_block_delta","index":1,"delta":{"type":"thinking_delta","thinking":"hm"}}'
    whole = 'data: {"choices":[{"message":{"content":"All"}}]}'
    df = spark.createDataFrame([(openai,), (blocks,), (whole,), ("data: x",), (None,)], "b string")
    assert [r[0] for r in df.select(normalise.stream_text(F.col("b"))).collect()] == ["Hello", "Hi", "All", None, None]
    patches = 'data: {"p":"","o":"add","v":{"message":{"content":{"parts":[""]}}}}\ndata: {"p":"/message/content/parts/0","o":"append","v":"He"}\ndata: {"v":"llo"}\ndata: {"o":"patch","v":[{"p":"/message/content/parts/0","o":"append","v":"!"},{"p":"/message/status","o":"replace","v":"done"}]}\ndata: [DONE]'
    assert spark.createDataFrame([(patches,)], "b string").select(normalise.patched_text(F.col("b"))).first()[0] == "Hello!"


def test_blocks(spark):
    request = '{"model":"m","system":"be kind","messages":[{"role":"human","content":[{"type":"text","text":"a"},{"type":"text","text":"b"}]}]}'
    response = '{"model":"m2","content":[{"type":"thinking","text":"no"},{"type":"text","text":"yes"}]}'
    df = spark.createDataFrame([("p", 1.0, request, response), ("q", 1.0, "junk", None)], "pair_id string, ts double, request string, response string")
    assert [tuple(r)[1:] for r in normalise.normalised(df).orderBy("pair_id", "turn_index").collect()] == [(0, 1.0, "system", "be kind", "m2"), (1, 1.0, "user", "a\nb", "m2"), (2, 1.0, "assistant", "yes", "m2")]


def test_rpc(spark):
    rows = [("u", 1.0, True, '{"id":1,"method":"a"}'), ("u", 1.5, False, '{"id":1,"result":{}}'), ("u", 2.0, False, '{"id":9,"error":{}}'), ("u", 3.0, True, '{"method":"n"}'), ("u", 4.0, False, '{"id":5,"method":"s"}'), ("u", 5.0, False, "x")]
    got = joins.rpc_pairs(spark.createDataFrame(rows, "upstream string, ts double, from_client boolean, body string")).orderBy("ts").collect()
    assert [r.kind for r in got] == ["request", "response", "orphan_response", "notification", "server_initiated", "unclassified"]
    assert (got[1].latency_ms, got[1].status_code, got[2].status_code) == (500.0, 200, 500)


def test_round_trip(spark, tmp_path):
    s = spark.createDataFrame([(1, "openai", 0.0), (2, None, 5.0)], "id int, provider string, started_at double")
    m = spark.createDataFrame([("a", 1, 1.0, "user", "x\ny", None, 3), ("b", 1, 2.0, "assistant", "é", "m", None)], "id string, session_id int, ts double, role string, content_text string, model_name string, token_estimate int")
    exchange.write_envelopes(s, m, str(tmp_path / "out"))
    (tmp_path / "out" / "bad.txt").write_text("{broken\n\n")
    rows, bad = exchange.read_lines(spark, str(tmp_path / "out"))
    assert bad.count() == 1 and rows.count() == 2
    back = exchange.imported(rows).withColumn("session_id", F.col("session_id").cast("int"))
    assert sorted(tuple(r) for r in back.select(*m.columns).collect()) == sorted(tuple(r) for r in m.collect())
    assert sessions.positional_new(m, back.select(*m.columns)).count() == 0
    assert exchange.export_parquet(m, str(tmp_path / "pq"), "ts", 2.0) == 1
    c = spark.createDataFrame([(1, 1.0), (2, 9.0), (3, None)], "id int, created_at double")
    assert sorted(r.id for r in exchange.archive(c, 5.0, str(tmp_path / "arc")).collect()) == [2, 3]


def test_streams(spark, tmp_path):
    rows = [(1, "k", "2024-01-01 00:00:00"), (2, "k", "2024-01-01 00:00:59"), (3, "k", "2024-01-01 00:01:00"), (4, "j", "2024-01-01 00:00:01")]
    df = spark.createDataFrame(rows, "id int, key string, at string").withColumn("at", F.to_timestamp("at"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, flow, want in (("throttle", flows.throttled(stream, ["key"], "at", 60.0), [1, 3, 4]), ("dedup", flows.repeats_dropped(stream, ["key"], "at"), [1, 4])):
        q = flow.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        assert sorted(r.id for r in spark.table(name).collect()) == want
    left = stream.select(F.col("key").alias("pair_id"), F.col("at").alias("requested_at"), F.col("id").alias("request"))
    right = stream.where("id = 2").select(F.col("key").alias("pair_id"), F.col("at").alias("responded_at"), F.col("id").alias("response"))
    q = flows.paired(left, right, "60 seconds").writeStream.format("memory").queryName("pairs").option("checkpointLocation", str(tmp_path / "pairs")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert (1, 2) in [(r.request, r.response) for r in spark.table("pairs").collect()]


def test_short_hash(spark):
    from colloquy.functions import convert

    def by_units(text):
        h = 0
        for unit in memoryview(text.encode("utf-16-le")).cast("H") if text else []:
            h = ((h << 5) - h + unit + 2**31) % 2**32 - 2**31
        digits, n = "", abs(h)
        while n:
            digits, n = "0123456789abcdefghijklmnopqrstuvwxyz"[n % 36] + digits, n // 36
        return ("-" if h < 0 else "") + (digits or "0")

    texts = ["", "a", "hello world", "negative? " * 7, "😀 and 🜚", "é東京", "x" * 500]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(convert.short_hash(F.col("t")).alias("h")).collect()
    assert [r.h for r in got] == [by_units(t) for t in texts] and any(r.h.startswith("-") for r in got)


def test_live_forks(spark):
    from colloquy.operators import persist

    columns = "session_id long, id string, parent_id string, role string, text string, ts double"
    stored = spark.createDataFrame([(1, "a", None, "user", "q", 1.0), (1, "b", "a", "assistant", "one", 2.0), (1, "c", "a", "assistant", "two", 3.0), (1, "d", "b", "user", None, 4.0), (2, "e", "a", "assistant", "other", 1.0)], columns)
    new = [
        (1, "r1", "a", "assistant", "one", 9.0, "replay beside a sibling"), (1, "r2", "a", "assistant", "three", 9.0, "regenerated"), (1, "r3", "a", "user", "three", 9.0, "other role"),
        (1, "r4", "b", "user", "", 9.0, "empty is null"), (1, "r5", "z", "assistant", "x", 9.0, "unknown parent"), (1, "r6", None, "assistant", "x", 9.0, "no parent"),
        (2, "r7", "a", "assistant", "other", 9.0, "replay"), (1, "r8", "a", "assistant", "two", 9.0, "two of one"), (1, "r9", "b", "user", "new", 9.5, "two of one"),
    ]
    got = {r.completion: (r.session_id, r.fork_of) for r in persist.live_forks(stored, spark.createDataFrame(new, columns + ", completion string")).collect()}
    assert got == {"replay beside a sibling": (1, "c"), "regenerated": (1, "b"), "two of one": (1, "b")}
    assert persist.live_forks(stored.limit(0), spark.createDataFrame(new, columns + ", completion string")).count() == 0
