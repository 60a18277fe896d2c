"""Traffic, clipboard, failure, alias and fallback rules on literal rows."""

import json

from pyspark.sql import functions as F

from colloquy.functions import traffic
from colloquy.operators import fallback


def test_requests(spark):
    rows = [
        (1, "api.openai.com", "/v1/messages", "post", '{"model":"m","messages":[]}'), (2, "x.example", "/", "POST", '{"messages":[1, 2]}'), (3, "x.example", "/", "GET", '{"model":"m","messages":[]}'),
        (4, "x.example", "/", "PUT", '{"top_p":1,"stop":2,"seed":3}'), (5, "llm.example", None, None, None), (6, None, "/A/Generate", "POST", "not json at all"), (7, "x.example", "/", "POST", '["model","messages"]'),
    ]
    df = spark.createDataFrame(rows, "id int, host string, path string, method string, body string")
    got = {r.id: (r.a.confidence, r.a.reasons) for r in df.select("id", traffic.ai_request(F.col("host"), F.col("path"), F.col("method"), F.col("body")).alias("a")).collect()}
    assert got == {
        1: ("high", [r"domain_pattern:.*\.openai\.com$", "path:/v1/messages", "request_fields:messages+model"]), 2: ("medium", ["request_fields:messages"]), 3: (None, []),
        4: ("medium", ["request_ai_fields:3"]), 5: ("medium", [r"domain_pattern:.*llm.*\..*$"]), 6: ("medium", ["path:/generate"]), 7: (None, []),
    }


def test_responses(spark):
    rows = [(1, '{"choices":[]}', None), (2, '{"output":"x"}', "application/json"), (3, 'data: {"delta":1}', "text/event-stream; charset=utf-8"), (4, 'data: {"choices":[{"message":1}]}', None), (5, None, None), (6, "{}", None), (7, '{"role":"a","content":[]}', "")]
    df = spark.createDataFrame(rows, "id int, body string, kind string")
    got = {r.id: r.e and tuple(r.e) for r in df.select("id", traffic.response_evidence(F.col("body"), F.col("kind")).alias("e")).collect()}
    assert got == {1: ("high", "response_fields:choices"), 2: ("medium", "response_fields:output"), 3: ("high", "sse_stream_with_ai_fields"), 4: ("high", "raw_text_choices_message"), 5: None, 6: None, 7: ("high", "response_fields:content+role")}


def test_clipboard(spark):
    said = "User: how do I do this?\nAssistant：Let me explain. Here is a summary:\n```py\nx\n```\n" + "x" * 100
    df = spark.createDataFrame([(1, said), (2, "User: a\nAI: b"), (3, "plain " * 30), (4, None), (5, "before\nQ:\nA: it is\n\nyou : and ")], "id int, t string")
    got = {r.id: (r.s, r.m and [tuple(m) for m in r.m]) for r in df.select("id", traffic.conversation_score(F.col("t")).alias("s"), traffic.conversation_messages(F.col("t")).alias("m")).collect()}
    assert got[1][0] == 1.0 and [m[0] for m in got[1][1]] == ["user", "assistant"] and got[1][1][0][1] == "how do I do this?"
    assert got[2] == (0.0, [("user", "a"), ("assistant", "b")])
    assert got[3] == (0.0, [("unknown", ("plain " * 30).strip())])
    assert got[4][0] == 0.0
    assert got[5][1] == [("assistant", "it is"), ("user", "and")]


def test_failures(spark):
    rows = [(1, 0, "timeout", None, None, None), (2, 1, "timed out waiting for selector", "", None, None), (3, 1, "", "KeyError: 'x'", 1.0, 5.0), (4, 1, "KeyError: 'x'", "", 5.0, 5.0), (5, 1, None, None, None, None), (6, 1, "it timed out", "connection refused", None, None)]
    df = spark.createDataFrame(rows, "id int, code int, err string, out string, spent double, most double")
    got = {r.id: tuple(r.c) for r in df.select("id", traffic.failure_class(*map(F.col, ("code", "err", "out", "spent", "most"))).alias("c")).collect()}
    assert got == {1: ("UNKNOWN", "info"), 2: ("UI_SELECTOR_MISS", "hard"), 3: ("SCHEMA_DRIFT", "hard"), 4: ("RACE_TIMEOUT", "soft"), 5: ("UNKNOWN", "info"), 6: ("RACE_TIMEOUT", "soft")}


def test_aliases(spark):
    attributes = {"openinference.span.kind": "llm", "llm.provider": "p", "llm.model_name": "m", "llm.token_count.prompt": "3", "session.id": "", "input.value": "q", "llm.input_messages.10.message.role": "user", "llm.output_messages.0.message.content": "a", "llm.input_messages.x.message.role": "no"}
    df = spark.createDataFrame([(1, attributes), (2, None), (3, {})], "id int, a map<string,string>")
    got = {r.id: r.g for r in df.select("id", traffic.genai_aliases(F.col("a")).alias("g")).collect()}
    assert got[2] == got[3] == {}
    assert got[1] == {
        "gen_ai.operation.name": "chat", "gen_ai.system": "p", "gen_ai.request.model": "m", "gen_ai.response.model": "m", "gen_ai.usage.input_tokens": "3", "llm.usage.prompt_tokens": "3",
        "gen_ai.usage.total_tokens": "3", "llm.usage.total_tokens": "3", "gen_ai.prompt": "q", "gen_ai.prompt.10.role": "user", "gen_ai.completion.0.content": "a",
    }


def test_fallback(spark):
    chat = {"model": "m", "messages": [{"role": "user", "content": "hi"}, {"content": [{"type": "text", "text": "more"}]}, {"role": "user", "content": " "}], "session_id": "s"}
    rows = [
        (1, "x", json.dumps(chat), json.dumps({"choices": [{"delta": {"content": "yes"}}, {"message": {"role": "assistant", "content": "or no"}}]})),
        (2, "x", json.dumps({"aiSessionId": "n", "prompt": "p", "context": "c"}), "streamed text"),
        (3, "x", json.dumps({"contents": [{"parts": [{"text": "a"}, {"text": "b"}]}]}), json.dumps({"candidates": [{"content": {"parts": [{"text": "c"}]}}], "modelVersion": "g"})),
        (4, "x", json.dumps({"prompt": "long enough"}), json.dumps({"generated_text": "done"})), (5, "x", json.dumps({"prompt": "long enough"}), None), (6, None, None, None), (7, "x", "[1", "{}"), (8, "x", json.dumps(chat), None),
        (9, "www.notion.so", json.dumps({"prompt": "p"}), "{}"),
    ]
    got = {r.pair_id: r for r in fallback.recovered(spark.createDataFrame(rows, "pair_id int, host string, request string, response string")).collect()}
    said = {k: [tuple(m) for m in r.messages] for k, r in got.items()}
    assert {k: (r["shape"], r.confidence) for k, r in got.items()} == {1: ("chat", 0.7), 2: ("embedded", 0.6), 3: ("parts", 0.7), 4: ("bare", 0.35), 8: ("chat", 0.35), 9: ("embedded", 0.4)}
    assert said[1] == [("user", "hi"), ("user", "more"), ("assistant", "yes"), ("assistant", "or no")] and (got[1].session_key, got[1].title, got[1].model_name) == ("s", "hi", "m")
    assert said[2] == [("user", "[Context: c]\n\np"), ("assistant", "streamed text")]
    assert said[3] == [("user", "a\nb"), ("assistant", "c")] and got[3].model_name == "g"
    assert said[4] == [("user", "long enough"), ("assistant", "done")]
