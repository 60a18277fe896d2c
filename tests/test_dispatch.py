"""Each parser on literal bodies, the choice between them, unwrapping, and odd rows."""

import json

import pytest

from colloquy.operators import dispatch, recovery

J = json.dumps
COLUMNS = "pair_id string, direction string, provider string, host string, path string, request string, response string, model_name string, created_at double"
CHAT = J({"model": "g", "messages": [{"role": "user", "content": "hi"}]})
REPLY = J({"model": "g-2", "choices": [{"message": {"role": "assistant", "content": "yo"}}], "usage": {"total_tokens": 5, "completion_tokens": 2}})
EVENTS = 'data: {"choices": [{"delta": {"content": "y"}}]}\n\ndata: {"choices": [{"delta": {"content": "o"}}]}\n\ndata: [DONE]\n'
BLOCKS = J({"model": "claude-x", "system": "be brief", "messages": [{"role": "user", "content": [{"type": "text", "text": "hi"}]}]})
BLOCK_REPLY = J({"content": [{"type": "text", "text": "yo"}], "usage": {"input_tokens": 3, "output_tokens": 4}})
EDITOR = J({"sessionId": "e", "customTitle": "Chat", "inputState": {"selectedModel": {"identifier": "m"}}, "requests": [{"message": {"text": "q"}, "completionTokens": 9, "response": [{"kind": "thinking", "value": {"a": 1}}, {"kind": "markdown", "value": "one"}, {"kind": "codeblock", "language": "py", "code": "x"}, {"value": "two"}]}, {"message": {"text": ""}, "response": []}, {"message": {"text": "q2"}}]})
COMPOSER = J({"composer_id": "c", "name": "N", "model_config": {"modelName": "default", "selectedModels": [{"modelId": "sm"}]}, "bubbles": [{"text": "a", "bubble_type": 1}, {"text": "", "bubble_type": 2}, {"text": "b"}, {"text": "c"}, {"text": "d", "bubble_type": 2}]})
TYPED = J({"session_id": "t", "model": "m0", "messages": [{"type": "user", "content": [{"text": "p1"}, {"text": "p2"}]}, {"type": "gemini", "content": "r", "model": "m1", "thoughts": [{"subject": "s", "description": "d"}], "tokens": {"output": 7}}, {"type": "info", "content": "x"}, {"type": "user", "content": "again"}]})
PAGE = J({"conversation_id": "pg", "messages": [{"role": "user", "content": "with file", "attachments": [{"type": "file"}]}, {"role": "user", "content": "the question about it"}, {"role": "assistant", "content": " "}, {"content": "and more of the same"}, {"role": "user", "content": "last"}]})
WRAPPED = J({"request_body": CHAT, "response_body": EVENTS, "url": "https://chatgpt.com/backend-api/conversation?x=1"})

ROWS = {
    "editor": (None, None, "local-copilot-chat", "/", EDITOR, None), "composer": (None, None, "local-cursor-chat", "/", COMPOSER, None), "typed": (None, None, "local-gemini-cli", "/", None, TYPED),
    "chat": (None, "openai", "api.openai.com", "/v1/chat/completions", CHAT, REPLY), "stream": (None, None, "127.0.0.1:1234", "/x", CHAT, EVENTS), "blocks": (None, "anthropic", "api.anthropic.com", "/v1/messages", BLOCKS, BLOCK_REPLY),
    "web": (None, None, "claude.ai", "/api/organizations/o/chat_conversations/01234567-89ab-cdef-0123-456789abcdef/completion", J({"prompt": "hi", "parent_message_uuid": "u"}), BLOCK_REPLY), "page": (None, "deepseek", "chat.deepseek.com", "/", PAGE, PAGE),
    "call": (None, "mcp:fs", "stdio", "resources/read", J({"id": 3, "params": {"uri": "file:///a", "arguments": {"k": 1}}}), J({"result": {"isError": True, "content": [{"type": "text", "text": "no"}, {"type": "image"}]}})),
    "failed_call": (None, "mcp:fs", "stdio", "tools/call", J({"id": 4, "params": {"name": "ls", "arguments": {"k": 1}}}), J({"error": {"code": -32601, "message": "what"}})), "no_call": (None, "mcp:fs", "stdio", "tools/list", J({"id": 4}), J({"result": {}})),
    "line": (None, None, "local-agent-mode", "/app/agent-transcript/ses/1", J({"type": "assistant", "entrypoint": "cli", "message": {"model": "cx", "content": [{"type": "text", "text": "done"}]}}), None),
    "meta_line": (None, None, "local-agent-mode", "/app/agent-transcript/unknown/2", J({"type": "title", "sessionId": "own"}), None),
    "wrapped": ("network_intercept", "unknown", "proxy.example", "/p", WRAPPED, None), "wrapped_new": ("network_intercept", None, "new.example", "/p", J({"request_body": J({"contents": [{"role": "user", "parts": [{"text": "ask"}]}]}), "response_body": J({"candidates": [{"content": {"parts": [{"text": "answer"}]}}]})}), None),
    "broken": (None, "openai", "api.openai.com", "/v1/chat/completions", "{", "{"), "empty": (None, None, None, None, "", None), "null": (None, None, None, None, None, None), "broken_wrap": ("network_intercept", None, None, None, "[1]", None),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(name, *r, None, 1704067200.0) for name, r in ROWS.items()]
    return {r.pair_id: r for r in dispatch.dispatched(spark.createDataFrame([*rows, rows[3]], COLUMNS)).collect()}


def spoken(r):
    return [(m.role, m.content) for m in r.messages]


def test_tools(found):
    e, c, t = found["editor"], found["composer"], found["typed"]
    assert (e.parser, e.session_key, e.title, e.model_name, e.confidence) == ("editor_chat", "e", "Chat", "m", 0.95)
    assert spoken(e) == [("user", "q"), ("assistant", "one\n```py\nx\n```\ntwo"), ("user", "q2")] and e.messages[1].tokens == 9
    assert spoken(c) == [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")] and (c.model_name, c.title) == ("sm", "N")
    assert spoken(t) == [("user", "p1\np2"), ("assistant", "r"), ("assistant", "[s] d"), ("user", "again")] and [m.model_name for m in t.messages] == ["m0", "m1", "m1", "m1"]
    assert (t.messages[1].tokens, t.title, t.model_name) == (7, "p1\np2", "m1")


def test_services(found):
    assert [(found[n].parser, found[n].confidence) for n in ("chat", "stream", "blocks")] == [("chat_completions", 1.0), ("chat_completions", 0.6), ("content_blocks", 1.0)]
    assert spoken(found["chat"]) == spoken(found["stream"]) == spoken(found["wrapped"]) == [("user", "hi"), ("assistant", "yo")]
    assert (found["chat"].model_name, found["chat"].messages[1].tokens, found["chat"].title) == ("g-2", 2, "hi")
    assert spoken(found["blocks"]) == [("system", "be brief"), ("user", "hi"), ("assistant", "yo")] and found["blocks"].messages[2].tokens == 4
    assert spoken(found["web"]) == [("user", "hi"), ("assistant", "yo")] and found["web"].session_key == "01234567-89ab-cdef-0123-456789abcdef"
    assert spoken(found["page"]) == [("user", "last")]
    assert (found["page"].parser, found["page"].session_key, found["page"].tool_family) == ("page_conversation", "pg", "deepseek-web")


def test_calls_and_lines(found):
    assert spoken(found["call"]) == [("assistant", "[resources/read] fs.file:///a {} #mcp_fs_resource_3"), ("tool", "[tool error] no")] and found["call"].session_key == "mcp-proxy:fs:2024-01-01"
    assert spoken(found["failed_call"])[1] == ("tool", "[JSON-RPC error -32601] what") and spoken(found["failed_call"])[0][1].endswith('ls {"k":1} #mcp_fs_tool_4')
    assert (found["line"].session_key, found["line"].tool_family, spoken(found["line"])) == ("ses", "claude-code-cli", [("assistant", "done")])
    assert (found["meta_line"].session_key, found["meta_line"].messages) == ("own", [])


def test_unwrapping_fallbacks_and_odd_rows(found):
    assert found["wrapped"].parser == "chat_completions"
    assert found["wrapped_new"].parser == "fallback_parts" and spoken(found["wrapped_new"]) == [("user", "ask"), ("assistant", "answer")]
    assert not {"broken", "empty", "null", "broken_wrap", "no_call"} & found.keys() and len(found) == len(ROWS) - 5


def test_order_of_parsers(spark):
    rows = spark.createDataFrame([("chat", *ROWS["chat"], None, 1.0), ("page", *ROWS["page"], None, 1.0)], COLUMNS)
    page, chat = dispatch.PARSERS[-1], dispatch.PARSERS[4]
    both = {r.pair_id: r.parser for r in dispatch.dispatched(rows, [page, chat]).collect()}
    assert both == {"chat": "chat_completions", "page": "page_conversation"}
    assert dispatch.dispatched(rows.limit(0)).count() == 0


def test_recovered_prompts(spark):
    """Only aged requests without response and message, the first of a pair, without what the assistant said."""
    chat = J({"model": "g", "messages": [{"role": "system", "content": "s"}, {"role": "assistant", "content": "before"}, {"role": "user", "content": "ask"}]})
    row = lambda i, pair, direction="request", at=1.0, body=chat, source="x": (i, at, source, direction, pair, "openai", "api.openai.com", "/v1/chat/completions", None, body)
    rows = [
        row(1, "lost"), row(2, "lost", at=3.0, body=CHAT), row(3, "new", at=90.0), row(4, "answered"), row(5, "answered", "response", body=REPLY), row(6, "known"), row(7, "broken", body="{"), row(8, "nobody", source=""),
        row(9, None), row(10, ""), row(11, "bodiless", body=None), row(12, "said", body=J({"model": "g", "messages": [{"role": "assistant", "content": "only"}]})), row(13, "alone", "response"), row(14, "timeless", at=None),
    ]
    captures = spark.createDataFrame(rows, "id int, created_at double, source_id string, direction string, pair_id string, provider string, host string, path string, model_name string, body string")
    known = spark.createDataFrame([("known",), (None,)], "capture_pair_id string")
    got = recovery.recovered_prompts(captures, known, now=100.0)
    assert sorted((r.pair_id, r.turn_index, r.role, r.content_text, r.interaction_kind, r.created_at) for r in got.collect()) == [("lost", 0, "system", "s", "cancelled", 1.0), ("lost", 1, "user", "ask", "cancelled", 1.0)]
    again = known.unionByName(got.select(got["pair_id"].alias("capture_pair_id")))
    assert recovery.recovered_prompts(captures, again, now=100.0).count() == 0 and recovery.recovered_prompts(captures.limit(0), known, now=100.0).count() == 0
