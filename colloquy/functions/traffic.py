"""Recognising model traffic and conversations, and naming failures: built-in expressions only.

Defined cases: null and malformed inputs are no evidence; of several rules that fit, the first one in order counts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts, path parts and sets of JSON keys that speak for model traffic.
AI_HOSTS = [
    r".*\.openai\.com$", r".*\.anthropic\.com$", r".*\.googleapis\.com$", r".*\.deepseek\.com$", r".*\.mistral\.ai$", r".*\.cohere\.com$",
    r".*api.*\.ai$", r".*api.*\.ml$", r".*chat\..*\.ai$", r".*llm.*\..*$", r".*\.ai\..*\.com$", r".*inference.*\..*$", r".*completion.*\..*$",
]
AI_PATHS = ["/v1/chat/completions", "/v1/completions", "/v1/embeddings", "/v1/messages", "/chat/completions", "/completions", "/v1/engines/", "/inference", "/generate", "/predict", "/api/generate", "/api/chat"]
REQUEST_HIGH = [("model", "messages"), ("model", "prompt"), ("model", "input"), ("prompt", "max_tokens")]
REQUEST_MEDIUM = [("messages",), ("prompt", "temperature"), ("model", "content"), ("inputs",)]
REQUEST_FIELDS = ["model", "messages", "prompt", "max_tokens", "temperature", "top_p", "stream", "stop", "system", "tools", "tool_choice", "response_format", "n", "presence_penalty", "frequency_penalty", "logprobs", "top_logprobs", "seed"]
RESPONSE_HIGH = [("choices",), ("content", "role"), ("completion",), ("generations",)]
RESPONSE_MEDIUM = [("generated_text",), ("output",), ("result", "model")]

# Role markers at the start of a line, and turns of phrase of model answers.
USER_MARKS = "User|Human|You|Me|Q"
MODEL_MARKS = "Assistant|AI|Bot|ChatGPT|Claude|Gemini|Copilot|GPT-4|GPT|A"
ANSWER_STYLE = [r"```\w*\n", r"(?md)^\d+\.\s+\*\*", r"(?md)^[-*]\s+\*\*", r"(?i)I('d| would) be happy to help", r"(?i)Here('s| is) (a|an|the) (step|example|summary|breakdown)", r"(?i)Let me (explain|help|break)"]

# Failure kinds with their severity, in the order in which they are tried.
FAILURES = [
    ("INFRA", "hard", r"(?i)connection\s+refused|address\s+already\s+in\s+use|port\s+\d+\s+is\s+(in\s+use|already\s+bound)|no\s+such\s+(file|directory).*\.db"),
    ("LOGIN_WALL", "hard", r"(?i)login\s+(wall|required|page)|sign\s+in\s+to\s+continue|401\s+unauthorized|please\s+authenticate"),
    ("UI_SELECTOR_MISS", "hard", r"(?i)NoSuchElement|element\s+not\s+(found|located|interactable)|selector.*(no\s+match|empty)|unable\s+to\s+locate\s+element|timed\s+out\s+waiting\s+for\s+selector"),
    ("URL_PATTERN_DRIFT", "hard", r"(?i)endpoint\s+\S+\s+returned\s+404|path\s+changed|url\s+pattern\s+drift|unrecognised\s+path|unmatched\s+route"),
    ("CONTENT_BLOCK_UNKNOWN", "soft", r"(?i)unknown\s+(content[_\s]?block|block\s+type)|unrecognised\s+content_block\.type"),
    ("SCHEMA_DRIFT", "hard", r"(?i)KeyError:\s*['\"][^'\"]+['\"]|validation\s+error.*field\s+required|required\s+field\s+missing|missing\s+key\s+['\"]?[^'\"\s]+"),
    ("NETWORK_NOISE_MISS", "soft", r"(?i)noise[_\s-]?(filter|path)|capture\s+filtered\s+as\s+noise"),
    ("RACE_TIMEOUT", "soft", r"(?i)timeout|timed\s+out|never\s+observed|did\s+not\s+arrive\s+within"),
]

_EVIDENCE = "struct<confidence:string,reason:string>"


def _evidence(confidence: str, reason: str | Column) -> Column:
    return F.struct(F.lit(confidence).alias("confidence"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))


def _first(cases: list[tuple[Column, Column]]) -> Column:
    """The value of the first condition that holds, else null."""
    return F.coalesce(*[F.when(condition, value) for condition, value in cases], F.lit(None).cast(_EVIDENCE))


def _by_keys(keys: Column, rules: list[tuple[str, ...]], confidence: str, prefix: str) -> list[tuple[Column, Column]]:
    fits = lambda rule: F.size(F.array_intersect(keys, F.array(*map(F.lit, rule)))) == len(rule)
    return [(fits(rule), _evidence(confidence, f"{prefix}:{'+'.join(sorted(rule))}")) for rule in rules]


def request_evidence(body: Column) -> Column:
    """struct<confidence, reason> of a request body by the keys of its JSON object, or null."""
    keys = F.json_object_keys(body)
    known = F.size(F.array_intersect(keys, F.array(*map(F.lit, REQUEST_FIELDS))))
    rules = _by_keys(keys, REQUEST_HIGH, "high", "request_fields") + _by_keys(keys, REQUEST_MEDIUM, "medium", "request_fields")
    return F.when(F.octet_length(body) >= 10, _first([*rules, (known >= 3, _evidence("medium", F.concat(F.lit("request_ai_fields:"), known.cast("string"))))]))


def response_evidence(body: Column, content_type: Column) -> Column:
    """The same of a response body; event streams and what isn't JSON are judged by their first 2,000 characters."""
    head = F.substring(body, 1, 2000)
    has = lambda *names: [F.contains(head, F.lit(f'"{n}"')) for n in names]
    choices, delta, block, data, model, text, message = has("choices", "delta", "content_block", "data", "model", "text", "message")
    keys = F.json_object_keys(body)
    stream = F.coalesce(F.contains(content_type, F.lit("text/event-stream")), F.lit(False))
    long_enough = F.octet_length(body) >= 5
    is_json = F.try_parse_json(body).isNotNull()
    by_stream = [(stream & (choices | delta | block), _evidence("high", "sse_stream_with_ai_fields")), (stream & data & (model | text), _evidence("medium", "sse_stream_with_model"))]
    by_text = [(long_enough & ~is_json & choices & message, _evidence("high", "raw_text_choices_message")), (long_enough & ~is_json & block, _evidence("high", "raw_text_content_block"))]
    rules = _by_keys(keys, RESPONSE_HIGH, "high", "response_fields") + _by_keys(keys, RESPONSE_MEDIUM, "medium", "response_fields")
    return _first([*by_stream, *by_text, *[(long_enough & fits, said) for fits, said in rules]])


def ai_request(host: Column, path: Column, method: Column, body: Column) -> Column:
    """struct<confidence, reasons>: the highest confidence of host, path and (for POST and PUT) body, and a reason of each."""
    by_host = _first([(host.rlike(f"^(?:{p})"), _evidence("medium", f"domain_pattern:{p}")) for p in AI_HOSTS])
    by_path = _first([(F.contains(F.lower(path), F.lit(p)), _evidence("medium", f"path:{p}")) for p in AI_PATHS])
    by_body = F.when(F.upper(method).isin("POST", "PUT"), request_evidence(body))
    found = F.filter(F.array(by_host, by_path, by_body), lambda e: e.isNotNull())
    high = F.exists(found, lambda e: e["confidence"] == "high")
    return F.struct(F.when(high, "high").when(F.size(found) > 0, "medium").alias("confidence"), F.transform(found, lambda e: e["reason"]).alias("reasons"))


def conversation_score(c: Column) -> Column:
    """How much a text looks like a copied conversation, 0 to 1; texts under 100 characters score 0. From 0.5 on it is one."""
    marks = lambda names: F.regexp_count(c, F.lit(rf"(?imd)^(?:{names})\s*[:：]"))
    user, model = marks(USER_MARKS), marks(MODEL_MARKS)
    style = sum((F.when(c.rlike(p), 1).otherwise(0) for p in ANSWER_STYLE), F.lit(0))
    fences = F.regexp_count(c, F.lit("```"))
    points = [(user + model >= 2, 40), ((user > 0) & (model > 0), 30), (style >= 1, 10), (style >= 2, 10), (fences >= 2, 10), (F.length(c) > 500, 5), (F.length(c) > 2000, 5)]
    score = sum((F.when(condition, n).otherwise(0) for condition, n in points), F.lit(0))
    return F.when(F.length(c) >= 100, F.least(score, F.lit(100)) / 100).otherwise(0.0)


def conversation_messages(c: Column) -> Column:
    """array<struct<role, content>> of a text with role markers; a text without any is one message of role unknown."""
    mark = rf"(?imd)^({USER_MARKS}|{MODEL_MARKS})\s*[:：]\s*"
    parts = F.filter(F.split(c, rf"(?imd)(?=^(?:{USER_MARKS}|{MODEL_MARKS})\s*[:：])"), lambda p: p.rlike(rf"(?id)\A(?:{USER_MARKS}|{MODEL_MARKS})\s*[:：]"))
    role = lambda p: F.when(p.rlike(rf"(?id)\A(?:{USER_MARKS})\s*[:：]"), "user").otherwise("assistant")
    said = lambda p: F.regexp_replace(F.regexp_replace(p, mark.replace("(?imd)^", r"(?id)\A"), ""), r"\A\s+|\s+\z", "")
    turns = F.filter(F.transform(parts, lambda p: F.struct(role(p).alias("role"), said(p).alias("content"))), lambda m: m["content"] != "")
    whole = F.array(F.struct(F.lit("unknown").alias("role"), F.regexp_replace(c, r"\A\s+|\s+\z", "").alias("content")))
    return F.when(F.size(parts) > 0, turns).otherwise(whole)


def failure_class(exit_code: Column, stderr: Column, stdout: Column, elapsed: Column, timeout: Column) -> Column:
    """struct<kind, severity> of a run: none failed, then time spent, then what stderr says, then stdout."""
    struct = lambda kind, severity: F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"))
    said = lambda c: [F.when(c.rlike(pattern), struct(kind, severity)) for kind, severity, pattern in FAILURES]
    return F.coalesce(F.when(exit_code == 0, struct("UNKNOWN", "info")), F.when(elapsed >= timeout, struct("RACE_TIMEOUT", "soft")), *said(stderr), *said(stdout), struct("UNKNOWN", "info"))


def genai_aliases(attributes: Column) -> Column:
    """map<string, string> of the gen_ai names of span attributes (map<string, string>); only what is there gets one."""
    a = F.coalesce(attributes, F.create_map().cast("map<string,string>"))
    given = lambda k: F.try_element_at(a, F.lit(k))
    some = lambda k: F.nullif(given(k), F.lit(""))
    number = lambda k: given(k).try_cast("bigint")
    kind = F.upper(given("openinference.span.kind"))
    prompt, completion = number("llm.token_count.prompt"), number("llm.token_count.completion")
    both = F.when(prompt.isNotNull() | completion.isNotNull(), F.coalesce(prompt, F.lit(0)) + F.coalesce(completion, F.lit(0)))
    total = F.coalesce(number("llm.token_count.total"), both)
    named = {
        "gen_ai.operation.name": F.when(kind.isin("LLM", "CHAT"), "chat").when(kind == "AGENT", "invoke_agent").when(kind == "TOOL", "execute_tool"),
        "gen_ai.system": F.coalesce(some("llm.system"), some("llm.provider")),
        "gen_ai.request.model": some("llm.model_name"), "gen_ai.response.model": some("llm.model_name"),
        "gen_ai.usage.input_tokens": prompt, "llm.usage.prompt_tokens": prompt, "gen_ai.usage.output_tokens": completion, "llm.usage.completion_tokens": completion,
        "gen_ai.usage.total_tokens": total, "llm.usage.total_tokens": total,
        "gen_ai.conversation.id": some("session.id"), "gen_ai.user.id": some("user.id"), "gen_ai.prompt": given("input.value"), "gen_ai.completion": given("output.value"),
    }
    flat = F.map_filter(F.create_map(*[x for k, v in named.items() for x in (F.lit(k), v.cast("string"))]), lambda k, v: v.isNotNull())
    indexed = r"^llm\.(?:input|output)_messages\.(\d+)\.message\.(role|content|name|tool_call_id)$"
    side = lambda k: F.when(k.startswith("llm.input"), "gen_ai.prompt.").otherwise("gen_ai.completion.")
    lists = F.transform_keys(F.map_filter(a, lambda k, v: k.rlike(indexed)), lambda k, v: F.concat(side(k), F.regexp_replace(k, indexed, "$1.$2")))
    return F.map_concat(flat, lists)
