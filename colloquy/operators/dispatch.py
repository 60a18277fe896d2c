"""Dispatch of captured pairs to the parser of their format.

A parser is a name, a condition on provider, host and path, and an expression that gives what it reads from the bodies:
messages, model, session key, title and a confidence; null where the bodies are not of its format. `PARSERS` is their
order. All that accept a pair read it in one pass of built-in expressions, without a shuffle or a second scan; the first
with a confidence of at least SURE wins, else the most confident one, of equals the first.

Intercepted traffic (direction `network_intercept`) is unwrapped first: the body holds the request's and the response's
bodies and the address. Of these a result must have an assistant's message, else the fallbacks read them.

Defined cases: null, empty and malformed bodies fit no format; unknown fields are left aside; messages without text are
left out; a pair that nothing reads gives no row; repeated pairs give repeated rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .fallback import recovered
from .normalise import is_event_stream, let, plain_content, request_messages, response_message

SURE = 0.9
TITLE_CHARACTERS = 100
MESSAGE = "struct<role:string,content:string,model_name:string,tokens:bigint>"
_NONE = f"array<{MESSAGE}>"

# Hosts and providers of chat services, in order.
CHAT_PATHS = ("/v1/chat/completions", "/chat/completions")
CHAT_PATH = r"(?i)chat[/_-]?completions|/api/conversation|/backend-api/conversation|/api/append-message|/generateContent|/streamGenerateContent"
CHAT_HOSTS = (
    "api.openai.com chatgpt.com chat.openai.com api.deepseek.com chat.deepseek.com api.groq.com api.together.xyz api.fireworks.ai openrouter.ai api.perplexity.ai www.perplexity.ai api.mistral.ai chat.mistral.ai api.x.ai grok.com "
    "open.bigmodel.cn chat.z.ai chatglm.cn chat.zhipuai.cn maas.aminer.cn api.moonshot.cn kimi.moonshot.cn www.kimi.com kimi.com api.githubcopilot.com copilot-proxy.githubusercontent.com localhost 127.0.0.1"
).split()
CHAT_PROVIDERS = "openai groq together fireworks openrouter zhipu moonshot ollama local-model lm-studio vllm localai text-gen-webui jan".split()
MESSAGES_PATHS = ("/v1/messages", "/messages")
CONVERSATION_PATH = r"(?i)/chat_conversations/([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})/completion"
PAGE_PROVIDERS = "deepseek google perplexity xai poe microsoft huggingface mistral kimi universal grok copilot".split()
PAGE_HOSTS = "chat.deepseek.com gemini.google.com www.perplexity.ai grok.com poe.com copilot.microsoft.com huggingface.co chat.mistral.ai kimi.moonshot.cn www.kimi.com kimi.com".split()
CALLS = ("tools/call", "resources/read", "prompts/get")
TRANSCRIPT_PATH = r"^/[^/]+/agent-transcript/([^/]+)/[^/]+$"
SILENT_PARTS = "thinking mcpServersStarting progressMessage toolInvocationSerialized".split()
USER_BUBBLE, ASSISTANT_BUBBLE = 1, 2


@dataclass
class Parser:
    name: str
    accepts: Callable[[], Column]
    reads: Callable[[], Column]


def _said(c: Column) -> Column:
    """The value, null for an empty one."""
    return F.nullif(c, F.lit(""))


def _message(role: Column | str, content: Column, model: Column | None = None, tokens: Column | None = None) -> Column:
    cells = {"role": F.lit(role) if isinstance(role, str) else role, "content": content, "model_name": F.lit(None).cast("string") if model is None else model, "tokens": F.lit(None).cast("bigint") if tokens is None else tokens.cast("bigint")}
    return F.struct(*[c.alias(n) for n, c in cells.items()])


def _kept(messages: Column) -> Column:
    return F.filter(F.coalesce(messages, F.array().cast(_NONE)), lambda m: F.trim(F.coalesce(m["content"], F.lit(""))) != "")


def _result(fits: Column, messages: Column, model: Column, key: Column, title: Column, confidence: Column, provider: Column, family: Column) -> Column:
    """What a parser read; a title that is missing is the first user's text. messages is a bound value."""
    first = F.substring(F.get(F.filter(messages, lambda m: m["role"] == "user"), F.lit(0))["content"], 1, TITLE_CHARACTERS)
    cells = {"messages": messages, "model_name": _said(model), "session_key": _said(key), "title": F.coalesce(_said(title), first), "confidence": confidence.cast("double"), "its_provider": provider, "tool_family": family}
    return F.when(fits, F.struct(*[c.alias(n) for n, c in cells.items()]))


def _read(schema: str, column: str = "body") -> Column:
    return F.from_json(column, schema)


def _both(messages: Column) -> Column:
    return F.exists(messages, lambda m: m["role"] == "user") & F.exists(messages, lambda m: m["role"] == "assistant")


def _sum(*parts: tuple[Column, float]) -> Column:
    """The weights of the conditions that hold, in hundredths, as a share of 1 at most."""
    return F.least(reduce(lambda a, b: a + b, [F.when(c, round(w * 100)).otherwise(0) for c, w in parts]) / 100, F.lit(1.0))


def _listed(c: Column) -> Column:
    return F.coalesce(F.size(c), F.lit(0)) > 0


# --- stored sessions of tools, a body each ---


def editor_chat() -> Column:
    return let(_read("struct<sessionId:string,customTitle:string,inputState:struct<selectedModel:struct<identifier:string>>,requests:array<struct<message:struct<text:string>,completionTokens:bigint,response:array<struct<kind:string,value:string,language:string,code:string>>>>>"), _of_editor)


def _of_editor(s: Column) -> Column:
    model = F.coalesce("model_name", s["inputState"]["selectedModel"]["identifier"])
    part = lambda b: F.when(b["kind"] == "codeblock", F.concat(F.lit("```"), F.coalesce(b["language"], F.lit("")), F.lit("\n"), F.coalesce(b["code"], F.lit("")), F.lit("\n```"))).when(b["kind"].isNull() | (b["kind"] == "markdown"), b["value"])
    answer = lambda r: F.array_join(F.filter(F.transform(r["response"], part), lambda t: F.coalesce(t, F.lit("")) != ""), "\n")
    asked = F.filter(s["requests"], lambda r: F.coalesce(r["message"]["text"], F.lit("")) != "")
    read = _kept(F.flatten(F.transform(asked, lambda r: F.array(_message("user", r["message"]["text"], model), _message("assistant", answer(r), model, r["completionTokens"])))))
    return let(read, lambda messages: _result(_said(s["sessionId"]).isNotNull() & _listed(messages), messages, model, s["sessionId"], s["customTitle"], F.lit(0.95), F.lit("github"), F.lit("copilot-chat-l3g")))


def composer_chat() -> Column:
    return let(_read("struct<composer_id:string,name:string,model_config:struct<modelName:string,selectedModels:array<struct<modelId:string>>>,bubbles:array<struct<text:string,bubble_type:int>>>"), _of_composer)


def _of_composer(s: Column) -> Column:
    chosen = F.get(s["model_config"]["selectedModels"], F.lit(0))["modelId"]
    named = s["model_config"]["modelName"]
    model = F.coalesce(F.col("model_name"), F.when(named != "default", named), F.when(chosen != "default", chosen), named)
    role = lambda done, b: F.when(b["bubble_type"] == USER_BUBBLE, "user").when(b["bubble_type"] == ASSISTANT_BUBBLE, "assistant").when(F.coalesce(F.get(done, F.size(done) - 1)["role"], F.lit("assistant")) == "assistant", "user").otherwise("assistant")
    shown = F.filter(s["bubbles"], lambda b: F.coalesce(b["text"], F.lit("")) != "")
    read = F.aggregate(shown, F.array().cast(_NONE), lambda done, b: F.concat(done, F.array(_message(role(done, b), b["text"], model))))
    return let(read, lambda messages: _result(_said(s["composer_id"]).isNotNull() & _listed(messages), messages, model, s["composer_id"], s["name"], F.lit(0.95), F.lit("cursor"), F.lit("cursor-chat-l3g")))


def turns_dump() -> Column:
    return let(_read("struct<session_id:string,model:string,turns:array<struct<role:string,content_text:string>>>"), _of_turns)


def _of_turns(s: Column) -> Column:
    model = F.coalesce("model_name", s["model"])
    spoken = F.filter(s["turns"], lambda t: t["role"].isin("user", "assistant") & (F.coalesce(t["content_text"], F.lit("")) != ""))
    read = F.transform(spoken, lambda t: _message(t["role"], t["content_text"], model))
    return let(read, lambda messages: _result(_said(s["session_id"]).isNotNull() & _listed(messages), messages, model, s["session_id"], F.lit(None).cast("string"), F.lit(0.95), F.lit("openai"), F.lit("codex-cli-l3g")))


def typed_dump() -> Column:
    """Messages typed `user` or `gemini`; a model that a message names holds for those after it, thoughts follow their message."""
    return let(_read("struct<session_id:string,model:string,messages:array<struct<type:string,content:string,model:string,thoughts:array<struct<subject:string,description:string>>,tokens:struct<output:bigint>>>>"), _of_typed)


def _of_typed(s: Column) -> Column:
    start = F.struct(F.coalesce("model_name", s["model"]).alias("model"), F.array().cast(_NONE).alias("done"))

    def step(acc: Column, m: Column) -> Column:
        model = F.when(m["type"] == "gemini", F.coalesce(_said(m["model"]), acc["model"])).otherwise(acc["model"])
        thought = F.array_join(F.transform(m["thoughts"], lambda t: F.concat(F.lit("["), F.coalesce(t["subject"], F.lit("")), F.lit("] "), F.coalesce(t["description"], F.lit("")))), "\n")
        answers = F.array(_message("assistant", plain_content(m["content"]), model, m["tokens"]["output"]), _message("assistant", thought, model))
        new = F.when(m["type"] == "user", F.array(_message("user", plain_content(m["content"]), acc["model"]))).otherwise(answers)
        return F.struct(model.alias("model"), F.concat(acc["done"], _kept(new)).alias("done"))

    known = F.filter(s["messages"], lambda m: m["type"].isin("user", "gemini") & (F.coalesce(plain_content(m["content"]), F.lit("")) != ""))
    title = lambda read: F.substring(F.get(F.filter(read["done"], lambda m: m["role"] == "user"), F.lit(0))["content"], 1, 60)
    return let(F.aggregate(known, start, step), lambda read: _result(_said(s["session_id"]).isNotNull() & _listed(read["done"]), read["done"], read["model"], s["session_id"], title(read), F.lit(0.95), F.lit("google"), F.lit("gemini-cli-l3g")))


def transcript_line() -> Column:
    """A line of an agent's transcript: one message, or none for what only tells about the session."""
    return let(_read("struct<type:string,sessionId:string,session_id:string,entrypoint:string,content:string,message:struct<role:string,content:string,model:string>>"), _of_transcript)


def _of_transcript(s: Column) -> Column:
    role = F.coalesce(_said(s["message"]["role"]), F.when(s["type"] == "assistant", "assistant").otherwise("user"))
    model = F.coalesce(_said(s["message"]["model"]), F.col("model_name"))
    text = F.when(s["message"].isNotNull(), plain_content(s["message"]["content"])).otherwise(s["content"])
    read = F.when(s["type"].isin("user", "assistant"), _kept(F.array(_message(role, text, model)))).otherwise(F.array().cast(_NONE))
    named = F.nullif(F.nullif(F.regexp_extract("path", TRANSCRIPT_PATH, 1), F.lit("")), F.lit("unknown"))
    family = F.when(s["entrypoint"] == "claude-desktop", "claude-desktop-code").when(s["entrypoint"] == "cli", "claude-code-cli").otherwise("cowork-local-agent")
    return let(read, lambda messages: _result(F.json_object_keys("body").isNotNull(), messages, model, F.coalesce(named, s["sessionId"], s["session_id"]), F.lit(None).cast("string"), F.lit(0.95), F.lit("anthropic"), family))


# --- calls of tools ---


def remote_call() -> Column:
    """A call and its result: what the agent asked for, and what the tool answered. Arguments are shown as they were sent."""
    q = _read("struct<id:string,params:struct<name:string,uri:string,arguments:string>>", "request")
    r = _read("struct<result:string,error:struct<code:string,message:string>>", "response")
    return let(F.struct(q.alias("q"), r.alias("r")), lambda x: let(F.from_json(x["r"]["result"], "struct<isError:boolean,content:array<struct<type:string,text:string>>>"), lambda found: _of_call(x["q"], x["r"], found)))


def _of_call(q: Column, r: Column, found: Column) -> Column:
    upstream = F.substring(F.col("provider"), 5, 1 << 30)
    kind = F.when(F.col("path") == "tools/call", "tool").when(F.col("path") == "resources/read", "resource").otherwise("prompt")
    name = F.when(F.col("path") == "resources/read", q["params"]["uri"]).otherwise(q["params"]["name"])
    sent = F.when((F.col("path") != "resources/read") & F.ltrim(q["params"]["arguments"]).startswith("{"), q["params"]["arguments"]).otherwise("{}")
    call = F.concat(F.lit("mcp_"), upstream, F.lit("_"), kind, F.lit("_"), F.coalesce(q["id"], F.lit("None")))
    asked = F.concat(F.lit("["), F.col("path"), F.lit("] "), upstream, F.lit("."), name, F.lit(" "), sent, F.lit(" #"), call)
    texts = F.array_join(F.filter(F.transform(F.filter(found["content"], lambda c: c["type"] == "text"), lambda c: c["text"]), lambda t: F.coalesce(t, F.lit("")) != ""), "\n")
    spoken = let(_said(texts), lambda t: F.when(found["isError"], F.concat(F.lit("[tool error] "), t)).otherwise(t))
    failed = F.trim(F.concat(F.lit("[JSON-RPC error "), F.coalesce(r["error"]["code"], F.lit("None")), F.lit("] "), F.coalesce(r["error"]["message"], F.lit(""))))
    answer = F.when(r["error"].isNotNull(), failed).otherwise(F.coalesce(spoken, r["result"]))
    read = F.concat(F.array(_message("assistant", asked)), _kept(F.array(_message("tool", answer))))
    whole = F.json_object_keys("request").isNotNull() & F.json_object_keys("response").isNotNull() & (F.coalesce(name, F.lit("")) != "")
    key = F.concat(F.lit("mcp-proxy:"), upstream, F.lit(":"), F.date_format(F.timestamp_micros((F.col("created_at") * 1e6).cast("bigint")), "yyyy-MM-dd"))
    return let(read, lambda messages: _result(whole, messages, F.col("model_name"), key, F.lit(None).cast("string"), F.lit(0.95), F.col("provider"), F.lit("mcp-proxy")))


# --- services ---


def _known(column: str, values: list[str] | tuple[str, ...]) -> Column:
    return F.coalesce(F.col(column).isin(*values), F.lit(False))


def _host() -> Column:
    return F.coalesce(F.split_part("host", F.lit(":"), F.lit(1)), F.lit(""))


def _chat(confidence: Callable[[Column, Column, Column], Column], tokens: str, extra_key: Column, family: str) -> Column:
    q = _read("struct<model:string,conversation_id:string,session_id:string,title:string,messages:array<struct<role:string,content:string>>,prompt:string,parent_message_uuid:string>", "request")
    r = _read("struct<model:string,conversation_id:string,choices:array<struct<index:int>>,message:struct<role:string,content:string>,content:array<struct<type:string>>,usage:struct<total_tokens:bigint,completion_tokens:bigint,input_tokens:bigint,output_tokens:bigint>>", "response")
    bound = F.struct(q.alias("q"), r.alias("r"), response_message(F.col("response")).alias("reply"))
    return let(bound, lambda x: _of_chat(x["q"], x["r"], F.coalesce(x["reply"]["content"], x["r"]["message"]["content"]), confidence, tokens, extra_key, family))


def _of_chat(q: Column, r: Column, reply: Column, confidence: Callable[[Column, Column, Column], Column], tokens: str, extra_key: Column, family: str) -> Column:
    model = F.coalesce(_said(F.col("model_name")), _said(r["model"]), _said(q["model"]))
    web = F.when(q["prompt"].isNotNull() & ~_listed(q["messages"]), F.array(_message("user", q["prompt"])))
    said = F.coalesce(web, F.transform(request_messages(F.col("request")), lambda m: _message(m["role"], m["content"], F.when(m["role"] == "assistant", model))))
    read = _kept(F.concat(said, F.array(_message("assistant", reply, model, r["usage"][tokens]))))
    key = F.coalesce(_said(q["conversation_id"]), _said(q["session_id"]), _said(r["conversation_id"]), extra_key)
    return let(read, lambda messages: _result(F.json_object_keys("request").isNotNull() & _listed(messages), messages, model, key, q["title"], confidence(q, r, messages), F.coalesce(_said(F.col("provider")), F.lit("unknown")), F.lit(family)))


def chat_completions() -> Column:
    def confidence(q: Column, r: Column, messages: Column) -> Column:
        formed = F.size(F.filter(q["messages"], lambda m: m["role"].isNotNull() & m["content"].isNotNull())) / F.greatest(F.size(q["messages"]), F.lit(1))
        rest = _sum(
            (_said(q["model"]).isNotNull(), 0.10), (_listed(r["choices"]), 0.20), (~_listed(r["choices"]) & r["message"].isNotNull(), 0.15), (F.coalesce(r["usage"]["total_tokens"], F.lit(0)) > 0, 0.10),
            (_both(messages), 0.15), (~_both(messages) & _listed(messages), 0.05), (_host().isin(*CHAT_HOSTS), 0.10), (_known("path", CHAT_PATHS), 0.10),
        )
        return F.least(F.round(rest + F.when(_listed(q["messages"]), 0.25 * formed).otherwise(0.0), 6), F.lit(1.0))

    return _chat(confidence, "completion_tokens", F.lit(None).cast("string"), "api-chat")


def content_blocks() -> Column:
    def confidence(q: Column, r: Column, messages: Column) -> Column:
        named = F.contains(F.lower(F.coalesce(q["model"], F.lit(""))), F.lit("claude"))
        return _sum(
            (_listed(q["messages"]), 0.25), (named, 0.15), (~named & _said(q["model"]).isNotNull(), 0.05), (_listed(r["content"]), 0.20), (F.coalesce(r["usage"]["input_tokens"], F.lit(0)) + F.coalesce(r["usage"]["output_tokens"], F.lit(0)) > 0, 0.10),
            (_both(messages), 0.15), (~_both(messages) & _listed(messages), 0.05), (F.contains(_host(), F.lit("anthropic")) | (_host() == "claude.ai"), 0.10), (_known("path", MESSAGES_PATHS), 0.05),
        )

    return _chat(confidence, "output_tokens", _said(F.regexp_extract(F.coalesce("path", F.lit("")), CONVERSATION_PATH, 1)), "api-messages")


def page_conversation() -> Column:
    """Messages that were read off a page. A user's message whose predecessor is the user's too, and has attachments, takes its place."""
    return let(_read("struct<conversation_id:string,session_id:string,title:string,messages:array<struct<role:string,content:string,attachments:array<string>>>>"), _of_page)


def _of_page(s: Column) -> Column:
    role = lambda m: F.coalesce(m["role"], F.lit("user"))
    spoken = F.filter(s["messages"], lambda m: F.trim(F.coalesce(m["content"], F.lit(""))) != "")
    pending = lambda acc, m: (role(m) == "user") & F.coalesce(acc["open"], F.lit(False))
    done = lambda acc, m: F.when(pending(acc, m), F.slice(acc["done"], 1, F.greatest(F.size(acc["done"]) - 1, F.lit(0)))).otherwise(acc["done"])
    start = F.struct(F.array().cast(_NONE).alias("done"), F.lit(False).alias("open"))
    folded = F.aggregate(spoken, start, lambda acc, m: F.struct(
        F.concat(done(acc, m), F.array(_message(role(m), m["content"], F.when(role(m) == "assistant", F.col("model_name"))))).alias("done"),
        ((role(m) == "user") & (_listed(m["attachments"]) | pending(acc, m))).alias("open")))
    return let(folded["done"], lambda messages: _page_result(s, messages))


def _page_result(s: Column, messages: Column) -> Column:
    formed = F.size(F.filter(s["messages"], lambda m: m["role"].isNotNull() & (F.coalesce(m["content"], F.lit("")) != ""))) / F.greatest(F.size(s["messages"]), F.lit(1))
    mean = F.aggregate(messages, F.lit(0), lambda n, m: n + F.length(m["content"])) / F.greatest(F.size(messages), F.lit(1))
    key = F.coalesce(_said(s["conversation_id"]), _said(s["session_id"]))
    rest = _sum(
        (_both(messages), 0.20), (~_both(messages), 0.05), (_known("provider", PAGE_PROVIDERS), 0.10), (_known("host", PAGE_HOSTS), 0.10), (key.isNotNull(), 0.10), (_said(s["title"]).isNotNull(), 0.05),
        (F.size(messages) >= 4, 0.10), (F.size(messages).between(2, 3), 0.05), (mean > 20, 0.10),
    )
    provider = _said(F.col("provider"))
    family = F.coalesce(F.concat(provider, F.lit("-web")), F.lit("web"))
    return _result(_listed(messages), messages, F.col("model_name"), key, s["title"], F.least(F.round(rest + 0.25 * formed, 6), F.lit(1.0)), F.coalesce(provider, F.lit("unknown")), family)


def _at(host: str) -> Callable[[], Column]:
    return lambda: F.col("host").eqNullSafe(host)


def _is_chat() -> Column:
    return _known("path", CHAT_PATHS) | F.coalesce(F.col("path").rlike(CHAT_PATH), F.lit(False)) | _host().isin(*CHAT_HOSTS) | _known("provider", CHAT_PROVIDERS)


def _is_messages() -> Column:
    path = F.coalesce("path", F.lit(""))
    return _known("path", MESSAGES_PATHS) | (F.contains(_host(), F.lit("anthropic")) & F.contains(path, F.lit("messages"))) | (_host() == "claude.ai") | F.col("provider").eqNullSafe("anthropic")


def _is_call() -> Column:
    return F.coalesce(F.col("provider").startswith("mcp:"), F.lit(False)) & F.col("host").eqNullSafe("stdio") & _known("path", CALLS)


#: In order: formats with a host of their own, services, calls and transcripts, and what is left.
PARSERS = [
    Parser("editor_chat", _at("local-copilot-chat"), editor_chat), Parser("composer_chat", _at("local-cursor-chat"), composer_chat), Parser("turns_dump", _at("local-codex-cli"), turns_dump), Parser("typed_dump", _at("local-gemini-cli"), typed_dump),
    Parser("chat_completions", _is_chat, chat_completions), Parser("content_blocks", _is_messages, content_blocks), Parser("remote_call", _is_call, remote_call),
    Parser("transcript_line", lambda: F.col("host").eqNullSafe("local-agent-mode") & F.coalesce(F.col("path").rlike(TRANSCRIPT_PATH), F.lit(False)), transcript_line), Parser("page_conversation", lambda: F.lit(True), page_conversation),
]


def unwrapped(pairs: DataFrame) -> DataFrame:
    """Intercepted pairs with the bodies, host and path that their wrapper names; others as they are."""
    w = F.from_json("request", "struct<request_body:string,response_body:string,url:string>")
    inner = F.col("direction").eqNullSafe("network_intercept")
    out = {"request": w["request_body"], "response": w["response_body"], "host": F.coalesce(T.url_host(w["url"]), F.col("host")), "path": F.coalesce(_said(T.url_path(w["url"])), F.col("path"))}
    return pairs.withColumns({c: F.when(inner, v).otherwise(F.col(c)) for c, v in out.items()})


def dispatched(pairs: DataFrame, parsers: list[Parser] | None = None) -> DataFrame:
    """pairs (pair_id, direction, provider, host, path, request, response, model_name, created_at) as pair_id, parser,
    messages, model_name, session_key, title, confidence, provider, tool_family; a row per pair that a parser reads."""
    parsers = PARSERS if parsers is None else parsers
    rows = unwrapped(pairs).withColumn("body", F.coalesce(_said(F.col("request")), F.col("response")))
    tried = [F.when(p.accepts(), F.struct(F.lit(p.name).alias("parser"), p.reads().alias("read"))) for p in parsers]

    def winner(fit: Column) -> Column:
        """Positions count down, so that the larger one is the earlier parser."""
        sure = lambda t: t["read"]["confidence"] >= SURE
        ranked = F.transform(fit, lambda t, i: F.struct(sure(t).alias("sure"), F.when(sure(t), 0.0).otherwise(t["read"]["confidence"]).alias("confidence"), (-i).alias("order"), i.alias("at")))
        return F.get(fit, F.array_max(ranked)["at"])

    best = let(F.filter(F.array(*tried), lambda t: t["read"].isNotNull()), winner)
    # What a generator gives isn't worked out again where it is filtered by.
    found = rows.select("pair_id", "direction", "host", "request", "response", F.explode(F.array(best)).alias("best"))
    wrapped = F.col("direction").eqNullSafe("network_intercept")
    answered = F.exists("best.read.messages", lambda m: m["role"] == "assistant")
    good = F.col("best").isNotNull() & (~wrapped | F.coalesce(answered, F.lit(False)))
    direct = found.where(good).select("pair_id", "best.parser", "best.read.messages", "best.read.model_name", "best.read.session_key", "best.read.title", "best.read.confidence", F.col("best.read.its_provider").alias("provider"), "best.read.tool_family")
    rest = found.where(wrapped & ~good)
    again = recovered(rest.select("pair_id", "host", "request", F.when(is_event_stream(F.col("response")), F.to_json(F.struct(F.array(F.struct(response_message(F.col("response")).alias("message"))).alias("choices")))).otherwise(F.col("response")).alias("response")))
    shaped = again.select("pair_id", F.concat(F.lit("fallback_"), "shape").alias("parser"), F.transform("messages", lambda m: _message(m["role"], m["content"])).alias("messages"), "model_name", "session_key", "title", "confidence", F.lit("unknown").alias("provider"), F.lit("web").alias("tool_family"))
    return direct.unionByName(shaped)


def dispatched_messages(pairs: DataFrame) -> DataFrame:
    """The messages of `dispatched`, a row each."""
    rows = dispatched(pairs).select("pair_id", "parser", "session_key", "confidence", "provider", F.posexplode("messages").alias("turn_index", "m"))
    return rows.select("pair_id", "parser", "session_key", "confidence", "provider", "turn_index", F.col("m.role").alias("role"), F.col("m.content").alias("content_text"), "m.model_name", "m.tokens")
