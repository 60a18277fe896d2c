"""Scalar functions on text columns, all of built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Han, kana and Hangul ranges that count as CJK.
HAN, KANA, HANGUL = r"[\x{4e00}-\x{9fff}]", r"[\x{3040}-\x{30ff}]", r"[\x{ac00}-\x{d7af}]"
CJK = r"[\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]"

# A topic is tagged if two of its keywords occur anywhere in the lower-cased text.
TOPICS = {
    "coding": ["code", "function", "class", "bug", "error", "python", "javascript", "typescript", "rust", "java", "html", "css", "sql", "api", "debug", "compile", "runtime", "algorithm", "variable", "loop", "array", "代码", "编程", "函数", "变量", "调试", "报错"],
    "writing": ["write", "essay", "article", "blog", "draft", "paragraph", "proofread", "grammar", "rewrite", "summarize", "summary", "写作", "文章", "论文", "摘要", "润色", "改写"],
    "math": ["equation", "calculate", "formula", "proof", "integral", "derivative", "matrix", "probability", "statistics", "algebra", "计算", "公式", "数学", "方程", "概率", "统计"],
    "analysis": ["analyze", "data", "chart", "trend", "insight", "compare", "evaluate", "metrics", "benchmark", "report", "分析", "数据", "趋势", "对比", "评估"],
    "translation": ["translate", "translation", "interpreter", "翻译", "英译中", "中译英", "日译"],
    "creative": ["story", "poem", "creative", "fiction", "novel", "character", "plot", "故事", "诗", "创作", "小说"],
    "explanation": ["what is", "how to", "explain", "why does", "how does", "tell me about", "什么是", "怎么", "为什么", "解释", "介绍"],
}

# Secrets and what stands for them, in the order of application.
SECRETS = [
    (r"(?i)\bBearer\s+[A-Za-z0-9._\-~+/=]{8,}", "Bearer [REDACTED]"),
    (r"(?i)\bBasic\s+[A-Za-z0-9+/=]{8,}", "Basic [REDACTED]"),
    (r"\beyJ[A-Za-z0-9_\-]{5,}\.[A-Za-z0-9_\-]{5,}\.[A-Za-z0-9_\-]{5,}", "[REDACTED_JWT]"),
    (r"\bsk-ant-[A-Za-z0-9_\-]{20,}", "[REDACTED_ANTHROPIC_KEY]"),
    (r"\bsk-(?:proj-|admin-|live-|test-)?[A-Za-z0-9_\-]{20,}", "[REDACTED_OPENAI_KEY]"),
    (r"\bAIza[A-Za-z0-9_\-]{30,}", "[REDACTED_GOOGLE_API_KEY]"),
    (r"\bgh[pousr]_[A-Za-z0-9]{20,}", "[REDACTED_GITHUB_TOKEN]"),
    (r"\bgithub_pat_[A-Za-z0-9_]{30,}", "[REDACTED_GITHUB_TOKEN]"),
    (r"\b(?:sk|pk)_(?:live|test)_[A-Za-z0-9]{20,}", "[REDACTED_STRIPE_KEY]"),
    (r"\b(?:AKIA|ASIA|AGPA|AIDA|AROA|AIPA)[0-9A-Z]{16}\b", "[REDACTED_AWS_KEY]"),
    (r"\bxox[baprs]-[A-Za-z0-9-]{10,}", "[REDACTED_SLACK_TOKEN]"),
]
# Headers that are redacted, whatever their case.
SECRET_HEADERS = ["authorization", "cookie", "set-cookie", "x-api-key", "api-key", "proxy-authorization"]
# Short messages that are whole.
WHOLE_SHORT = ["pong", "ping", "ok", "yes", "no", "hi", "hey", "done", "sure", "thanks"]


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def words(c: Column) -> Column:
    """Words between white space; none for null and blank texts."""
    return F.regexp_count(_text(c), F.lit(r"\S+"))


def estimate_tokens(c: Column) -> Column:
    """1.5 tokens a CJK character and 1.3 a word, cut off, at least one; null for a blank text."""
    cjk = F.regexp_count(_text(c), F.lit(CJK))
    estimate = (cjk * 1.5 + (words(c) - cjk) * 1.3).cast("int")
    return F.when(words(c) > 0, F.greatest(estimate, F.lit(1)))


def dominant_language(han: Column, kana: Column, hangul: Column, latin: Column) -> Column:
    """ja, ko, zh, mixed or en from counts of characters."""
    cjk = han + kana + hangul
    total = cjk + latin
    inner = F.when((kana > han) & (kana > hangul), "ja").when(hangul > han, "ko").when(cjk > total * 0.6, "zh").otherwise("mixed")
    return F.when(cjk > total * 0.3, inner).otherwise("en")


def keyword_hits(c: Column, topic: str) -> list[Column]:
    return [F.contains(F.lower(_text(c)), F.lit(k)) for k in TOPICS[topic]]


def scrub(c: Column) -> Column:
    for pattern, said in SECRETS:
        c = F.regexp_replace(c, pattern, said)
    return c


def redact_headers(c: Column) -> Column:
    """JSON of an object of strings with the values of secret headers replaced; null for what isn't one."""
    headers = F.from_json(c, "map<string,string>")
    return F.to_json(F.transform_values(headers, lambda k, v: F.when(F.lower(k).isin(*SECRET_HEADERS), F.lit("REDACTED")).otherwise(v)))


def looks_truncated(c: Column) -> Column:
    """Empty, or up to two short words that are no known short message and don't end a sentence."""
    t = _text(c)
    cjk = F.regexp_count(t, F.lit(CJK))
    whole = (cjk >= 2) | F.lower(F.trim(t)).isin(*WHOLE_SHORT) | F.rtrim(t).rlike(r"[.!?。！？…]$")
    return (t == "") | (~whole & (words(t) <= 2) & (F.length(t) < 5) & (cjk == 0))


def raw_json_left(c: Column) -> Column:
    t = F.trim(_text(c))
    head = F.substring(t, 1, 80)
    return t.startswith("{") & (F.contains(head, F.lit("parts")) | F.contains(head, F.lit("content_type")))


def message_key(role: Column, c: Column) -> Column:
    """Role and the first 200 characters of the text."""
    return F.concat(role, F.lit(":"), F.substring(_text(c), 1, 200))


def pair_fingerprint(pair_id: Column, body: Column) -> Column:
    return F.sha2(F.concat(F.encode(pair_id, "UTF-8"), F.lit(b"\x00"), F.encode(F.substring(_text(body), 1, 1024), "UTF-8")), 256)


def request_fingerprint(method: Column, host: Column, path: Column, seconds: Column, body: Column) -> Column:
    """The same request within five minutes has the same fingerprint."""
    head = F.concat_ws("|", F.upper(method), host, path, F.floor(seconds / 300).cast("string"))
    return F.sha2(F.concat(F.encode(F.concat(head, F.lit("|")), "UTF-8"), F.substring(F.encode(_text(body), "UTF-8"), 1, 1024)), 256)


def short_id(seed: Column, width: int) -> Column:
    """The first hex digits of the seed's SHA-256."""
    return F.substring(F.sha2(F.when(seed == "", F.lit("empty")).otherwise(seed), 256), 1, width)


def tls_category(c: Column) -> Column:
    e = F.lower(_text(c))
    has = lambda *xs: _any([F.contains(e, F.lit(x)) for x in xs])
    return (
        F.when(has("pinning", "pinned", "pin verification"), "pinning_explicit").when(has("certificate_unknown", "unknown_ca", "unknown ca"), "cert_unknown_ca")
        .when(has("certificate") & has("reject", "invalid", "verify"), "cert_verify_failed").when(has("bad certificate", "bad_certificate"), "cert_rejected")
        .when(has("handshake_failure", "handshake failure"), "handshake_failure").when(has("timeout", "timed out"), "handshake_timeout")
        .when(has("protocol") & has("version"), "protocol_version").when(has("ssl", "tls"), "tls_other").otherwise("unknown")
    )


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def role_name(c: Column) -> Column:
    """Roles of other systems in this engine's terms; unknown ones in lower case."""
    r = F.lower(F.trim(c))
    return F.when(r.isin("human", "user"), "user").when(r.isin("ai", "bot", "model", "assistant"), "assistant").otherwise(r)


def url_host(c: Column) -> Column:
    return F.try_parse_url(c, F.lit("HOST"))


def url_path(c: Column) -> Column:
    return F.coalesce(F.try_parse_url(c, F.lit("PATH")), F.lit(""))


def version_key(c: Column) -> Column:
    """Three numbers that compare as versions do; -1 each for what isn't one."""
    part = lambda i: F.regexp_extract(c, r"^\s*v?(\d{1,9})\.(\d{1,9})(?:\.(\d{1,9}))?", i)
    number = lambda i: F.when(part(1) == "", -1).when(part(i) == "", 0).otherwise(F.try_to_number(part(i), F.lit("999999999")).cast("int"))
    return F.struct(number(1).alias("major"), number(2).alias("minor"), number(3).alias("patch"))


def message_score(c: Column, model: Column, tokens: Column, attachments: Column) -> Column:
    """Quality from 0 to 1 by length, what is known about the message, and cleanness of the text."""
    t = F.trim(_text(c))
    n = F.length(t)
    clean = ~((t.startswith("{") & t.endswith("}")) | (t.startswith("[{") & t.endswith("}]")) | F.contains(t, F.lit("...[truncated]")))
    add = lambda cond, x: F.when(cond, F.lit(x)).otherwise(F.lit(0.0))
    score = F.least(n / 500, F.lit(0.25)) + add(F.coalesce(model, F.lit("")) != "", 0.15) + add(F.coalesce(tokens, F.lit(0)) > 0, 0.15) + add(attachments, 0.10)
    score = score + add(F.contains(_text(c), F.lit("[Tool call:")), 0.05) + add(F.contains(_text(c), F.lit("<thinking>")), 0.05) + add(clean & (n > 10), 0.15)
    return F.least(F.when(n < 5, score * 0.5).otherwise(score), F.lit(1.0))


def drafts_redacted(c: Column) -> Column:
    """JSON with the string of every member named text replaced, at any depth; all else stays as it was written.

    Within a string of JSON each quote has a backslash before it, so `"text":` is a member's name wherever it stands.
    """
    return F.regexp_replace(c, r'(?s)("text"\s*+:\s*+)".*?(?<!\\)(?:\\\\)*+"', '$1"[redacted]"')


def units_head(c: Column, n: int) -> Column:
    """The first n UTF-16 units of a text; half a character at the end is left out."""
    raw = F.substring(F.encode(c, "UTF-16BE"), 1, 2 * n)
    half = F.hex(raw).rlike("D[89AB]..$") & (F.length(raw) == 2 * n)
    return F.decode(F.when(half, F.substring(raw, 1, 2 * n - 2)).otherwise(raw), "UTF-16BE")


def page_fingerprint(messages: Column) -> Column:
    """One string of a conversation as a page shows it: role, the text's first 160 units and what names each attachment.

    messages is array<struct<role, content, attachments: array<struct<type, file_id, url, name, title, language, code, output>>>>;
    what is null or empty is passed over, a null list has the empty string.
    """
    some = lambda x: F.nullif(x, F.lit(""))

    def named(a: Column) -> Column:
        detail = F.coalesce(*[some(a[f]) for f in ("file_id", "url", "name", "title", "language")], *[some(units_head(a[f], 80)) for f in ("code", "output")], F.lit(""))
        return F.concat_ws(":", F.coalesce(some(a["type"]), F.lit("unknown")), detail)

    def said(m: Column) -> Column:
        attachments = F.array_join(F.transform(F.filter(m["attachments"], lambda a: a.isNotNull()), named), ",")
        return F.concat_ws(":", F.coalesce(some(m["role"]), F.lit("unknown")), F.coalesce(units_head(m["content"], 160), F.lit("")), F.coalesce(attachments, F.lit("")))

    return F.coalesce(F.array_join(F.transform(messages, said), "|"), F.lit(""))
