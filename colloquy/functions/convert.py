"""Conversions between the forms in which captures, times and ids come: columns to columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of host names and the provider that they stand for, the first that fits (fixed values).
HOST_PROVIDERS = [
    ("githubcopilot", "github-copilot"), ("copilot-proxy.githubusercontent", "github-copilot"), ("openai", "openai"), ("chatgpt", "openai"),
    ("anthropic", "anthropic"), ("claude.ai", "anthropic"), ("googleapis", "google"), ("gemini", "google"), ("aistudio.google", "google"),
    ("x.ai", "xai"), ("grok.com", "xai"), ("perplexity", "perplexity"), ("cursor", "cursor"), ("codeium", "codeium"), ("windsurf", "codeium"),
]
#: Layers that older source types became (fixed values); others are DEFAULT_LAYER.
SOURCE_LAYERS = {"proxy": "L1_mitm", "browser_extension": "L3a_browser_ext", "mcp": "L3c_vscode_ext", "ide_plugin": "L3c_vscode_ext", "local_model": "L3e_litellm"}
DEFAULT_LAYER = "L1_mitm"
BODY_BYTES = 2 * 1024 * 1024


def iso_to_ms(text: Column) -> Column:
    """Milliseconds of an ISO-8601 time, with or without its separators; without a zone it is UTC, a date is its midnight; null for anything else."""
    t = F.regexp_replace(F.trim(text), r"^(\d{4})(\d\d)(\d\d)(?=$|[T ])", "$1-$2-$3")
    for digits, spelt in ((r"(\d\d)(\d\d)(\d\d)", "$1T$2:$3:$4"), (r"(\d\d):?(\d\d)", "$1T$2:$3:00"), (r"(\d\d)", "$1T$2:00:00")):
        t = F.regexp_replace(t, rf"^(\d{{4}}-\d\d-\d\d)[T ]{digits}(?=$|[Z.,+-])", spelt)
    t = F.when(t.rlike(r"^\d{4}-\d\d-\d\d$"), F.concat(t, F.lit("T00:00:00Z"))).when(t.rlike(r"(Z|[+-]\d\d:?\d\d)$"), t).otherwise(F.concat(t, F.lit("Z")))
    return F.when(t.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d"), F.unix_millis(F.try_to_timestamp(t)))


def utc_format(seconds: Column, pattern: str) -> Column:
    """Seconds since the epoch in UTC, whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(F.timestamp_micros((seconds * 1e6).cast("long")), F.current_timezone()), pattern)


def display_time(seconds: Column) -> Column:
    return F.concat(utc_format(seconds, "yyyy-MM-dd HH:mm"), F.lit(" UTC"))


def day_key(prefix: str, upstream: Column, seconds: Column) -> Column:
    """One session per upstream and UTC day."""
    return F.concat_ws(":", F.lit(prefix), upstream, utc_format(seconds, "yyyy-MM-dd"))


def short_hash(text: Column) -> Column:
    """31 * h + unit in signed 32 bits over the text's UTF-16 units, in base 36 with its sign."""
    wrap = lambda x: F.pmod(x + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("[0-9A-F]{4}"), F.lit(0))
    h = F.aggregate(F.transform(units, lambda u: F.conv(u, 16, 10).cast("long")), F.lit(0).cast("long"), lambda acc, c: wrap(acc * 31 + c))
    return F.concat(F.when(h < 0, "-").otherwise(""), F.lower(F.conv(F.abs(h).cast("string"), 10, 36)))


def safe_body(raw: Column, limit: int = BODY_BYTES) -> tuple[Column, Column]:
    """(text, format) of body bytes: cut at limit, wrong UTF-8 replaced, format json or text by its first character."""
    text = F.make_valid_utf8(F.coalesce(F.substring(raw.cast("binary"), F.lit(1), F.lit(limit)), F.lit(b"")).cast("string"))
    return text, F.when(text.rlike(r"^\s*[{\[]"), "json").otherwise("text")


def provider_of_host(host: Column) -> Column:
    """The provider of a host; the host itself where none is known, empty for none."""
    h, out = F.lower(F.coalesce(host, F.lit(""))), None
    for part, provider in HOST_PROVIDERS:
        out = F.when(h.contains(part), provider) if out is None else out.when(h.contains(part), provider)
    return out.otherwise(F.coalesce(host, F.lit("")))


def model_of_body(body: Column) -> Column:
    return F.get_json_object(body, "$.model")


def upgraded_event() -> list[Column]:
    """Columns of the newer event from the older capture's source_type, direction, body_json, body_format and headers_json."""
    direction = F.lower(F.trim(F.coalesce("direction", F.lit("pair"))))
    new_direction = F.when(direction.isin("request", "response"), direction).otherwise("pair")
    layer = F.try_element_at(F.create_map(*[F.lit(x) for kv in SOURCE_LAYERS.items() for x in kv]), F.lower(F.trim(F.coalesce("source_type", F.lit("")))))
    body, is_json = F.col("body_json"), F.lower(F.coalesce("body_format", F.lit("json"))) == "json"
    parsed = F.try_parse_json(body)
    kind = F.schema_of_variant(parsed)
    whole = F.when(kind.startswith("OBJECT"), F.to_json(parsed)).when(parsed.isNotNull(), F.concat(F.lit('{"value":'), F.to_json(parsed), F.lit("}")))
    as_text = F.to_json(F.struct(body.alias("text")))
    new_body = F.when(F.coalesce(body, F.lit("")) != "", F.coalesce(F.when(is_json, whole), as_text))
    headers = F.try_parse_json(F.coalesce("headers_json", F.lit("{}")))
    new_headers = F.when(F.schema_of_variant(headers).startswith("OBJECT"), F.to_json(headers))
    return [
        F.coalesce(layer, F.lit(DEFAULT_LAYER)).alias("source"),
        new_direction.alias("direction"),
        F.when(new_direction != "response", new_headers).alias("request_headers"), F.when(new_direction == "request", new_body).alias("request_body"),
        F.when(new_direction == "response", new_headers).alias("response_headers"), F.when(new_direction != "request", new_body).alias("response_body"),
    ]


def branch_id(conversation: Column, index: Column, role: Column, text: Column) -> Column:
    """conversation:branch:index and twelve digits of what the message says first."""
    return F.concat_ws(":", conversation, F.lit("branch"), index.cast("string"), F.left(F.sha1(F.concat_ws(":", role, F.substring(text, 1, 160)).cast("binary")), F.lit(12)))


def global_index(total: Column, n: Column, local: Column) -> Column:
    """Place in the whole conversation of a message in its last n."""
    return F.greatest(F.lit(0), total - n) + local
