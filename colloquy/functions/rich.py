"""Attachments and threading inside content JSON: reading, keys, merging and the render envelope.

Content JSON holds `attachments` (or, in envelopes, `rich_content.blocks` with the attachment as `data`) and `threading`.
Each function is a small helper per row, applied to Arrow batches; nothing is gathered.

Defined cases: null, malformed and non-object JSON has no attachments and no threading; of two attachments with one key
the first stays and takes from the second what it lacks; order is that of first sight.
"""

from __future__ import annotations

import json
from urllib.parse import parse_qs, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The properties that a block and an asset take over, and the kinds of asset.
BLOCK_FIELDS = "name title url file_id media_type source_type language code output alt detail text arguments transcript format content is_error".split()
ASSET_FIELDS = "name title url file_id media_type source_type format".split()
ASSET_KINDS = {"image_url": "image", "image_generation": "image", "file": "file", "document": "file", "audio": "audio"}
_EMPTY = (None, "", [], {})


def _loaded(text: str | None) -> dict:
    try:
        value = json.loads(text) if text else {}
    except ValueError:
        return {}
    return value if isinstance(value, dict) else {}


def attachments_of(text: str | None) -> list[dict]:
    data = _loaded(text)
    if isinstance(data.get("attachments"), list):
        listed = data["attachments"]
    else:
        rich = data.get("rich_content")
        blocks = rich.get("blocks") if isinstance(rich, dict) else None
        listed = [b.get("data") for b in blocks if isinstance(b, dict)] if isinstance(blocks, list) else []
    return [a for a in listed if isinstance(a, dict)]


def threading_of(text: str | None) -> dict:
    found = _loaded(text).get("threading")
    return {k: v for k, v in found.items() if v not in _EMPTY} if isinstance(found, dict) else {}


def file_id_of(attachment: dict) -> str:
    if attachment.get("file_id"):
        return str(attachment["file_id"])
    url = attachment.get("url")
    if not isinstance(url, str):
        return ""
    if url.startswith("sediment://file_"):
        return url.removeprefix("sediment://")
    try:
        named = parse_qs(urlsplit(url).query).get("id", [""])[0]
    except ValueError:
        return ""
    return named if named.startswith("file_") else ""


def key_of(attachment: dict) -> str:
    """What makes two attachments the same one: a file's id, else what its type is told apart by, else all of it."""
    kind = attachment.get("type", "")
    if file_id := file_id_of(attachment):
        return f"{kind}:file_id:{file_id}"
    telling = {"file": "name", "citation": "url", "image_url": "url"}.get(kind) if isinstance(kind, str) else None
    if telling and attachment.get(telling):
        return f"{kind}:{telling}:{attachment[telling]}"
    if kind == "code_block" and attachment.get("code"):
        return f"code_block:{attachment.get('language', '')}:{attachment['code']}"
    if kind == "tool_call" and (attachment.get("id") or attachment.get("name")):
        return f"tool_call:{attachment.get('id', '')}:{attachment.get('name', '')}"
    return json.dumps(attachment, ensure_ascii=False, sort_keys=True)


def joined(a: dict, b: dict) -> dict:
    """a with what it lacks from b; a reachable address replaces an internal one."""
    out = dict(a)
    for k, v in b.items():
        internal = k == "url" and str(out.get("url", "")).startswith("sediment://") and str(v).startswith("http")
        if v not in _EMPTY and (internal or out.get(k) in _EMPTY):
            out[k] = v
    return out


def envelope(attachments: list[dict], threading: dict, plain_text: str | None = None) -> str | None:
    """Content JSON with attachments, their blocks and assets, and threading; null if there is neither."""
    if not attachments and not threading:
        return None
    some = lambda a, fields: {k: a[k] for k in fields if a.get(k) not in _EMPTY}
    blocks = [{"type": str(a.get("type") or "unknown"), "attachment_index": i, "data": a} | some(a, BLOCK_FIELDS) for i, a in enumerate(attachments)]
    assets = [{"id": f"attachment:{i}", "kind": ASSET_KINDS[a["type"]], "attachment_index": i} | some(a, ASSET_FIELDS) for i, a in enumerate(attachments) if isinstance(a.get("type"), str) and a["type"] in ASSET_KINDS]
    rich = {"plain_text": plain_text or "", "blocks": blocks} | ({"assets": assets} if assets else {})
    return json.dumps({"attachments": attachments, "rich_content": rich} | ({"threading": threading} if threading else {}), ensure_ascii=False)


def merged_json(a: str | None, b: str | None) -> str | None:
    if not a or not b:
        return a or b
    kept: dict[str, dict] = {}
    for attachment in attachments_of(a) + attachments_of(b):
        key = key_of(attachment)
        kept[key] = joined(kept[key], attachment) if key in kept else attachment
    return envelope(list(kept.values()), threading_of(a) | threading_of(b)) or a


def merged_content(a: Column, b: Column) -> Column:
    """The content JSON of two views of one message."""

    @F.pandas_udf("string")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        text = lambda v: v if isinstance(v, str) else None
        return pd.Series([merged_json(text(p), text(q)) for p, q in zip(x, y)], dtype=object)

    return run(a, b)


def attachment_keys(c: Column) -> Column:
    """array<string>: the keys of a message's attachments, in order."""

    @F.pandas_udf("array<string>")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: [key_of(a) for a in attachments_of(v if isinstance(v, str) else None)])

    return run(c)
