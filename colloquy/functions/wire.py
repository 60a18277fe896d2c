"""Binary messages without their schema: the fields that the wire format itself tells, and what is read from them.

`fields` walks messages level by level: all messages of one depth, of all rows of an Arrow batch, are read together, a
field each a step, in numpy. A value with a length is taken

* as text, if it is UTF-8 without control characters (line ends and tabs are none, unless it begins with one);
* else as a nested message, if it reads as fields to its last byte;
* else as text, if it is UTF-8, and as bytes (lower-case hexadecimal) if it isn't.

No schema can tell these apart for certain: a nested message that is printable throughout is read as text.

Defined cases: a null body has null fields, an empty one none. Bodies may come in frames (a zero byte and a length of
four bytes each). A body that breaks off or turns invalid gives the fields before. Groups (long deprecated) count as invalid.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = "array<struct<path:string,kind:string,number:long,text:string>>"

# Names of models, identifiers, and what marks text that is no prompt or answer.
MODEL = r"\b(swe-[\w.-]+|claude-[\w.-]+|gpt-[\w.-]+|kimi-[\w.-]+|deepseek-[\w.-]+|gemini-[\w.-]+|adaptive[\w.-]*|copilot[\w.-]*|o[134]-[\w.-]+)\b"
IDENTIFIER = r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
REQUEST = r"(?s)<user_request>(.*?)</user_request>"
READABLE = r"[\x20-\x7e\u4e00-\u9fff\u3000-\u303f]"

_VARINT, _EIGHT, _SIZED, _FOUR = 0, 1, 2, 5
_NUMERIC = {_VARINT: "varint", _EIGHT: "fixed64", _FOUR: "fixed32"}


def _varints(data: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Value, place behind, and whether it is one, of the variable-length number at each place."""
    value = np.zeros(len(at), np.uint64)
    at, open_ = at.copy(), np.ones(len(at), bool)
    for shift in range(0, 70, 7):
        here = np.flatnonzero(open_ & (at < end))
        if not len(here):
            break
        byte = data[at[here]].astype(np.uint64)
        value[here] |= (byte & np.uint64(127)) << np.uint64(shift)
        at[here] += 1
        open_[here] = byte > 127
    return value, at, ~open_


def _level(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All fields (span, number of the field, kind, value, begin, end) of the spans, and whether each span is whole."""
    at, whole, found = begin.copy(), np.ones(len(begin), bool), []
    live = np.flatnonzero(at < end)
    while len(live):
        tag, after, ok = _varints(data, at[live], end[live])
        kind, stop = (tag & np.uint64(7)).astype(np.int64), end[live]
        number = (tag >> np.uint64(3)).astype(np.int64)
        ok &= (number > 0) & (number < 1 << 29) & np.isin(kind, (_VARINT, _EIGHT, _SIZED, _FOUR))
        read = np.isin(kind, (_VARINT, _SIZED))
        value, behind, fine = _varints(data, after, np.where(read, stop, after))
        ok &= ~read | fine
        start = np.where(kind == _SIZED, behind, after)
        length = np.where(kind == _SIZED, np.minimum(value, np.uint64(len(data) + 1)).astype(np.int64), np.where(kind == _EIGHT, 8, np.where(kind == _FOUR, 4, behind - after)))
        finish = start + length
        ok &= finish <= stop
        found.append(np.stack([live, number, kind, value.astype(np.int64), start, finish], 1)[ok])
        whole[live[~ok]] = False
        at[live] = finish
        live = live[ok & (finish < stop)]
    return (np.concatenate(found) if found else np.zeros((0, 6), np.int64)), whole


def _frames(body: bytes) -> list[tuple[int, int]]:
    """The messages of a body: its frames, or all of it."""
    at, out = 0, []
    while at + 5 <= len(body) and body[at] == 0:
        end = at + 5 + int.from_bytes(body[at + 1 : at + 5], "big")
        if end > len(body):
            return [*out, (at + 5, len(body))]
        out.append((at + 5, end))
        at = end
    return out if out and at == len(body) else [(0, len(body))]


def _text(raw: bytes) -> tuple[str | None, bool]:
    """The text that the bytes are, if any, and whether it is plain: without control characters."""
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return None, False
    return text, (not text or text[0] >= " ") and not any(c < " " and c not in "\t\n\r" or c == "\x7f" for c in text)


def walk(bodies: list[bytes]) -> list[list[tuple[str, str, int | None, str | None]]]:
    """The fields (path, kind, number, text) of each body, in its order."""
    joined = b"".join(bodies)
    data = np.frombuffer(joined, np.uint8)
    spans, base = [], 0
    for i, body in enumerate(bodies):
        spans += [(i, "", base + b, base + e) for b, e in _frames(body)]
        base += len(body)
    out: list[list[tuple]] = [[] for _ in bodies]
    tentative: dict[int, str] = {}
    depth = 0
    while spans:
        begin, end = (np.array([s[k] for s in spans], np.int64) for k in (2, 3))
        found, whole = _level(data, begin, end)
        deeper, kept = [], {}
        for span, number, kind, value, start, finish in found.tolist():
            row, above = spans[span][:2]
            if depth and not whole[span]:
                continue
            path = f"{above}.{number}" if above else str(number)
            if kind == _SIZED:
                text, plain = _text(joined[start:finish])
                if plain:
                    out[row].append((start, path, "text", None, text))
                else:
                    deeper.append((row, path, start, finish))
                    kept[len(deeper) - 1] = text
            else:
                number_of = value if kind == _VARINT else int.from_bytes(joined[start:finish], "little", signed=True)
                out[row].append((start, path, _NUMERIC[kind], number_of, None))
        if depth:
            for i in np.flatnonzero(~whole).tolist():
                row, path, start, finish = spans[i]
                text = tentative[i]
                out[row].append((start, path, "bytes", None, joined[start:finish].hex()) if text is None else (start, path, "text", None, text))
        spans, tentative, depth = deeper, kept, depth + 1
    return [[f[1:] for f in sorted(fs, key=lambda f: f[0])] for fs in out]


def fields(body: Column) -> Column:
    """The fields of a binary message, nested ones by their path (numbers from the outside in)."""

    def run(bodies: pd.Series) -> pd.Series:
        there = bodies.notna()
        out = pd.Series([None] * len(bodies), index=bodies.index, dtype=object)
        names = ("path", "kind", "number", "text")
        for i, found in zip(bodies.index[there], walk([bytes(b) for b in bodies[there]]), strict=True):
            out[i] = [dict(zip(names, f, strict=True)) for f in found]
        return out

    return F.pandas_udf(run, FIELDS)(body)


def texts(found: Column, least: int = 5) -> Column:
    """The texts among fields, in order, of at least so many characters."""
    return F.transform(F.filter(found, lambda f: (f["kind"] == "text") & (F.length(f["text"]) >= least)), lambda f: f["text"])


def readable_runs(text: Column, least: int = 5) -> Column:
    """Readable runs of a body that was stored as text, its other bytes replaced, so that no walk is possible."""
    return F.regexp_extract_all(text, F.lit(f"{READABLE}{{{least},}}"), F.lit(0))


def _first(strings: Column, pattern: str, group: int) -> Column:
    return F.get(F.filter(F.transform(strings, lambda s: F.regexp_extract(s, pattern, group)), lambda s: s != ""), F.lit(0))


def model_name(strings: Column) -> Column:
    return _first(strings, MODEL, 1)


def identifier(strings: Column) -> Column:
    return _first(strings, IDENTIFIER, 0)


# What text of the host program, of files and of machines holds.
NO_PROMPT = [
    "windsurf", "windows", "chisel", "codeium", "devin", "intel", "genuineintel", "appdata", "file:///", "redacted", ".py", ".ts", ".md", "http", "version", "numcores", "numsockets", "numthreads", "vendorid",
    "productname", "majorversion", "minorversion", "memory", "build", "arch", "amd64", "resource_exhausted", "error", "failed",
]


_NO_PROMPT = "|".join([rf"^{MODEL}", f"^{IDENTIFIER}", "^[0-9a-f]{20,}$", r"^\$", *[f"(?i:{re.escape(w)})" for w in NO_PROMPT]])


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once; what a lambda names from outside would be worked out for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _most_often(strings: Column) -> Column:
    """The string that comes most often, twice at least; of those the longest, then the last in code point order. Sorts once."""

    def of(ordered: Column) -> Column:
        n = F.size(ordered)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))
        runs = lambda at: F.transform(at, lambda a, i: F.struct((F.coalesce(F.get(at, i + 1), n) - a).alias("n"), F.length(F.get(ordered, a)).alias("length"), F.get(ordered, a).alias("text")))
        return F.when(n > 0, F.array_max(F.filter(_bound(starts, runs), lambda c: c["n"] >= 2))["text"])

    return _bound(F.array_sort(strings), of)


def prompt(strings: Column) -> Column:
    """What the user asked: a marked request, else the text that comes most often and isn't the program's own."""
    usual = F.transform(strings, lambda s: F.trim(F.regexp_replace(F.trim(s), '"+$', "")))
    asked = F.filter(usual, lambda s: (F.length(s) >= 3) & ~s.rlike(_NO_PROMPT))
    return F.coalesce(F.nullif(F.trim(_first(strings, REQUEST, 1)), F.lit("")), _most_often(asked))


def summaries(messages: DataFrame, body: str = "body") -> DataFrame:
    """messages with fields, strings, model_name, identifier and prompt; no shuffle."""
    read = messages.withColumn("fields", fields(F.col(body))).withColumn("strings", texts(F.col("fields")))
    return read.select("*", model_name(F.col("strings")).alias("model_name"), identifier(F.col("strings")).alias("identifier"), prompt(F.col("strings")).alias("prompt"))
