"""Drafts with their texts replaced, and fingerprints of pages."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colloquy.functions import convert as V
from colloquy.functions import text as T

JSON = st.recursive(st.one_of(st.none(), st.integers(), st.text(max_size=20), st.sampled_from(['"text":"x"', 'a\\', '\\"', '"text": ', "text"])), lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(st.sampled_from(["text", "a", '"text"', "texts", "x\\"]), x, max_size=3)), max_leaves=12)


def replaced(value):
    if isinstance(value, dict):
        return {k: "[redacted]" if k == "text" and isinstance(v, str) else replaced(v) for k, v in value.items()}
    return [replaced(v) for v in value] if isinstance(value, list) else value


def test_drafts(spark):
    """Against a walk of the parsed value, however the JSON is spelt."""
    values = []

    @settings(max_examples=300, deadline=None, database=None)
    @given(JSON)
    def keep(value):
        values.append(value)

    keep()
    values += [{"text": "x" * 300_000 + '\\"' * 50_000}, {"text": ""}, {"a": {"text": ["text", {"text": "\n"}]}}]
    rows = [(i, json.dumps(v, ensure_ascii=i % 2 == 0, indent=1 if i % 3 == 0 else None)) for i, v in enumerate(values)] + [(-1, None), (-2, "no json"), (-3, "")]
    rows = [(i, t) for i, t in rows if t is None or not any("\ud800" <= c <= "\udfff" for c in t)]
    got = dict(spark.createDataFrame(rows, "i int, t string").select("i", T.drafts_redacted(F.col("t"))).collect())
    assert (got.pop(-1), got.pop(-2), got.pop(-3)) == (None, "no json", "")
    assert all(json.loads(t) == replaced(values[i]) for i, t in got.items()) and len(got) > 250


def test_page_fingerprint(spark):
    attachment = "struct<type:string,file_id:string,url:string,name:string,title:string,language:string,code:string,output:string>"
    none = (None,) * 8
    rows = [
        (1, [("user", "a" * 200, None), (None, None, [("image", "", "u", "n", None, None, None, None), none, None]), ("", "x", [(None, None, None, None, None, None, "c" * 100, "o")])]),
        (2, []), (3, None), (4, [("user", "b" * 159 + "😀z", []), ("user", "😀" * 100, None)]), (5, [None]),
    ]
    got = dict(spark.createDataFrame(rows, f"i int, m array<struct<role:string,content:string,attachments:array<{attachment}>>>").select("i", T.page_fingerprint(F.col("m"))).collect())
    assert got == {1: f"user:{'a' * 160}:|unknown::image:u,unknown:|unknown:x:unknown:{'c' * 80}", 2: "", 3: "", 4: f"user:{'b' * 159}:|user:{'😀' * 80}:", 5: "unknown::"}


def test_iso_times(spark):
    """Extended and compact forms, zones, dates alone, and what is no time."""
    midnight = 1704067200000
    wanted = {
        "20240101T000000Z": midnight, "20240101": midnight, "2024-01-01": midnight, "20240101T0000": midnight, "2024-01-01T00": midnight, "20240101 010203.250Z": midnight + 3723250, "20240101T010000+0100": midnight, "2024-01-01T00:00:00.5": midnight + 500,
        "20240101T010000-01:00": midnight + 7200000, " 2024-01-01 00:00 ": midnight, "2024": None, "20241301": None, "20240101T250000": None, "1704067200": None, "": None, "x": None,
    }
    got = dict(spark.createDataFrame(list(wanted.items()), "t string, ms long").select("t", V.iso_to_ms(F.col("t"))).collect())
    assert got == wanted and spark.range(1).select(V.iso_to_ms(F.lit(None).cast("string"))).first()[0] is None
