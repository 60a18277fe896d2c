"""Shapes of JSON bodies and content JSON on literal rows."""

import json

from pyspark.sql import functions as F

from colloquy.functions import rich
from colloquy.operators import schemas


def shape(spark, *bodies):
    return schemas.shape_of(spark.createDataFrame([(b,) for b in bodies], "body string"), "body")


def test_shape(spark):
    got = {r.path: (r.types, r.n, r.required) for r in shape(spark, '{"a":1,"l":[{"x":1},{"x":null,"y":true}]}', '{"a":1.5,"l":[]}', "not json", None, "").collect()}
    assert got == {"$": ("object", 2, False), "$.a": ("integer,number", 2, True), "$.l": ("array", 2, True), "$.l[*]": ("object", 2, False), "$.l[*].x": ("integer,null", 2, True), "$.l[*].y": ("boolean", 1, False)}
    assert shape(spark).count() == 0


def test_changes(spark):
    old = shape(spark, '{"a":1,"gone":{"deep":1},"l":[1],"e":[]}', '{"a":2,"gone":{"deep":1},"may":1,"l":[],"e":[]}')
    new = shape(spark, '{"a":"s","l":["x"],"e":[{"p":1}],"more":{"in":1}}')
    got = {(r.kind, r.severity, r.path, r.expected, r.actual) for r in schemas.changed_shape(old, new).collect()}
    assert got == {
        ("changed_type", "hard", "$.a", "integer", "string"), ("removed_property", "hard", "$.gone", "object", None), ("removed_property", "soft", "$.may", "integer", None),
        ("changed_type", "hard", "$.l[*]", "integer", "string"), ("added_property", "soft", "$.more", None, "object"),
    }
    assert schemas.changed_shape(old, old).count() == 0


def test_content_json(spark):
    a = json.dumps({"attachments": [{"type": "file", "file_id": "file_1", "url": "sediment://file_1"}, {"type": "code_block", "code": "x", "language": ""}], "threading": {"branch_id": "b", "none": ""}})
    b = json.dumps({"rich_content": {"blocks": [{"data": {"type": "file", "url": "https://h/?id=file_1", "name": "n"}}, {"data": {"type": "audio", "url": "u"}}, {}]}, "threading": {"branch_id": "c"}})
    rows = [(1, a, b), (2, None, b), (3, a, None), (4, None, None), (5, "[1", "{}")]
    df = spark.createDataFrame(rows, "id int, a string, b string")
    got = {r.id: (r.m, r.k) for r in df.select("id", rich.merged_content(F.col("a"), F.col("b")).alias("m"), rich.attachment_keys(F.col("a")).alias("k")).collect()}
    merged = json.loads(got[1][0])
    assert merged["attachments"] == [{"type": "file", "file_id": "file_1", "url": "https://h/?id=file_1", "name": "n"}, {"type": "code_block", "code": "x", "language": ""}, {"type": "audio", "url": "u"}]
    assert merged["threading"] == {"branch_id": "c"} and [x["kind"] for x in merged["rich_content"]["assets"]] == ["file", "audio"]
    assert got[1][1] == ["file:file_id:file_1", "code_block::x"]
    assert [got[i][0] for i in (2, 3, 4, 5)] == [b, a, None, "[1"] and got[4][1] == []
