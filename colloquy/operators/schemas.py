"""Shapes of JSON bodies over a whole table, and what changed between two of them.

A shape is a table of paths (`$`, `$.a`, `$.a[*].b`), so it is merged by a grouped sum and compared by a join on the
path; each task sums its own batches first, and nothing is gathered.

Defined cases: null and malformed bodies have no paths; an empty table has an empty shape; empty lists have no item
path; a value of several types has all of them in `types`, sorted; repeated bodies count as often as they come.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SCHEMA = "path string, parent string, type string, k long"


def paths_of(value: object) -> Iterator[tuple[str, str | None, str]]:
    """(path, path of what holds it, type) of a value and all inside it."""
    stack: list[tuple[str, str | None, object]] = [("$", None, value)]
    while stack:
        path, parent, v = stack.pop()
        if isinstance(v, dict):
            yield path, parent, "object"
            stack += [(f"{path}.{k}", path, x) for k, x in v.items()]
        elif isinstance(v, list):
            yield path, parent, "array"
            stack += [(f"{path}[*]", path, x) for x in v]
        else:
            kind = "null" if v is None else "boolean" if isinstance(v, bool) else "integer" if isinstance(v, int) else "number" if isinstance(v, float) else "string"
            yield path, parent, kind


def shape_of(df: DataFrame, body: str) -> DataFrame:
    """path, types (comma-joined), n (occurrences), required: whether every object that can hold the property has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for text in batch.column(0).to_pylist():
                try:
                    found.update(paths_of(json.loads(text)) if text else ())
                except (ValueError, RecursionError):
                    continue
            rows = [(*key, k) for key, k in found.items()]
            columns = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64()))], ["path", "parent", "type", "k"])

    counted = df.select(F.col(f"`{body}`").cast("string").alias("body")).mapInArrow(run, _SCHEMA).groupBy("path", "parent", "type").agg(F.sum("k").alias("k"))
    shape = counted.groupBy("path", "parent").agg(F.array_join(F.sort_array(F.collect_set("type")), ",").alias("types"), F.sum("k").alias("n"))
    holders = counted.where("type = 'object'").select(F.col("path").alias("parent"), F.col("k").alias("holders"))
    return shape.join(holders, "parent", "left").select("path", "parent", "types", "n", F.coalesce(F.col("n") >= F.col("holders"), F.lit(False)).alias("required"))


def changed_shape(old: DataFrame, new: DataFrame) -> DataFrame:
    """kind, severity, path, expected, actual between two results of `shape_of`.

    Another type is a hard change, a new property a soft one, and a property that went is hard if it was required. What
    hangs on a property that came, went or changed its type is not listed again; nor are the items of a list that was
    empty on one side.
    """
    a = old.select("path", F.col("parent").alias("old_parent"), F.col("types").alias("expected"), "required")
    b = new.select("path", F.col("parent").alias("new_parent"), F.col("types").alias("actual"))
    both = a.join(b, "path", "full_outer").withColumn("parent", F.coalesce("old_parent", "new_parent"))
    same = both.where("expected = actual").select(F.col("path").alias("parent"))
    moved = both.where("expected is null or actual is null or expected <> actual").where("not (path like '%[*]' and (expected is null or actual is null))")
    kind = F.when(F.col("expected").isNull(), "added_property").when(F.col("actual").isNull(), "removed_property").otherwise("changed_type")
    severity = F.when(F.col("expected").isNull(), "soft").when(F.col("actual").isNull() & ~F.col("required"), "soft").otherwise("hard")
    top = moved.where("parent is null").unionByName(moved.join(same, "parent", "left_semi").select(moved.columns))
    return top.select(kind.alias("kind"), severity.alias("severity"), "path", "expected", "actual")
