"""Patch streams: operations, and the same messages from any split over batches."""

import json
import random

import pandas as pd
import pytest

from colloquy.plans.catalog_streams import available
from colloquy.streaming import patches as P

MODEL = {"message": {"author": {"role": "tool"}, "content": {"content_type": "text", "parts": [""]}, "metadata": {"model_slug": "m-1"}}, "conversation_id": "c9"}


def delta(**cells):
    return "delta", json.dumps(cells)


STREAM = [
    ("delta_encoding", '"v1"'), delta(p="", o="add", v=MODEL), delta(p="/message/content/parts/0", o="append", v="Hel"), delta(v="lo"), ("delta", "broken"), delta(v=", you"), (None, '{"type":"server_ste_metadata"}'),
    delta(p="", o="patch", v=[{"p": "/message/content/parts/0", "o": "append", "v": "!"}, {"p": "/message/metadata/resolved_model_slug", "o": "add", "v": "m-2"}]), delta(v=[{"p": "/message/status", "o": "replace", "v": "done"}]),
    (None, '{"type":"message_stream_complete"}'), delta(v="lost"), delta(p="", o="add", v={"message": {"content": {"content_type": "code", "text": "run"}}}), delta(p="/message/content/text", o="append", v="(1)"), (None, "[DONE]"), delta(p="", o="add", v=MODEL),
]
WANTED = {(0, "tool", "Hello, you!", "m-2", "c9"), (1, "assistant", "run(1)", None, None)}


def told(rows):
    return {(r.message, r.role, r.text, r.model, r.conversation_id) for r in rows}


def events(stream, said, order=None):
    base = pd.Timestamp("2024-01-01")
    return [(stream, i, *said[i], (base + pd.Timedelta(seconds=i % 5)).to_pydatetime()) for i in (order or range(len(said)))]


def tree_of(*steps):
    tree = P.Leaves()
    for step in steps:
        tree.patch(P.path_of(step[0]), *step[1:])
    return {"/".join(p): v for p, v in tree.items()}


def test_operations():
    assert tree_of(("", "add", {"a": {"b": [1, "x"]}}), ("/a/b/1", "append", "y"), ("/a/b", "append", {"c": None}), ("/a/b/0", "remove", None)) == {"a/b/0": "xy", "a/b/1/c": None}
    assert tree_of(("/l", "add", []), ("/l/0", "add", "p"), ("/l/5", "add", "far"), ("/l/name", "add", 1), ("/l/1/z", "add", 1)) == {"l/0": "p"}
    assert tree_of(("/l", "add", ["p"]), ("/l/0", "remove", None), ("/l", "append", "q")) == {"l/0": "q"}
    assert tree_of(("/a", "add", "text"), ("/a/b~1c", "add", 2), ("/n", "append", "new"), ("/n", "append", 3), ("/n", "unknown", 4), ("/x", "remove", None)) == {"a/b/c": 2, "n": 3}
    assert tree_of(("/a", "add", 1), ("", "replace", {}), ("", "append", "x")) == {"": {}}
    deep = json.loads("[" * 900 + "]" * 900)
    assert tree_of(("/a", "add", 1), ("/a/b", "add", {"x": deep})) in ({"a": 1}, {"a/b/x/" + "/".join("0" * 899): []})
    assert P.text_of(P.Leaves(P.leaves_of({"message": {"content": {"parts": ["a", {"text": "b"}, {"image": 1}, 3]}}}))) == "ab"


def test_folded(spark):
    rows = events("s", STREAM) + events("s", STREAM, [3, 3, 1]) + events("open", STREAM[:4]) + events("silent", [delta(v="x"), delta(p="", o="add", v={}), (None, None)])
    rows += [(None, 0, *STREAM[1], rows[0][4]), ("none", None, *STREAM[1], rows[0][4]), ("none", 1, *STREAM[1], None)]
    random.Random(1).shuffle(rows)
    got = P.folded(spark.createDataFrame(rows, P.EVENT)).collect()
    assert told(r for r in got if r.stream == "s") == WANTED and {r.stream for r in got} == {"s", "open"}
    assert {(r.stream, r.text, r.ended) for r in got} == {("s", "Hello, you!", "complete"), ("s", "run(1)", "complete"), ("open", "Hello", "expired")}
    assert P.folded(spark.createDataFrame([], P.EVENT)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_any_split(spark, tmp_path, seed):
    """Four batches in any order with replays, several streams: the newest rows are the batch's."""
    rng = random.Random(seed)
    rows = [e for s in ("a", "b") for e in events(s, STREAM)] + events("c", STREAM[:8])
    rng.shuffle(rows)
    cuts = sorted(rng.sample(range(1, len(rows)), 3))
    batches = [rows[i:j] for i, j in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch + rng.choices(rows[: cuts[min(n, 2)]], k=3), P.EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        available(P.folding(spark.readStream.schema(P.EVENT).parquet(f"{tmp_path}/in")), str(tmp_path))
    out = spark.read.schema(P.MESSAGE).parquet(f"{tmp_path}/out")
    got, whole = P.newest(out).collect(), P.folded(spark.createDataFrame(rows, P.EVENT)).collect()
    assert told(got) == told(whole) and told(r for r in got if r.stream == "a") == WANTED
    assert {(r.stream, r.ended, r.version) for r in got} == {("a", "complete", 14), ("b", "complete", 14), ("c", None, 8)}


def test_expiry_and_gap(spark, tmp_path):
    """A stream whose events 3 and 4 never come is closed with the rest when time has passed."""
    later = pd.Timestamp("2024-01-01 01:00:00").to_pydatetime()
    for batch in (events("gap", STREAM[:6], [0, 1, 2, 5]), [("other", 0, *STREAM[0], later)], [("other", 1, *STREAM[1], later)]):
        spark.createDataFrame(batch, P.EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        available(P.folding(spark.readStream.schema(P.EVENT).parquet(f"{tmp_path}/in")), str(tmp_path))
    got = [r for r in spark.read.schema(P.MESSAGE).parquet(f"{tmp_path}/out").collect() if r.stream == "gap"]
    assert [(r.text, r.ended) for r in sorted(got, key=lambda r: r.version)] == [("Hel", None), ("Hel, you", "expired")]


def test_events_of_bodies(spark):
    body = ': hi\r\nevent: delta\r\ndata: {"a":\r\ndata: 1}\r\n\r\n\r\ndata: [DONE]\n\nevent: none\n\ndata:x'
    got = P.events_of(spark.createDataFrame([("p", pd.Timestamp("2024-01-01").to_pydatetime(), body), ("q", None, None)], "pair_id string, ts timestamp, response string")).collect()
    assert [(r.seq, r.event, r.data) for r in got] == [(0, "delta", '{"a":\n1}'), (1, "", "[DONE]"), (2, "", "x")]
