"""Folds ask for state a few times per key and batch, not for each event or message."""

import collections
import json

import pandas as pd
from pyspark.sql import Row

from colloquy.streaming import pairing, patches, store


class Kept:
    """A state variable that counts what is asked of it."""

    def __init__(self, calls):
        self.calls, self.value, self.map, self.list = calls, None, {}, []

    def __getattribute__(self, name):
        if name in ("calls", "value", "map", "list"):
            return object.__getattribute__(self, name)
        self.calls[name] += 1
        return object.__getattribute__(self, name)

    def exists(self):
        return self.value is not None or bool(self.map) or bool(self.list)

    def get(self):
        return iter(list(self.list)) if self.value is None else self.value

    def update(self, value):
        self.value = value

    def put(self, rows):
        self.list[:] = rows

    def iterator(self):
        return iter(list(self.map.items()))

    def getValue(self, key):
        return self.map[key]

    def containsKey(self, key):
        return key in self.map

    def updateValue(self, key, value):
        self.map[key] = value

    def removeKey(self, key):
        del self.map[key]

    def clear(self):
        self.value = None
        self.map.clear()
        self.list.clear()


class Handle:
    def __init__(self):
        self.calls = collections.Counter()

    def getValueState(self, *_):
        return Kept(self.calls)

    getMapState = getListState = getValueState

    def registerTimer(self, at):
        self.calls["registerTimer"] += 1


def test_folding_of_many_early_events():
    handle, fold = Handle(), patches.Folding(120.0)
    fold.init(handle)
    said = [("delta", json.dumps({"p": "", "o": "add", "v": {"message": {"content": {"parts": [""]}}}})), ("delta", json.dumps({"p": "/message/content/parts/0", "o": "append", "v": "x"}))] + [("delta", '{"v": "y"}')] * 998
    rows = [{"seq": i, "event": e, "data": d, "seconds": 1.0} for i, (e, d) in enumerate(said)]
    assert list(fold.handleInputRows(("s",), iter(rows[501:]), None)) == []
    got = list(fold.handleInputRows(("s",), iter(rows[:501]), None))
    assert [r["text"] for r in got] == ["x" + "y" * 998] and sum(handle.calls.values()) < 20


def test_a_session_is_read_at_once():
    handle, fold = Handle(), store.SessionFold()
    fold.init(handle)
    message = lambda i: {"role": "user", "text": f"text {i}", "ts": 1.0 + i} | dict.fromkeys(("content_json", "model_name", "token_estimate", "parent_uuid"))
    result = Row(session_key="s", pair_id="p", source_id="x", created_via="x", created_at=1.0, provider="x", tool_family="api", title_hint="t", messages=[Row(**message(i)) for i in range(200)])
    assert len(list(fold.handleInputRows(("key:s",), iter([result]), None))) == 201
    assert handle.calls["updateValue"] == 201 and sum(handle.calls.values()) < 210
    handle.calls.clear()
    assert list(fold.handleInputRows(("key:s",), iter([result, result]), None)) == [] and sum(handle.calls.values()) < 10


def test_exchanges_within_a_batch_leave_state_alone():
    handle, fold = Handle(), pairing.Pairing(30.0, 1000, False)
    fold.init(handle)
    rows = [(i, s, k, pd.Timestamp(1_700_000_000 + i, unit="s"), False, False, "h", None) for i in range(300) for s, k in ((0, "request"), (1, "response"))]
    frame = pd.DataFrame(rows + [(999, 0, "request", pd.Timestamp(1_700_000_300, unit="s"), False, False, None, "b")], columns="stream seq kind ts is_http2 end_stream host body".split())
    (got,) = fold.handleInputRows(("c",), iter([frame]), None)
    assert list(got["outcome"]) == ["pair"] * 300 and sum(handle.calls.values()) < 5
