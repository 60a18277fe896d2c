"""The source of growing files, and pairing with expiry against a loop."""

import datetime
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from colloquy.sources import tail
from colloquy.streaming import pairing

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def put(path, text, mode="a"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode, newline="") as f:
        f.write(text)


@pytest.mark.parametrize("part_bytes", [1, 7, 64, 1 << 20])
def test_ranges_hold_each_line_once(tmp_path, part_bytes):
    rng = random.Random(part_bytes)
    lines = ["é" * rng.randrange(30) + str(i) if rng.random() < 0.9 else "" for i in range(300)]
    put(f"{tmp_path}/x/a.jsonl", "\n".join(lines) + "\npartial")
    files = tail.Files({"path": f"{tmp_path}/x", "suffix": ".jsonl"})
    parts = tail.ranges(tail.appended({}, files.offset()), part_bytes)
    got = [r for p in parts for r in files.lines(p)]
    assert [r[2] for r in got] == [x for x in lines if x]
    raw = open(f"{tmp_path}/x/a.jsonl", "rb").read()
    assert all(raw[at : at + len(x.encode())].decode() == x for _, at, x in got)
    assert tail.Files({"path": f"{tmp_path}/none"}).offset() == {}


def test_appended():
    old = {"a": ["h1", 10], "b": ["h2", 20], "c": ["h3", 30]}
    assert tail.appended(old, old) == []
    assert tail.appended(old, old | {"a": ["h1", 15]}) == [("a", 10, 15)]
    assert tail.appended(old, {"a": ["h9", 4], "a.1": ["h1", 12], "b": ["h2", 5]}) == [("a", 0, 4), ("a.1", 10, 12), ("b", 0, 5)]
    assert tail.appended(old, old | {"d": ["h1", 8]}) == [("d", 0, 8)]


def test_a_growing_folder(spark, tmp_path):
    tail.register(spark)
    root, sink, log = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/in/local_0123456789abcdef0123456789abcdef/log.jsonl"

    def scan():
        lines = spark.readStream.format("growing_lines").option("path", root).option("suffix", "l").option("partBytes", 40).load()
        lines.writeStream.format("parquet").option("path", sink).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
        return sorted((os.path.basename(r.file), r.line) for r in spark.read.schema(tail.SCHEMA).parquet(sink).collect())

    put(log, '{"uuid": "1", "sessionId": "s"}\n{"type": "title"}\n{"uu')
    first = [("log.jsonl", '{"type": "title"}'), ("log.jsonl", '{"uuid": "1", "sessionId": "s"}')]
    assert scan() == first and scan() == first
    put(log, 'id": "2"}\r\nnot json\n[1]\n')
    put(f"{root}/more.jsonl", '{"uuid": "3"}\n\n')
    put(f"{root}/other.txt", "no\n")
    second = scan()
    assert len(second) == 6 and ("log.jsonl", '{"uuid": "2"}') in second
    os.rename(log, f"{tmp_path}/in/log.1.jsonl")
    put(f"{tmp_path}/in/log.1.jsonl", '{"uuid": "4"}\n')
    put(log, '{"uuid": "5"}\n')
    third = scan()
    assert sorted(set(third) - set(second)) == [("log.1.jsonl", '{"uuid": "4"}'), ("log.jsonl", '{"uuid": "5"}')] and len(third) == 8
    batch = spark.read.format("growing_lines").option("path", root).load()
    assert batch.count() == 8 + 1
    records = tail.transcript_lines(spark.read.schema(tail.SCHEMA).parquet(sink))
    rows = {r.body: r for r in records.collect()}
    assert len(rows) == 6 and rows['{"uuid": "1", "sessionId": "s"}'].session_id == "s" and rows['{"uuid": "5"}'].session_id == "0123456789abcdef0123456789abcdef"
    assert rows['{"type": "title"}'].line_uuid is None and rows['{"type": "title"}'].line_type == "title" and len({r.fingerprint for r in rows.values()}) == 6
    seen = records.where("line_uuid is null")
    assert tail.unseen(records.unionByName(records), seen).count() == 5 and tail.unseen(records, records).count() == 0


def looped(events, ttl, most, until, known_hosts_only=False):
    """Every connection's exchanges by a plain loop; until: the time up to which expiry is known."""
    out = []
    for connection in {e[0] for e in events}:
        pending = {}

        def send(stream):
            e = pending.pop(stream)
            out.append((connection, stream, "orphan_request" if e["answered"] is None else "pair", e["asked"], e["answered"], e["host"], e["question"], e["answer"]))

        def sweep(now):
            for stream in [s for s, e in pending.items() if e["last"] + ttl < now]:
                send(stream)

        for _, stream, seq, kind, ts, http2, ended, host, body in sorted((e for e in events if e[0] == connection), key=lambda e: (e[4], e[2])):
            sweep(ts)
            e = pending.get(stream)
            if kind == "request":
                pending.pop(stream, None)
                pending[stream] = {"last": ts, "order": seq, "asked": ts, "answered": None, "host": host, "question": body, "answer": None}
                if len(pending) > most:
                    send(min(pending, key=lambda s: (pending[s]["last"], pending[s]["order"], s)))
            elif kind == "response" and e is None:
                if not known_hosts_only:
                    out.append((connection, stream, "orphan_response", None, ts, host, None, body))
            elif kind == "response":
                e["answered"], e["last"], e["answer"] = ts, ts, e["answer"] or body
                if ended or not http2:
                    send(stream)
            elif kind == "data" and e is not None:
                e["answer"], e["last"] = body or e["answer"], ts
                if ended and e["answered"] is not None:
                    send(stream)
        sweep(until)
    return sorted(out, key=str)


@pytest.mark.parametrize("most,known", [(1000, False), (2, True)])
def test_pairing(spark, tmp_path, most, known):
    rng = random.Random(most)
    events, now = [], 1_700_000_000.0
    for seq in range(400):
        now += rng.choice([0.0, 0.5, 1.0, 3.0, 9.0])
        kind, http2 = rng.choice(["request", "request", "response", "data"]), rng.random() < 0.6
        events.append((f"c{rng.randrange(3)}", rng.randrange(6), seq, kind, now, http2, rng.random() < 0.5, rng.choice(["h", None]), rng.choice([None, "body", "x" * 50])))
    source, sink = f"{tmp_path}/in", f"{tmp_path}/out"
    stamped = lambda part: [(*e[:4], datetime.datetime.fromtimestamp(e[4], datetime.timezone.utc), *e[5:]) for e in part]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        for part in (events[:150], events[150:151], events[151:]):
            spark.createDataFrame(stamped(part), pairing.EVENT).coalesce(1).write.mode("append").parquet(source)
            found = pairing.paired_exchanges(spark.readStream.schema(pairing.EVENT).parquet(source), 30.0, most, "10 seconds", known)
            found.writeStream.format("parquet").option("path", sink).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted(map(tuple, spark.read.parquet(sink).collect()), key=str)
    want = looped(events, 30.0, most, now - 10, known)
    assert got == want and {r[2] for r in got} >= {"pair", "orphan_request"} and len(got) > 50
