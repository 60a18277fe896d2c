"""Requests and responses of connections, paired in state with event-time expiry.

Events are what was seen on the wire of a connection, in its order: `request` and `response` heads and `data`, each of
a stream of the connection. Per stream one exchange is pending at most:

* a request makes it pending (a later request of the stream takes its place);
* a response ends it at once, but for HTTP/2 without end of stream: there the body is still to come;
* data replaces the body that is known so far (the last piece holds all of it), and with end of stream ends an exchange
  that has its response; data without an exchange is dropped;
* a response without a request is emitted as an orphan, unless only known hosts count;
* an exchange that nothing came to for `ttl` seconds is emitted with what it has: as a pair if the response is there,
  else as an orphan request. Timers see to it when the watermark passes;
* of more than `most` pending exchanges of a connection the oldest goes, as an orphan request if it has no response. One
  that waits for its body is emitted as a pair: its response isn't lost.

State is a map by stream, never larger than `most`. A connection's events of one batch are taken by ts, then seq.
Null bodies are no bodies; null flags are false; events of an unknown kind are dropped, as are those without ts.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TTL = 30.0
MOST = 1000
EVENT = "connection string, stream long, seq long, kind string, ts timestamp, is_http2 boolean, end_stream boolean, host string, body string"
PENDING = "seq long, at double, request_at double, response_at double, host string, request_body string, response_body string, is_http2 boolean"
EXCHANGE = "connection string, stream long, outcome string, request_at double, response_at double, host string, request_body string, response_body string"
_FIELDS = [f.split()[0] for f in PENDING.split(", ")]


class Exchanges:
    """The pending exchanges of one connection, and what is emitted of them."""

    def __init__(self, pending: dict[int, dict], ttl: float, most: int, known_hosts_only: bool):
        self.pending, self.ttl, self.most, self.known_hosts_only = pending, ttl, most, known_hosts_only
        self.out: list[tuple] = []
        self.stored = set(pending)
        self.touched: set[int] = set()
        #: Pending exchanges by age; those that changed since are passed over.
        self.ages = [(e["at"], e["seq"], s) for s, e in pending.items()]
        heapq.heapify(self.ages)

    def oldest(self) -> tuple[float, int, int] | None:
        while self.ages:
            at, seq, stream = self.ages[0]
            entry = self.pending.get(stream)
            if entry is not None and entry["at"] == at and entry["seq"] == seq:
                return self.ages[0]
            heapq.heappop(self.ages)
        return None

    def keep(self, stream: int) -> None:
        entry = self.pending[stream]
        self.touched.add(stream)
        heapq.heappush(self.ages, (entry["at"], entry["seq"], stream))

    def emit(self, stream: int, entry: dict) -> None:
        kind = "pair" if entry["request_at"] is not None and entry["response_at"] is not None else "orphan_request" if entry["request_at"] is not None else "orphan_response"
        self.out.append((stream, kind, *(entry[k] for k in ("request_at", "response_at", "host", "request_body", "response_body"))))

    def expire(self, now: float) -> None:
        while (first := self.oldest()) is not None and now - first[0] > self.ttl:
            self.emit(first[2], self.pending.pop(first[2]))

    def take(self, event: dict) -> None:
        self.expire(event["ts"])
        stream, ts, entry = event["stream"], event["ts"], self.pending.get(event["stream"])
        if event["kind"] == "request":
            self.pending[stream] = {"seq": event["seq"], "at": ts, "request_at": ts, "response_at": None, "host": event["host"], "request_body": event["body"], "response_body": None, "is_http2": event["is_http2"]}
            self.keep(stream)
            while len(self.pending) > self.most:
                oldest = self.oldest()[2]
                self.emit(oldest, self.pending.pop(oldest))
        elif event["kind"] == "response":
            if entry is None:
                if not self.known_hosts_only:
                    self.emit(stream, {"request_at": None, "response_at": ts, "host": event["host"], "request_body": None, "response_body": event["body"]})
                return
            entry |= {"response_at": ts, "at": ts, "response_body": entry["response_body"] or event["body"]}
            if not event["is_http2"] or event["end_stream"]:
                self.emit(stream, self.pending.pop(stream))
            else:
                self.keep(stream)
        elif event["kind"] == "data" and entry is not None:
            entry |= {"response_body": event["body"] or entry["response_body"], "at": ts}
            if event["end_stream"] and entry["response_at"] is not None:
                self.emit(stream, self.pending.pop(stream))
            else:
                self.keep(stream)


class Pairing(StatefulProcessor):
    def __init__(self, ttl: float, most: int, known_hosts_only: bool):
        self.rules = (ttl, most, known_hosts_only)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getMapState("pending", "stream long", PENDING)

    def exchanges(self) -> Exchanges:
        clean = lambda v: None if v is None or isinstance(v, float) and v != v else v
        return Exchanges({int(k[0]): {n: clean(x) for n, x in zip(_FIELDS, v)} for k, v in self.state.iterator()}, *self.rules)

    def saved(self, key: tuple, now: Exchanges) -> pd.DataFrame:
        # Most exchanges begin and end in one batch: state never knew them.
        for stream in now.stored - now.pending.keys():
            self.state.removeKey((stream,))
        for stream in now.touched & now.pending.keys():
            entry = now.pending[stream]
            self.state.updateValue((stream,), tuple(entry[n] for n in _FIELDS))
            self.handle.registerTimer(int((entry["at"] + now.ttl) * 1000) + 1)
        names = [f.split()[0] for f in EXCHANGE.split(", ")]
        return pd.DataFrame([(key[0], *x) for x in now.out], columns=names, dtype=object)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        now = self.exchanges()
        events = pd.concat(list(rows)).sort_values(["ts", "seq"], kind="stable")
        for stream, seq, kind, ts, http2, ended, host, body in zip(*(events[c] for c in ("stream", "seq", "kind", "ts", "is_http2", "end_stream", "host", "body")), strict=True):
            host, body = (c if isinstance(c, str) else None for c in (host, body))
            now.take({"stream": int(stream), "seq": int(seq), "kind": kind, "ts": ts.timestamp(), "is_http2": bool(http2), "end_stream": bool(ended), "host": host, "body": body})
        yield self.saved(key, now)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        now = self.exchanges()
        now.expire(expiredTimerInfo.getExpiryTimeInMs() / 1000)
        yield self.saved(key, now)


def paired_exchanges(events: DataFrame, ttl: float = TTL, most: int = MOST, lateness: str = "10 seconds", known_hosts_only: bool = False) -> DataFrame:
    """EXCHANGE rows of a stream of events (EVENT), each when it ends or expires."""
    known = events.where("ts is not null and stream is not null and kind in ('request', 'response', 'data')").withColumn("seq", F.coalesce("seq", F.lit(0))).withColumns({c: F.coalesce(c, F.lit(False)) for c in ("is_http2", "end_stream")})
    return known.withWatermark("ts", lateness).groupBy("connection").transformWithStateInPandas(Pairing(ttl, most, known_hosts_only), EXCHANGE, "append", "eventTime")
