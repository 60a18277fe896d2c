"""Messages that arrive as patches, put together across micro-batches.

An event stream of patches tells a tree piece by piece: `delta` events with a path (p), an operation (o) and a value (v),
where what is left out is that of the event before. An addition at the root begins a new message, and an event of type
`message_stream_complete` ends one; `[DONE]` ends the stream.

A message is kept as its leaves, by path, and a batch writes the messages that it touched, one value each. Events
are applied in the order of seq (0, 1, ...), however they arrive: one that comes early waits in state, and one that was
applied before is dropped. So any split of a stream over batches, in any order and with replays, gives the same
messages as all of it at once (`folded`, which shares the rules). A stream to which nothing came for `ttl` seconds of
event time is closed with what it has, gaps left out; a closed stream is remembered for as long, so that replays are no
new stream.

Operations: add and replace put a value in place of what is there, append adds to a string or a list (and replaces
anything else), remove takes a value away, patch holds a list of operations. Elements of lists are named by number; an
element far behind the end isn't added, and an object whose names are all numbers counts as a list. Data that is no object, values nested hundreds deep, operations that
don't fit and unknown events change nothing. Events without stream, seq or ts, and those older than the watermark, are dropped. Messages without text are not emitted.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TTL = 120.0
EVENT = "stream string, seq long, event string, data string, ts timestamp"
#: version: how many events were applied; ended: null as long as the stream is open, else `complete` or `expired`.
MESSAGE = "stream string, message int, role string, text string, model string, conversation_id string, version long, ended string"
_NAMES = [f.split()[0] for f in MESSAGE.split(", ")]

Path = tuple[str, ...]


def leaves_of(value: object, above: Path = ()) -> Iterator[tuple[Path, object]]:
    """The leaves of a value; an empty list or object is one itself."""
    if isinstance(value, (dict, list)) and value:
        for name, below in value.items() if isinstance(value, dict) else enumerate(value):
            yield from leaves_of(below, (*above, str(name)))
    else:
        yield above, value


class Leaves(dict[Path, object]):
    """A tree by its leaves."""

    def below(self, path: Path) -> list[Path]:
        return [p for p in self if p[: len(path)] == path]

    def length(self, path: Path) -> int | None:
        """How many elements the list at path has; None if there is no list."""
        names = {p[len(path)] for p in self.below(path) if len(p) > len(path)}
        if not names:
            return 0 if self.get(path) == [] else None
        return len(names) if all(n.isdigit() for n in names) else None

    def string(self, path: Path) -> str | None:
        value = self.get(path)
        return value if isinstance(value, str) else None

    def put(self, path: Path, value: object) -> None:
        try:
            found = list(leaves_of(value, path))
        except RecursionError:
            return
        for p in self.below(path):
            del self[p]
        for i in range(len(path)):
            # What was a leaf has something below it now.
            self.pop(path[:i], None)
        self.update(found)

    def take(self, path: Path) -> None:
        many, gone, at = self.length(path[:-1]), self.below(path), len(path) - 1
        for p in gone:
            del self[p]
        if many is not None and gone:
            for p in sorted((p for p in self.below(path[:-1]) if int(p[at]) > int(path[at])), key=lambda p: int(p[at])):
                self[(*p[:at], str(int(p[at]) - 1), *p[at + 1 :])] = self.pop(p)
            if many == 1:
                self[path[:-1]] = []

    def leads(self, path: Path) -> bool:
        """Whether the path names an element that is there in each list on its way, and one that may come in the last."""
        for i in range(len(path)):
            many = self.length(path[:i])
            if many is not None and not (path[i].isdigit() and int(path[i]) < many + (i == len(path) - 1)):
                return False
        return True

    def patch(self, path: Path, op: str, value: object) -> None:
        if op == "patch" and isinstance(value, list):
            for step in value:
                if isinstance(step, dict):
                    self.patch(path_of(step.get("p") or ""), step.get("o") or "add", step.get("v"))
        elif not path:
            if op in ("add", "replace") and isinstance(value, dict):
                self.put((), value)
        elif not self.leads(path):
            return
        elif op == "append" and (many := self.length(path)) is not None:
            self.put((*path, str(many)), value)
        elif op == "append":
            before = self.string(path) if self.below(path) else ""
            self.put(path, before + value if before is not None and isinstance(value, str) else value)
        elif op in ("add", "replace"):
            self.put(path, value)
        elif op == "remove":
            self.take(path)


def path_of(pointer: str) -> Path:
    return tuple(s.replace("~1", "/").replace("~0", "~") for s in pointer.split("/") if s)


class Fold:
    """One stream: its messages' leaves, where it stands, and which messages a batch touched."""

    def __init__(self, messages: dict[int, Leaves], message: int = 0, path: str | None = None, op: str | None = None, applied: int = 0, ended: str | None = None):
        self.messages, self.message, self.path, self.op, self.applied, self.ended = messages, message, path, op, applied, ended
        self.touched: set[int] = set()

    def apply(self, event: str | None, data: str | None) -> None:
        self.applied += 1
        if data == "[DONE]":
            self.ended = self.ended or "complete"
            return
        try:
            said = json.loads(data or "null")
        except (ValueError, RecursionError):
            return
        if not isinstance(said, dict) or self.ended:
            return
        if event != "delta":
            if said.get("type") == "message_stream_complete":
                self.message, self.path, self.op = self.message + bool(self.messages.get(self.message)), None, None
            return
        if "p" in said or "o" in said:
            self.path, self.op = said.get("p") or "", said.get("o") or "add"
        elif self.path is None:
            return
        if self.path == "" and self.op == "add":
            self.message += bool(self.messages.get(self.message))
        self.touched.add(self.message)
        self.messages.setdefault(self.message, Leaves()).patch(path_of(self.path), self.op, said.get("v"))

    def rows(self, stream: str, messages: set[int]) -> Iterator[dict]:
        for n in sorted(messages):
            tree = self.messages[n]
            if text := text_of(tree):
                model = tree.string(("message", "metadata", "resolved_model_slug")) or tree.string(("message", "metadata", "model_slug"))
                cells = (stream, n, tree.string(("message", "author", "role")) or "assistant", text, model, tree.string(("conversation_id",)) or None, self.applied, self.ended)
                yield dict(zip(_NAMES, cells, strict=True))


def text_of(tree: Leaves) -> str:
    """The text of a message: its content as a string, the content's text, or the parts that are text, joined."""
    content = ("message", "content")
    whole = tree.string(content) or tree.string((*content, "text"))
    if whole:
        return whole
    parts = (*content, "parts")
    found = [tree.string((*parts, str(i))) or tree.string((*parts, str(i), "text")) for i in range(tree.length(parts) or 0)]
    return "".join(t for t in found if t)


def sent(events: DataFrame) -> DataFrame:
    return events.select(*[f.split()[0] for f in EVENT.split(", ")]).where("stream is not null and seq >= 0 and ts is not null")


def folded(events: DataFrame) -> DataFrame:
    """MESSAGE rows of events (EVENT) that are all there. One shuffle; a task keeps the messages of one stream at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, seq, fold = None, None, Fold({})
        for batch in batches:
            out = []
            for key, at, event, data in zip(batch["stream"], batch["seq"], batch["event"], batch["data"], strict=True):
                if key != stream:
                    out += fold.rows(stream, set(fold.messages)) if stream is not None else []
                    stream, seq, fold = key, None, Fold({})
                if at != seq and not fold.ended:
                    fold.apply(event, data)
                seq = at
            yield pd.DataFrame(out, columns=_NAMES).astype(object)
        if stream is not None:
            yield pd.DataFrame(list(fold.rows(stream, set(fold.messages))), columns=_NAMES).astype(object)

    return sent(events).repartition("stream").sortWithinPartitions("stream", "seq", "ts", "data").mapInPandas(run, MESSAGE).withColumn("ended", F.coalesce("ended", F.lit("expired")))


class Folding(StatefulProcessor):
    """A batch reads a stream's state at once and writes one value for each message that it touched, and one list of what waits."""

    def __init__(self, ttl: float):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "message int, path string, op string, applied long, ended string, next long, last double")
        self.leaves = handle.getMapState("leaves", "message int", "leaves string")
        self.waiting = handle.getListState("waiting", "seq long, event string, data string")

    def read(self) -> tuple[Fold, int, float] | None:
        if not self.place.exists():
            return None
        message, path, op, applied, ended, after, last = self.place.get()
        messages = {} if ended else {int(n): Leaves((tuple(path), v) for path, v in json.loads(told)) for (n,), (told,) in self.leaves.iterator()}
        return Fold(messages, int(message), path, op, int(applied), ended), int(after), float(last)

    def write(self, fold: Fold, stored: set[int], after: int, last: float) -> None:
        if fold.ended:
            if stored:
                self.leaves.clear()
        else:
            for n in fold.touched:
                self.leaves.updateValue((n,), (json.dumps(list(fold.messages[n].items())),))
        self.place.update((fold.message, fold.path, fold.op, fold.applied, fold.ended, after, last))
        self.handle.registerTimer(int((last + self.ttl) * 1000) + 1)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        before = self.read()
        fold, after, last = before or (Fold({}), 0, 0.0)
        stored = set(fold.messages)
        waited = {int(at): (event, data) for at, event, data in self.waiting.get()} if before and not fold.ended else {}
        came = dict(waited)
        for r in rows:
            last = max(last, r["seconds"])
            if r["seq"] >= after and not fold.ended:
                came.setdefault(r["seq"], (r["event"], r["data"]))
        open_before = not fold.ended
        while not fold.ended and after in came:
            fold.apply(*came.pop(after))
            after += 1
        if fold.ended:
            came = {}
        if came.keys() != waited.keys():
            if came:
                self.waiting.put([(at, *said) for at, said in came.items()])
            else:
                self.waiting.clear()
        yield from (Row(**r) for r in fold.rows(key[0], set(fold.messages) if fold.ended and open_before else fold.touched))
        self.write(fold, stored, after, last)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        before = self.read()
        if before is None or (before[2] + self.ttl) * 1000 >= expiredTimerInfo.getExpiryTimeInMs():
            return
        fold = before[0]
        if not fold.ended:
            for _, event, data in sorted(self.waiting.get(), key=lambda x: int(x[0])):
                fold.apply(event, data)
            fold.ended = fold.ended or "expired"
            yield from (Row(**r) for r in fold.rows(key[0], set(fold.messages)))
        for state in (self.place, self.leaves, self.waiting):
            state.clear()


def folding(events: DataFrame, ttl: float = TTL, lateness: str = "10 seconds") -> DataFrame:
    """MESSAGE rows of a stream of events: of each batch the messages that it changed, and at the end of a stream all its messages with ended."""
    timed = sent(events).withColumn("seconds", F.unix_micros("ts") / 1e6)
    return timed.withWatermark("ts", lateness).groupBy("stream").transformWithState(Folding(ttl), MESSAGE, "append", "eventTime")


def newest(messages: DataFrame) -> DataFrame:
    """Of the rows that came of each message the last."""
    last = F.max_by(F.struct(*_NAMES), F.struct("version", F.col("ended").isNotNull())).alias("m")
    return messages.groupBy("stream", "message").agg(last).select("m.*")


def events_of(pairs: DataFrame, stream: str = "pair_id", body: str = "response") -> DataFrame:
    """The events of whole event streams, numbered in order; ts is the pair's ts plus the number in microseconds. No shuffle.

    Events end at blank lines; comments are left out; several data lines are one text.
    """
    lines = lambda e, head: F.transform(F.filter(F.split(e, "\n"), lambda x: x.startswith(head)), lambda x: F.regexp_replace(F.substring(x, len(head) + 1, 1 << 30), "^ ", ""))
    events = F.filter(F.split(F.regexp_replace(F.col(body), "\r\n?", "\n"), "\n\n+"), lambda e: e.rlike("(?m)^data:"))
    each = pairs.select(F.col(stream).cast("string").alias("stream"), F.col("ts").alias("base"), F.posexplode(events).alias("seq", "e"))
    return each.select("stream", F.col("seq").cast("long").alias("seq"), F.trim(F.element_at(F.concat(F.array(F.lit("")), lines(F.col("e"), "event:")), -1)).alias("event"), F.array_join(lines(F.col("e"), "data:"), "\n").alias("data"), F.timestamp_micros(F.unix_micros("base") + F.col("seq")).alias("ts"))
