"""A store of sessions and messages that captures are folded into, batch after batch.

A capture's result (session key, what is known about the session, its messages in order) goes to the state of its
session: the session's row, its messages by deduplication key and position, the next turn of each branch, and the
children of each message of the provider. Per result

* the session is found by its key or made (a result without key is a session of its own);
* the n-th message of a key (role and first characters of the text, unwrapped) meets the n-th stored one, which takes
  over what the new one knows better; messages without a counterpart are inserted, so true repeats stay;
* a completion whose parent already has another answer of that role goes to a branch of its own, below its sibling;
* weak session fields are replaced by better ones.

State is kept per message, not per session, so a long session costs memory for the results of one batch only, and for up
to READ_AT_ONCE times as many messages where all of a session are read at once. Each
change is emitted as the whole new row with a version that counts the session's changes; `merge_into` writes a batch's
changes under its number, so that a batch that is run again replaces its own files, and `stored` reads the latest
version of each row. Results of one batch are taken in the order of created_at, then pair_id; a batch of replays changes
nothing.

Defined cases: null texts are empty ones; results without messages make or mend their session; messages without time get
their result's; an unknown role is a role like any other.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.rich import attachments_of, merged_json, threading_of

# Marks of attachments and names of uploaded files before a message's own text.
MARK = re.compile(r"\[(?:image|file(?::[^\]]+)?|audio|document(?::[^\]]+)?|tool(?:\s+call)?(?::[^\]]+)?|citation|code(?:\s+output)?)\]", re.I)
FILE_TYPES = "pdf doc docx txt md py js ts csv json xml htm html xls xlsx ppt pptx zip rar png jpg jpeg gif svg mp3 mp4 wav webp heic c cpp h rb go rs java kt swift sh bat ps1 r sql yml yaml toml ini cfg log ipynb".split()
KEY_CHARACTERS = 200
LABEL_CHARACTERS = 30
TITLE_CHARACTERS = 200
MAIN = "0"

MESSAGE = "role string, text string, content_json string, model_name string, token_estimate long, ts double, parent_uuid string"
RESULT = f"session_key string, pair_id string, source_id string, created_via string, created_at double, provider string, tool_family string, title_hint string, messages array<struct<{MESSAGE.replace(' ', ':').replace(',:', ',')}>>"
SESSION = "session_key string, source_id string, created_via string, provider string, tool_family string, title_hint string, started_at double, ended_at double, message_count long"
STORED = "id string, role string, text string, content_json string, model_name string, token_estimate long, ts double, branch_id string, branch_parent_id string, turn_index long, pair_id string"
_SESSION, _STORED = ([f.split()[0] for f in x.split(", ")] for x in (SESSION, STORED))
CHANGE = f"kind string, session_id string, version long, {SESSION}, {STORED}"
_CHANGE = [f.split()[0] for f in CHANGE.split(", ")]
#: A session with up to so many times the messages of a batch is read at once.
READ_AT_ONCE = 4


def short(*parts: object) -> str:
    return hashlib.sha256("\x00".join(map(str, parts)).encode()).hexdigest()[:24]


def unwrapped(text: str | None) -> str:
    """The visible text of a message that was captured as its platform's own object of parts."""
    text = text or ""
    bare = text.strip()
    if not bare.startswith("{") or "parts" not in bare[:50]:
        return text
    try:
        parts = ast.literal_eval(bare)["parts"]
    except (ValueError, SyntaxError, KeyError, TypeError, MemoryError, RecursionError):
        return text
    if not isinstance(parts, list):
        return text
    seen = []
    for part in parts:
        if isinstance(part, dict):
            is_image = part.get("content_type") == "image_asset_pointer" or "asset_pointer" in part
            part = "[Image]" if is_image else part.get("text")
        if isinstance(part, str) and part:
            seen.append(part)
    return " ".join(seen).strip()


def bare_text(text: str | None) -> str:
    """The text without leading marks of attachments, or without a file's name and label above it."""
    lines = [line.strip() for line in (text or "").strip().split("\n")]
    first = 0
    while len(lines) - first > 1 and MARK.fullmatch(lines[first]):
        first += 1
        while first < len(lines) and not lines[first]:
            first += 1
    lines = lines[first:]
    if len(lines) >= 2 and "." in lines[0][1:] and lines[0].rsplit(".", 1)[1].lower() in FILE_TYPES:
        lines = lines[2 if len(lines[1]) <= LABEL_CHARACTERS else 1 :]
    return "\n".join(lines).strip()


def dedup_key(role: str | None, text: str | None) -> str:
    return f"{role}:{bare_text(unwrapped(text))[:KEY_CHARACTERS]}"


def is_clean(text: str | None) -> bool:
    t = (text or "").strip()
    return not (t.startswith("{") and t.endswith("}") or t.startswith("[{") and t.endswith("}]") or "...[truncated]" in t)


def score(m: dict) -> float:
    """How much a message's view of it is worth, 0 to 1."""
    text = m["text"] or ""
    n = len(text.strip())
    worth = min(n / 500, 0.25) + 0.15 * bool(m["model_name"]) + 0.15 * ((m["token_estimate"] or 0) > 0) + 0.10 * bool(attachments_of(m["content_json"]))
    worth += 0.05 * ("[Tool call:" in text) + 0.05 * ("<thinking>" in text) + 0.15 * (is_clean(text) and n > 10)
    return min(worth * (0.5 if n < 5 else 1), 1.0)


def better_text(old: str | None, new: str | None) -> str | None:
    if not old or not new:
        return old or new
    plain_old, plain_new = bare_text(old), bare_text(new)
    if plain_old != plain_new:
        return new if len(new.strip()) > len(old.strip()) else old
    return old if old.strip() == plain_old else plain_new or old


def merged(old: dict, new: dict) -> dict:
    """The stored message with what the new view of it knows better."""
    worth_old, worth_new = score(old), score(new)
    one, other = old, new
    text = better_text(old["text"], new["text"])
    if worth_new > worth_old or (attachments_of(new["content_json"]) and not attachments_of(old["content_json"])):
        one, other = (new, old) if worth_new >= worth_old else (old, new)
        # Of texts that differ only in what stands before them the bare one stays, so that replays change nothing.
        if bare_text(old["text"]) != bare_text(new["text"]):
            clean = (is_clean(one["text"]), is_clean(other["text"]))
            longer = len((one["text"] or "").strip()) >= len((other["text"] or "").strip())
            text = (one if clean == (True, False) or clean[0] == clean[1] and longer else other)["text"]
    found = {"text": text, "content_json": merged_json(one["content_json"], other["content_json"]), "model_name": one["model_name"] or other["model_name"], "token_estimate": one["token_estimate"] or other["token_estimate"]}
    return old | found


def estimated(text: str | None) -> int | None:
    if not text or not text.strip():
        return None
    cjk = sum("一" <= c <= "鿿" or "぀" <= c <= "ヿ" or "가" <= c <= "힯" for c in text)
    return max(int(cjk * 1.5 + (len(text.split()) - cjk) * 1.3), 1)


def upgraded(session: dict, result: dict) -> dict:
    """Session fields that say little give way to those that say more."""
    weak = {
        "provider": lambda v: v in (None, "", "unknown"), "tool_family": lambda v: not v or v.startswith("unknown"),
        "title_hint": lambda v: not v or v.startswith("{"), "created_via": lambda v: v in (None, "", "browser_extension_network"),
    }
    out = dict(session)
    for field, is_weak in weak.items():
        value = result[field]
        if is_weak(out[field]) and value and not (field == "provider" and value == "unknown"):
            out[field] = value[:TITLE_CHARACTERS] if field == "title_hint" else value
    return out


class Batch:
    """A session's messages and turns as one batch sees and changes them; state is written once, at its end."""

    def __init__(self, messages: object, turns: object):
        self.messages, self.turns, self.all_known = messages, turns, False
        self.rows: dict[tuple, dict | None] = {}
        self.next: dict[str, int] = {}
        self.put_rows: set[tuple] = set()
        self.put_turns: set[str] = set()

    def row(self, *at: object) -> dict | None:
        if at not in self.rows:
            if self.all_known:
                return None
            self.rows[at] = dict(zip(_STORED, self.messages.getValue(at))) if self.messages.containsKey(at) else None
        return self.rows[at]

    def put(self, key: str, nth: int, row: dict) -> None:
        self.rows[key, nth] = row
        self.put_rows.add((key, nth))

    def next_turn(self, branch: str) -> int:
        turn = self.next.get(branch, 0)
        self.next[branch] = turn + 1
        self.put_turns.add(branch)
        return turn

    def write(self) -> None:
        for at in self.put_rows:
            self.messages.updateValue(at, tuple(self.rows[at][n] for n in _STORED))
        for branch in self.put_turns:
            self.turns.updateValue((branch,), (self.next[branch],))


class SessionFold(StatefulProcessor):
    """Folds a session's results into its state and emits the changed rows."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.session = handle.getValueState("session", f"{SESSION}, version long")
        self.messages = handle.getMapState("messages", "key string, nth int", STORED)
        self.turns = handle.getMapState("turns", "branch string", "next long")
        self.children = handle.getMapState("children", "parent string, role string", "ids array<string>, hashes array<string>, times array<double>")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        results = [{n: v for n, v in r.asDict().items() if n != "messages"} | {"messages": [as_dict(m) for m in listed(r["messages"])]} for r in rows]
        changed: dict[tuple, dict] = {}
        session_id = short(key[0])
        old = dict(zip(_SESSION + ["version"], self.session.get())) if self.session.exists() else None
        batch = self.batch_of(old, results)
        for result in sorted(results, key=lambda r: (r["created_at"] or 0.0, r["pair_id"] or "")):
            before = old
            if old is None:
                old = {k: result.get(k) for k in ("session_key", "source_id", "created_via", "provider", "tool_family", "title_hint")} | {"started_at": result["created_at"], "ended_at": result["created_at"], "message_count": 0, "version": 0}
                old["title_hint"] = old["title_hint"][:TITLE_CHARACTERS] if old["title_hint"] else old["title_hint"]
            new = self.take(session_id, old, result, changed, batch)
            if before is not None:
                new = upgraded(new, result)
            if before is None or new != before:
                new["version"] = old["version"] + 1
                changed["session", session_id] = {"kind": "session", "session_id": session_id} | new
            old = new
        if old is not None:
            self.session.update(tuple(old.values()))
        batch.write()
        yield from (Row(**{n: c.get(n) for n in _CHANGE}) for c in changed.values())

    def batch_of(self, session: dict | None, results: list[dict]) -> Batch:
        """What a batch knows of its session: all messages at once, if they are not many more than the batch's, else each when it is asked for."""
        batch = Batch(self.messages, self.turns)
        if session is None:
            batch.all_known = True
        elif session["message_count"] <= READ_AT_ONCE * sum(len(r["messages"]) for r in results):
            batch.rows = {(k, int(nth)): dict(zip(_STORED, v)) for (k, nth), v in self.messages.iterator()}
            batch.all_known = True
        if session is not None:
            batch.next = {branch: int(n) for (branch,), (n,) in self.turns.iterator()}
        return batch

    def take(self, session_id: str, session: dict, result: dict, changed: dict, batch: Batch) -> dict:
        fork = self.fork_of(session_id, result) if session["version"] else (None, None)
        cursor: dict[str, int] = {}
        session = dict(session)
        for m in result["messages"]:
            key = dedup_key(m["role"], m["text"])
            nth = cursor.get(key, 0)
            cursor[key] = nth + 1
            stored = batch.row(key, nth)
            if stored is not None:
                row = merged(stored, m)
                if row == stored:
                    continue
            else:
                said = threading_of(m["content_json"])
                branch = said.get("branch_id") or said.get("current_branch_id") or fork[0] or MAIN
                parent = said.get("parent_message_id") or (fork[1] if branch == fork[0] else None)
                turn = batch.next_turn(branch)
                ts = m["ts"] or result["created_at"]
                row = {"id": short(session_id, key, nth), "role": m["role"], "text": m["text"], "content_json": m["content_json"], "model_name": m["model_name"], "token_estimate": m["token_estimate"] or estimated(m["text"]), "ts": ts, "branch_id": branch, "branch_parent_id": parent, "turn_index": turn, "pair_id": result["pair_id"]}
                session["message_count"] += 1
                session["ended_at"] = max(session["ended_at"] or 0.0, ts or 0.0)
                if m["parent_uuid"]:
                    at = (m["parent_uuid"], m["role"] or "")
                    ids, hashes, times = (list(x) for x in self.children.getValue(at)) if self.children.containsKey(at) else ([], [], [])
                    self.children.updateValue(at, (ids + [row["id"]], hashes + [short(m["text"] or "")], times + [ts or 0.0]))
            batch.put(key, nth, row)
            changed["message", row["id"]] = {"kind": "message", "session_id": session_id, "version": session["version"] + 1} | row
        return session

    def fork_of(self, session_id: str, result: dict) -> tuple[str | None, str | None]:
        """A new branch and the stored sibling that this completion differs from."""
        siblings = []
        asked = {}
        for m in result["messages"]:
            if m["parent_uuid"]:
                asked.setdefault((m["parent_uuid"], m["role"] or ""), short(m["text"] or ""))
        for at, own in asked.items():
            if self.children.containsKey(at):
                ids, hashes, times = self.children.getValue(at)
                if own not in list(hashes):
                    siblings += list(zip(times, ids))
        sibling = min(siblings)[1] if siblings else None
        return (short(session_id, "branch", sibling, result["pair_id"]), sibling) if sibling else (None, None)


def as_dict(m: object) -> dict:
    return m.asDict() if hasattr(m, "asDict") else dict(m)


def listed(v: object) -> list:
    return [] if v is None else list(v)


def changes(results: DataFrame) -> DataFrame:
    """The changed rows (CHANGE) that a stream of results (RESULT) makes in its sessions' state."""
    own = F.when(F.coalesce("session_key", F.lit("")) != "", F.concat(F.lit("key:"), "session_key")).otherwise(F.concat(F.lit("pair:"), F.coalesce("pair_id", F.lit(""))))
    keyed = results.withColumn("fold_key", own)
    return keyed.groupBy("fold_key").transformWithState(SessionFold(), CHANGE, "update", "none")


def merge_into(folder: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a batch's changes under its number; run again, it replaces them."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")

    return write


def compact(spark: SparkSession, folder: str, target: str) -> None:
    """The latest versions as the first batch of a new store."""
    rows = spark.read.parquet(f"{folder}/changes").drop("batch")
    latest(rows).write.mode("errorifexists").parquet(f"{target}/changes/batch=-1")


def latest(rows: DataFrame) -> DataFrame:
    fields = [c for c in rows.columns if c not in ("kind", "session_id", "id")]
    newest = rows.groupBy("kind", "session_id", "id").agg(F.max_by(F.struct(*fields), "version").alias("row"))
    return newest.select("kind", "session_id", "id", "row.*").select(*rows.columns)


def stored(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """sessions (id and SESSION) and messages (session_id and STORED), the latest version of each."""
    rows = latest(spark.read.parquet(f"{folder}/changes").drop("batch"))
    name = lambda schema: [f.split()[0] for f in schema.split(", ")]
    sessions = rows.where("kind = 'session'").select(F.col("session_id").alias("id"), *name(SESSION))
    return sessions, rows.where("kind = 'message'").select("session_id", *name(STORED))


def run_available(results: DataFrame, folder: str) -> None:
    """Folds all results that a streaming source has now; a later call goes on from its checkpoint in the folder."""
    spark = results.sparkSession
    kind = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(kind, None)
    spark.conf.set(kind, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        changes(results).writeStream.outputMode("update").foreachBatch(merge_into(folder)).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(kind, before) if before else spark.conf.unset(kind)
