"""Periodic runs in texts: Crochemore's partition refinement over words.

Positions of a text are partitioned by the factor of words that begins there, first of length 1, then 2, and so on. A
class of one length splits by the classes of its positions' successors; only the smaller parts of each split class are
passed on (`smaller half`), so all rounds together touch O(n log n) positions. A class links its positions in order:
neighbours at a distance equal to the factor's length are the two halves of a square, squares at consecutive positions
with one period are one run. All texts of a chunk are refined together, one numpy step a length.

A run is returned if its length is at least `least_length` and at least `least_power` periods. That lets classes go
that are too small to hold one: each half of a square in such a run is in a class of least_power - 1 positions.

Defined cases: null, empty and blank texts have no words and no runs; a text is handled whole, however long, in one
task (memory grows with the text); repeated rows are each handled; equal lengths are told apart by start, then period;
an empty table gives an empty result; other columns are left aside, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks

#: A run has at least so many words, and so many periods.
LEAST_LENGTH = 6
LEAST_POWER = 4
RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

#: (words, doc_id) to the words that are searched.
Prepare = Callable[[list[bytes], "int | None"], list[bytes]]


class Growing:
    """An array of numbers that grows at its end."""

    def __init__(self, first: np.ndarray):
        self.held, self.n = first, len(first)

    def add(self, more: np.ndarray) -> int:
        """Where the added numbers begin."""
        at, self.n = self.n, self.n + len(more)
        if self.n > len(self.held):
            self.held = np.concatenate([self.held[:at], np.zeros(max(self.n, 2 * at) - at, np.int64)])
        self.held[at : self.n] = more
        return at


def starts_of_groups(keys: np.ndarray) -> np.ndarray:
    """Where in sorted keys a new one begins."""
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)


class Partition:
    """Classes of positions by the factor of `level` words that begins there; -1: in no class that matters any more."""

    def __init__(self, words: np.ndarray, ends: np.ndarray, need: int, power: int):
        """words: numbers of words, each text after the other; ends: where each text ends. need: members of a class that matters."""
        n = len(words)
        lengths = np.diff(np.r_[0, ends])
        text = np.repeat(np.arange(len(ends)), lengths)
        self.need, self.level = need, 1
        self.is_first = np.zeros(n + 1, bool)
        self.is_first[np.r_[0, ends]] = True
        #: The longest period that a run can have in the position's text: no longer factor matters there.
        self.deepest = (lengths // power)[text]
        self.label = np.full(n, -1, np.int64)
        self.after, self.before = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.since = np.ones(n, np.int64)
        self.moved = np.zeros(n, bool)
        self.squares: list[tuple[np.ndarray, np.ndarray]] = []
        key = text * (int(words.max(initial=0)) + 1) + words
        order = np.argsort(key, kind="stable")
        begin = starts_of_groups(key[order])
        size = np.diff(np.r_[begin, n])
        keep = size >= need
        inside = np.repeat(keep, size)
        self.dead = np.sort(order[~inside])
        order, size = order[inside], size[keep]
        begin = np.cumsum(size) - size
        #: Members of a class are among pool[begin : begin + held], those that left it included.
        self.pool, self.begin, self.held, self.size = Growing(order), Growing(begin), Growing(size.copy()), Growing(size)
        self.label[order] = np.repeat(np.arange(len(size)), size)
        self.link(order, begin)
        # All classes of a text but its largest one are small.
        by_size = np.lexsort((-size, text[order[begin]])) if len(size) else begin
        largest = np.zeros(len(size), bool)
        if len(size):
            largest[by_size[starts_of_groups(text[order[begin]][by_size])]] = True
        self.small = order[~np.repeat(largest, size)]
        #: The last word of a text has no longer factor.
        self.last = ends[lengths > 0] - 1

    def link(self, order: np.ndarray, begin: np.ndarray) -> None:
        if len(order):
            self.after[order[:-1]], self.before[order[1:]] = order[1:], order[:-1]
            self.before[order[begin]] = -1
            self.after[order[np.r_[begin[1:], len(order)] - 1]] = -1

    def note(self, at: np.ndarray) -> None:
        """The neighbours of these positions change now: those that were at the distance of the length meanwhile are squares."""
        gap = self.after[at] - at
        met = (self.after[at] >= 0) & (self.since[at] <= gap) & (gap <= self.level)
        if met.any():
            self.squares.append((at[met], gap[met]))

    def going(self, at: np.ndarray) -> np.ndarray:
        """The positions before these, if they are in the same text and still matter."""
        at = at[~self.is_first[at]] - 1
        return at[(self.label[at] >= 0) & (self.deepest[at] > self.level)]

    def members(self, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The classes' members, and how many each has."""
        held = self.held.held[classes]
        at = np.repeat(self.begin.held[classes] - (np.cumsum(held) - held), held) + np.arange(held.sum())
        found = self.pool.held[at]
        found = found[self.label[found] == np.repeat(classes, held)]
        return found, self.size.held[classes]

    def refine(self) -> None:
        """One word more."""
        dying = self.going(self.dead)
        if self.level == 1:
            last = self.last[(self.label[self.last] >= 0) & (self.deepest[self.last] > 1)]
            dying = np.unique(np.r_[dying, last])
        going = self.going(self.small)
        if self.level == 1 and len(going):
            going = going[~np.isin(going, dying)]
        parent, by = self.label[going], self.label[going + 1]
        order = np.lexsort((going, by, parent))
        going, parent, by = going[order], parent[order], by[order]
        begin = starts_of_groups(parent * (self.size.n + 1) + by)
        size = np.diff(np.r_[begin, len(going)])
        of = parent[begin]
        out = np.r_[going, dying]
        left, count = np.unique(self.label[out], return_counts=True)
        self.unlink(out)
        self.label[out] = -1
        self.size.held[left] -= count
        rest = self.size.held[left]
        # The largest part of a class isn't passed on: one of its new parts, or what is left of it.
        most = np.zeros(len(left), np.int64)
        np.maximum.at(most, np.searchsorted(left, of), size)
        fine = size >= self.need
        largest = fine & (size > rest[np.searchsorted(left, of)]) & (size == most[np.searchsorted(left, of)])
        ties = np.flatnonzero(largest)
        largest[ties] = np.r_[True, of[ties[1:]] != of[ties[:-1]]] if len(ties) else False
        ends = left[(rest > 0) & (rest < self.need)]
        passed = left[(rest >= self.need) & (most > rest)]
        ending, _ = self.members(ends)
        self.note(ending)
        self.size.held[ends] = 0
        remainder, held = self.members(passed)
        self.begin.held[passed] = self.pool.add(remainder) + np.cumsum(held) - held
        self.held.held[passed] = held
        inside = np.repeat(fine, size)
        fresh, begin, new = going[inside], np.cumsum(size[fine]) - size[fine], size[fine]
        numbers = self.size.n + np.arange(len(new))
        self.begin.add(self.pool.add(fresh) + begin)
        self.held.add(new)
        self.size.add(new)
        self.label[fresh] = np.repeat(numbers, new)
        self.since[fresh] = self.level + 1
        self.link(fresh, begin)
        self.dead = np.concatenate([dying, going[~inside], ending])
        self.label[self.dead] = -1
        self.after[self.dead] = self.before[self.dead] = -1
        self.small = np.r_[fresh[~np.repeat(largest[fine], new)], remainder]
        self.level += 1

    def unlink(self, out: np.ndarray) -> None:
        """Takes positions out of their classes' order."""
        out = out[np.lexsort((out, self.label[out]))]
        self.note(out)
        self.moved[out] = True
        before, after = self.before[out], self.after[out]
        opens, closes = (before < 0) | ~self.moved[before], (after < 0) | ~self.moved[after]
        left, right = before[opens], after[closes]
        stays = left >= 0
        self.note(left[stays])
        self.after[left[stays]] = right[stays]
        self.since[left[stays]] = self.level + 1
        self.before[right[right >= 0]] = left[right >= 0]
        self.moved[out] = False

    def finish(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions and periods of all squares."""
        while len(self.small) or len(self.dead) or self.level == 1:
            self.refine()
        at = np.flatnonzero(self.after >= 0)
        gap = self.after[at] - at
        met = (self.since[at] <= gap) & (gap <= self.deepest[at])
        found = [*self.squares, (at[met], gap[met])]
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def runs_in(words: np.ndarray, ends: np.ndarray, least_length: int = LEAST_LENGTH, least_power: int = LEAST_POWER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, length, period of the runs in texts that stand one after the other, by start, then period."""
    if not len(words):
        return (np.zeros(0, np.int64),) * 3
    at, period = Partition(words, ends, max(2, least_power - 1), least_power).finish()
    order = np.lexsort((at, period))
    at, period = at[order], period[order]
    begin = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (period[1:] != period[:-1])]) if len(at) else np.zeros(0, np.int64)
    start, q = at[begin], period[begin]
    length = at[np.r_[begin[1:], len(at)] - 1] - start + 2 * q if len(at) else start
    keep = length >= np.maximum(least_length, least_power * q)
    start, length, q = start[keep], length[keep], q[keep]
    order = np.lexsort((q, start))
    return start[order], length[order], q[order]


def rebuilt(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of the query's contract: of one id in ten, what follows a place repeats its beginning."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * ((n - a) // p + 1))[: n - a]


def periodic_runs(docs: DataFrame, prepare: Prepare | None = None, least_length: int = LEAST_LENGTH, least_power: int = LEAST_POWER) -> DataFrame:
    """doc_id, n_words, runs (start, length, period, by start, then period) and collapsed: the words without those that a run repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]).tolist() if len(texts) else []
            for a, b in chunks(sizes):
                split = [(t.as_py() or b"").split() for t in texts[a:b]]
                own = ids[a:b].to_pylist()
                if prepare:
                    split = [prepare(w, i) for w, i in zip(split, own)]
                flat = [w for ws in split for w in ws]
                codes = pa.array(flat, pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64) if flat else np.zeros(0, np.int64)
                ends = np.cumsum([len(ws) for ws in split])
                start, length, period = runs_in(codes, ends, least_length, least_power)
                text = np.searchsorted(ends, start, side="right")
                kept = np.zeros(len(flat) + 1, np.int64)
                np.add.at(kept, start + period, 1)
                np.add.at(kept, start + length, -1)
                kept = np.cumsum(kept)[:-1] == 0
                firsts = np.r_[0, ends[:-1]]
                collapsed = [b" ".join(ws if kept[x:y].all() else [w for w, k in zip(ws, kept[x:y]) if k]) for ws, x, y in zip(split, firsts, ends)]
                offsets = np.searchsorted(text, np.arange(b - a + 1))
                runs = pa.StructArray.from_arrays([pa.array(start - firsts[text]), pa.array(length), pa.array(period)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays([ids[a:b], pa.array(np.diff(np.r_[0, ends])), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), runs), pa.array(collapsed, pa.binary())], ["doc_id", "n_words", "runs", "collapsed"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    return source.mapInArrow(run, f"doc_id long, n_words long, runs {RUN}, collapsed binary").withColumn("collapsed", F.col("collapsed").cast("string"))


def digest(found: DataFrame) -> DataFrame:
    """The query's columns."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("back"), (-r.period).alias("shorter"))))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat_ws("", r.start, F.lit(","), r.length, F.lit(","), r.period, F.lit("\n"))))
    one = found.withColumn("longest", longest)
    length, period = F.col("longest.length"), -F.col("longest.shorter")
    return one.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.back")).alias("start"), length.alias("length"), period.alias("period"),
        F.expr("1000 * longest.length div -longest.shorter").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
