"""Benchmark decontamination with a distributed positional inverted index.

The training texts are indexed in shards: each shard is one chunk of documents whose words are laid out in one long
position space, with its vocabulary and, per word of it, the posting list of all its positions (`build_index`). A shard
is a row, so the index is an ordinary table of about 0.7 times the texts' size; it is stored once, in the session's
shared folder, and searched as often as there are blocks of test items, without another look at the texts. A task holds
a few shards at once, however many it has: each is a row group of its own, Arrow batches are small, and places are
looked at `candidates` at a time. `search`
intersects, shard by shard, the offset-adjusted posting lists of every test window by binary search, from the window's
rarest term in that shard to its most common one, and so finds every exact occurrence; a window whose (up to) three
rarest terms, by their counts in the whole test set, are in a document, the second and third within `slop` words of the
rarest, is a proximity match there, whatever its other words and the other documents of the shard are.

The test set is handled in blocks of at most `BLOCK_BYTES`, one at a time: the driver holds and broadcasts one block,
with that proven bound, and writes its hits before the next one. No text, posting or document is shuffled; what several
blocks find is merged per document.

Windows: `window` consecutive words of an item; an item with fewer words, but not none, is one window.

Defined cases: null and empty texts have no words and no hits; null item texts give no windows; null item ids are left
out; repeated items count once; repeated documents are rows of their own; an empty benchmark leaves every document
clean; very long texts form a shard of their own; an empty table gives an empty result. Other columns of the input are
left aside by `contamination` and kept, whatever their names, by `decontaminated`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LARGE_ROWS, arrow_batches, chunks, free_name, words_of, written

#: Text of the test items that one pass carries.
BLOCK_BYTES = 2 << 20

#: Documents or shards that a task of the index or of a search gets at once.
BATCH = "8m"

INDEX_SCHEMA = "rows array<long>, ids array<long>, bounds binary, words binary, starts binary, positions binary"
HIT_SCHEMA = "row long, doc_id long, n_words long, spans array<long>, items array<string>, near_items array<string>"
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


@dataclass
class TestSet:
    """Windows as rows of term numbers (-1 pads short ones), the item of each, and the vocabulary."""

    vocabulary: dict[bytes, int]
    windows: np.ndarray
    lengths: np.ndarray
    item_of: np.ndarray
    items: list[str]
    near: np.ndarray  # rows of an item and the rarest three terms of one of its windows (-1 pads)


def make_windows(items: list[tuple[str, bytes]], window: int, rarity: Counter | None = None) -> TestSet:
    """items: name and text; texts of one name are one item, and a window that an item repeats counts once.

    rarity: how often each word is in the whole test set (if not given, in items); ties go to the earlier word of a window.
    """
    if rarity is None:
        rarity = word_counts(items)
    vocabulary: dict[bytes, int] = {}
    names: dict[str, int] = {}
    rows, lengths, item_of = [np.zeros((0, window), np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for name, text in items:
        number = names.setdefault(name, len(names))
        words = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text)], np.int32)
        if not len(words):
            continue
        if len(words) < window:
            rows.append(np.append(words, np.full(window - len(words), -1, np.int32))[None])
        else:
            rows.append(np.lib.stride_tricks.sliding_window_view(words, window))
        lengths.append(np.full(len(rows[-1]), min(window, len(words)), np.int64))
        item_of.append(np.full(len(rows[-1]), number, np.int64))
    windows, of_item = np.concatenate(rows), np.concatenate(item_of)
    often = np.array([*(rarity[w] for w in vocabulary), np.iinfo(np.int64).max], np.int64)  # the last one is the padding's
    rarest = np.take_along_axis(windows, np.argsort(often[windows], axis=1, kind="stable")[:, :3], axis=1)
    near = np.unique(np.column_stack([of_item, rarest]).astype(np.int64), axis=0)
    return TestSet(vocabulary, windows, np.concatenate(lengths), of_item, list(names), near)


def word_counts(items: list[tuple[str, bytes]]) -> Counter:
    return Counter(w for _, text in items for w in words_of(text))


class Numbers(dict):
    """Number of each word of a shard, in the order of their first sight."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def shard(texts: list[bytes | None]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """bounds (first position of each document, then the end), the vocabulary, starts of its posting lists, and the positions.

    One position is left free between documents, so no window reaches over.
    """
    numbers = Numbers()
    parts, bounds, at = [], [0], 0
    for text in texts:
        words = words_of(text)
        parts.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
        parts.append(np.array([-1], np.int32))
        at += len(words) + 1
        bounds.append(at)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    positions = np.argsort(flat, kind="stable")[np.count_nonzero(flat < 0) :].astype(np.int32)
    starts = np.append(0, np.cumsum(np.bincount(flat[positions], minlength=len(numbers)))).astype(np.int64)
    return np.array(bounds, np.int64), list(numbers), starts, positions


def postings(test: TestSet, words: list[bytes], starts: np.ndarray, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a shard's posting lists those of test terms, in the order of the terms: terms, starts and positions."""
    own = np.fromiter((test.vocabulary.get(w, -1) for w in words), np.int64, len(words))
    met = np.flatnonzero(own >= 0)
    met = met[np.argsort(own[met], kind="stable")]
    n = starts[met + 1] - starts[met]
    return own[met].astype(np.int32), np.append(0, np.cumsum(n)).astype(np.int64), positions[expand(starts[met], n)]


def expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ranges starts[i] .. starts[i] + counts[i] one after another."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts - starts, counts)


def pieces(starts: np.ndarray, counts: np.ndarray, limit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """The ranges starts[i] .. starts[i] + counts[i] in pieces of at most limit places, within a range too: from and to which range, starts and counts."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    for low in range(0, total, limit):
        high = min(low + limit, total)
        a, b = int(np.searchsorted(ends, low, side="right")), int(np.searchsorted(ends, high)) + 1
        begin, n = starts[a:b].copy(), counts[a:b].copy()
        done = low - (ends[a] - counts[a])
        begin[0] += done
        n[0] -= done
        n[-1] -= ends[b - 1] - high
        yield a, b, begin, n


def proximity(test: TestSet, first: np.ndarray, count: np.ndarray, key: np.ndarray, n_positions: int, positions: np.ndarray, slop: int, bounds: np.ndarray, candidates: int) -> tuple[np.ndarray, np.ndarray]:
    """(item, document) where all rarest terms of a window are within slop of the rarest one; its other words don't matter."""
    none = np.zeros(0, np.int64)
    size = len(test.vocabulary)
    terms = np.where(test.near[:, 1:] >= 0, test.near[:, 1:], size)
    live = np.flatnonzero(((count[terms] > 0) | (terms == size)).all(axis=1))
    found = [np.stack([none, none])]
    for a, b, begin, n in pieces(first[terms[live, 0]], count[terms[live, 0]], candidates):
        row = np.repeat(live[a:b], n)
        at = positions[expand(begin, n)].astype(np.int64)
        doc = np.searchsorted(bounds, at, side="right") - 1
        for k in range(1, terms.shape[1]):
            other = terms[row, k]
            base = other * (n_positions + 1)
            # Next posting of the other term at or after the lowest place.
            nxt = np.searchsorted(key, base + np.maximum(at - slop, bounds[doc]))
            got = key[np.minimum(nxt, len(key) - 1)]
            ok = (other == size) | ((nxt < len(key)) & (got <= base + np.minimum(at + slop, bounds[doc + 1] - 1)))
            row, at, doc = row[ok], at[ok], doc[ok]
        found.append(np.unique(np.stack([test.near[row, 0], doc]), axis=1))
    return tuple(np.unique(np.concatenate(found, axis=1), axis=1))


def intersect(test: TestSet, n_positions: int, terms: np.ndarray, starts: np.ndarray, positions: np.ndarray, slop: int, bounds: np.ndarray, candidates: int = 1 << 19) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Exact matches (window, start) and proximity matches (item, document) of one shard.

    candidates: so many places are looked at in one step at most.
    """
    none = np.zeros(0, np.int64)
    if not len(terms) or not len(test.windows):
        return none, none, none, none
    size = len(test.vocabulary)
    first, count = np.zeros(size + 1, np.int64), np.zeros(size + 1, np.int64)
    first[terms], count[terms] = starts[:-1], np.diff(starts)
    near_i = near_d = none
    # Lists are sorted, so term and position make one sorted key.
    key = np.repeat(terms.astype(np.int64), np.diff(starts)) * (n_positions + 1) + positions
    if slop:
        near_i, near_d = proximity(test, first, count, key, n_positions, positions, slop, bounds, candidates)
    at = np.where(test.windows >= 0, test.windows, size)
    there = count > 0
    there[size] = True
    live = np.flatnonzero(there[at].all(axis=1))  # a term without postings here: no match here
    lists = np.where(test.windows[live] >= 0, count[at[live]], np.iinfo(np.int64).max)
    order = np.argsort(lists, axis=1, kind="stable")  # rarest first; padding last
    offsets = order[:, 0]
    rarest = test.windows[live, offsets]
    found_w, found_s = [none], [none]
    for a, b, begin, n in pieces(first[rarest], count[rarest], candidates):
        row = np.repeat(np.arange(a, b), n)
        begin = positions[expand(begin, n)] - offsets[row]
        # An occurrence that would leave the shard is none.
        ok = (begin >= 0) & (begin + test.lengths[live[row]] <= n_positions)
        begin, row = begin[ok], row[ok]
        for k in range(1, test.windows.shape[1]):
            place = order[row, k]
            term = test.windows[live[row], place]
            # In the term's list, adjusted by its offset in the window?
            wanted = np.maximum(term, 0) * np.int64(n_positions + 1) + begin + place
            ok = (term < 0) | (key[np.minimum(np.searchsorted(key, wanted), len(key) - 1)] == wanted)
            begin, row = begin[ok], row[ok]
        found_w.append(live[row])
        found_s.append(begin)
    return np.concatenate(found_w), np.concatenate(found_s), near_i, near_d


def build_index(docs: DataFrame) -> DataFrame:
    """Shards with the postings of all words. docs: row, doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            for a, b in chunks(sizes):
                columns = [pa.array([batch.column(c).slice(a, b - a).to_pylist()], pa.list_(pa.int64())) for c in (0, 1)]
                bounds, words, starts, positions = shard(texts.slice(a, b - a).to_pylist())
                columns += [pa.array([x], pa.binary()) for x in (bounds.tobytes(), b" ".join(words), starts.tobytes(), positions.tobytes())]
                yield pa.RecordBatch.from_arrays(columns, ["rows", "ids", "bounds", "words", "starts", "positions"])

    return docs.select("row", "doc_id", "text").mapInArrow(run, INDEX_SCHEMA)


def search(index: DataFrame, test, slop: int) -> DataFrame:
    """Per document: words, the spans of hit words (start, end, start, end, ...), items with exact and with proximity matches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t: TestSet = test.value
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                bounds, starts, positions = (np.frombuffer(row[c], k) for c, k in (("bounds", np.int64), ("starts", np.int64), ("positions", np.int32)))
                terms, starts, positions = postings(t, row["words"].split(), starts, positions)
                n, n_docs = int(bounds[-1]), len(row["ids"])
                window, begin, near_i, near_d = intersect(t, n, terms, starts, positions, slop, bounds)
                edge = np.bincount(begin, minlength=n + 1) - np.bincount(begin + t.lengths[window], minlength=n + 1)
                change = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(edge) > 0, [0]])))
                doc = np.searchsorted(bounds, change[::2], side="right") - 1
                spans, exact, near = ([[] for _ in range(n_docs)] for _ in range(3))
                for d, a, b in zip(doc.tolist(), (change[::2] - bounds[doc]).tolist(), (change[1::2] - bounds[doc]).tolist()):
                    spans[d] += [a, b]
                for lists, i, d in ((exact, t.item_of[window], np.searchsorted(bounds, begin, side="right") - 1), (near, near_i, near_d)):
                    for i, d in np.unique(np.stack([i, d]), axis=1).T.tolist():
                        lists[d].append(t.items[i])
                columns = [pa.array(row["rows"], pa.int64()), pa.array(row["ids"], pa.int64()), pa.array(np.diff(bounds) - 1, pa.int64()), pa.array(spans, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(x, pa.list_(pa.string())) for x in (exact, near)], ["row", "doc_id", "n_words", "spans", "items", "near_items"])

    return index.mapInArrow(run, HIT_SCHEMA)


def blocks_of(benchmark: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[str, bytes]]]:
    """The test items in blocks of about limit bytes, an item at a time from the cluster."""
    block, total = [], 0
    for name, text in benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string"), F.encode("text", "UTF-8")).toLocalIterator():
        if block and total + len(text) > limit:
            yield block
            block, total = [], 0
        block.append((name, bytes(text)))
        total += len(text)
    yield block


def merge(found: DataFrame) -> DataFrame:
    """One row per document from the rows of several blocks: the union of spans and items."""
    lists = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.collect_list("spans").alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.array_distinct(F.flatten(F.collect_list("near_items"))).alias("near_items"))

    @F.udf("array<long>")
    def union(spans: list[list[int]]) -> list[int]:
        out: list[int] = []
        for a, b in sorted((s[i], s[i + 1]) for s in spans for i in range(0, len(s), 2)):
            if out and a <= out[-1]:
                out[-1] = max(out[-1], b)
            else:
                out += [a, b]
        return out

    return lists.withColumn("spans", union("spans"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, slop: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, row (a number per input row), n_words, n_hit, spans, items, near_items: one row per document."""
    keyed = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    with arrow_batches(docs.sparkSession, BATCH):
        index = written(build_index(keyed), "positional-index", **LARGE_ROWS)
        found = [written(search(index, test, slop), "hits") for _, _, test in tests_of(benchmark, window, block_bytes)]
    hits = found[0]
    if len(found) > 1:
        # A document is a row of the first block's hits; of the others only matches count.
        hits = merge(reduce(DataFrame.unionByName, [hits, *(f.where("size(items) > 0 or size(near_items) > 0") for f in found[1:])]))
    n_hit = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return hits.withColumn("n_hit", n_hit)


def digest(hits: DataFrame) -> DataFrame:
    """The contract's columns."""
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.sort_array("items"), ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.size("near_items").cast("long").alias("n_near_items"))


def tests_of(benchmark: DataFrame, window: int, block_bytes: int) -> Iterator[tuple[int, bool, object]]:
    """Number, whether it is the last one, and the broadcast test set of each block; a block is let go when the next is asked for.

    How rare a word is counts the whole test set; with several blocks Spark counts, and each block gets its own words' counts.
    """
    spark = benchmark.sparkSession
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.explode(F.regexp_extract_all(lowered, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0)))
    all_counts = benchmark.where("item_id is not null and text is not null").select(words.alias("word")).groupBy("word").count()
    blocks = blocks_of(benchmark, block_bytes)
    block, k = next(blocks), 0
    while block is not None:
        following = next(blocks, None)
        rarity = word_counts(block)
        if k or following is not None:
            own = spark.createDataFrame([(w.decode(),) for w in rarity], "its_word string")
            rarity = Counter({r.word.encode(): r["count"] for r in all_counts.join(F.broadcast(own), F.col("word") == F.col("its_word")).select("word", "count").toLocalIterator()})
        test = spark.sparkContext.broadcast(make_windows(block, window, rarity))
        yield k, following is None, test
        if following is not None:
            test.unpersist()
        block, k = following, k + 1


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents with every hit word cut out of the text, columns as before; text between cuts stays as it is.

    Cutting keeps what a document has besides the test passage, and goes on where what is left forms a window again, of
    the same block or of another one. A document of which nothing but separators would be left goes. A column n_chars is
    the new text's length where it changed. As what an index finds takes effect in the text it was made from, each task
    indexes and searches its own shards and cuts in the same pass, so that no text is shuffled; the index isn't stored.
    """
    flag = free_name(docs, "changed")
    columns = docs.columns
    current, settled = docs.withColumn(flag, F.lit(False)), []
    while True:
        for k, last, test in tests_of(benchmark, window, block_bytes):
            cutting = cut_hits(current, test, flag)
            if last and not k:
                return cutting.select(*[F.col(f"`{c}`") for c in columns])  # one block looks again by itself
            current = written(cutting, "decontaminated")
        # What a block changed may hold another block's window now.
        settled.append(current.where(~F.col(flag)))
        again = current.where(flag)
        if again.isEmpty():
            return reduce(DataFrame.unionByName, settled).select(*[F.col(f"`{c}`") for c in columns])
        current = again.withColumn(flag, F.lit(False))


def cut_hits(docs: DataFrame, test, flag: str) -> DataFrame:
    """docs without the hit words of one block, flag set where a text changed."""
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t: TestSet = test.value
        for batch in batches:
            texts = batch.column(at).cast(pa.binary())
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            for a, b in chunks(sizes):
                part, own = batch.slice(a, b - a), texts.slice(a, b - a).to_pylist()
                look, changed = list(range(b - a)), set()
                while look:
                    bounds, *lists = shard([own[i] for i in look])
                    n = int(bounds[-1])
                    found, begin, _, _ = intersect(t, n, *postings(t, *lists), 0, bounds)
                    edge = np.bincount(begin, minlength=n + 1) - np.bincount(begin + t.lengths[found], minlength=n + 1)
                    hit = np.cumsum(edge) > 0
                    again = np.unique(np.searchsorted(bounds, begin, side="right") - 1).tolist()
                    for d in again:
                        own[look[d]] = without(own[look[d]], hit[bounds[d] : bounds[d + 1] - 1])
                    look = [look[d] for d in again]
                    changed.update(look)
                if changed:
                    columns = list(part.columns)
                    columns[at] = pa.array(own, pa.binary()).cast(columns[at].type)
                    is_changed = pa.array([i in changed for i in range(b - a)])
                    columns[names.index(flag)] = pc.or_(columns[names.index(flag)], is_changed)
                    if "n_chars" in names:
                        k = names.index("n_chars")
                        columns[k] = pc.if_else(is_changed, pc.utf8_length(columns[at].cast(pa.string())).cast(columns[k].type), columns[k])
                    keep = pa.array([i not in changed or bool(words_of(own[i])) for i in range(b - a)])
                    part = pa.RecordBatch.from_arrays(columns, schema=part.schema).filter(keep)
                yield part

    return docs.mapInArrow(run, docs.schema)


def without(text: bytes, hit: np.ndarray) -> bytes:
    """The text without its hit words (and the separators between two of them); UTF-8 stays whole, as words hold all non-ASCII bytes."""
    out, at = [], 0
    places = [m.span() for m in _WORD.finditer(text)]
    change = np.flatnonzero(np.diff(np.concatenate([[0], hit, [0]])))
    for a, b in zip(change[::2].tolist(), change[1::2].tolist()):
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, text[at:]])
