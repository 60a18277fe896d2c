"""Ranked word search by TPUT over term-partitioned postings.

`build_index` tokenises every document once, in tasks, and writes postings (term, row, doc_id, times, length) dealt and
sorted by term; a frequent term's list lies in as many parts as its size needs. With `terms`, only these terms' lists are
written; every document counts in the statistics all the same. A document's own posting (no term) holds its length, so
the statistics are read from the index too.

`top_documents` ranks the documents for all items at once, in TPUT's three phases, each a few joins and aggregations:

1. The head of every list, its `limit` best postings, is fetched. The sums of what an item's heads hold are lower
   bounds; the limit-th largest, tau, is one for the limit-th best document.
2. A document above tau has a value of at least tau / m in one of the item's m lists. Every list gives all its postings
   with a value of at least a SLACK-th of that for some item (the more, the closer the bounds); they meet by document, once for all items, and are added up there. What is missing
   in a list is below the threshold, so each found document has an upper bound; those whose upper bound is below the
   new limit-th lower bound go, first among a task's own documents, then among all.
3. The candidates' postings in all of the item's lists are looked up, and their exact scores ranked.

Nothing is cut off before phase 3: a document that isn't a candidate can't be among the best. Items are handled in
blocks of at most BLOCK_TERMS terms (one item at least), so what goes to the driver and to all executors is bounded.

Weights and scores are whole numbers as `weight`, `NORM` and `IMPACT` say. Defined cases: null texts have no terms, and
documents without terms aren't counted; rows of one doc_id are documents of their own, equal scores are ranked by doc_id
(null last), then by row; rows of one item are one item (null ids too), and its repeated terms count once; an item
without terms, or without a document above 0, has no result; texts are read whole, however long; empty tables give an
empty result; other columns are left aside.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, new_folder, words_of, written

POSTING = "term string, row long, doc_id long, times int, length int"
#: Terms of a block of items; its lists' heads go to the driver.
BLOCK_TERMS = 50_000
#: The threshold is so many times lower than need be: what a document misses adds less to its upper bound.
SLACK = 8
#: Postings that a task adds up at once, and bounds that it holds back at most.
CHUNK_POSTINGS = 200_000
HELD_BOUNDS = 500_000
#: Rows that a table that goes to all executors has at most; beyond, Spark joins by shuffles.
BROADCAST_ROWS = 200_000
#: Of a document, from its length, all documents N and all terms L; of a posting, before its term's weight.
NORM = "100 - 90 + ((90L * length * N) DIV L)"
IMPACT = f"(1000000000L * times) DIV (1000L * times + 8 * ({NORM}))"


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


@dataclass
class Index:
    postings: DataFrame

    @property
    def lists(self) -> DataFrame:
        return self.postings.where("term is not null")

    def figures(self) -> tuple[int, int]:
        """Documents that have a term, and all their terms."""
        r = self.postings.where("term is null and length > 0").agg(F.count("*").alias("n"), F.sum("length").alias("all")).first()
        return r.n, r.all or 0


def build_index(docs: DataFrame, terms: DataFrame | None = None) -> Index:
    """docs: doc_id, text. terms: those (term) whose lists are wanted; all, if not given or more than a task should hold."""
    spark = docs.sparkSession
    wanted: Broadcast | None = None
    if terms is not None:
        found = terms.where("term is not null").select("term").distinct().limit(BROADCAST_ROWS + 1).collect()
        if len(found) <= BROADCAST_ROWS:
            wanted = spark.sparkContext.broadcast(frozenset(r.term.encode() for r in found))

    def block(rows: list[tuple[int, int | None, Counter, int]]) -> pa.RecordBatch:
        """A row per term of a block of documents, and one for the documents."""
        lists: dict[bytes | None, list[tuple[int, int]]] = {None: [(i, 0) for i in range(len(rows))]}
        for i, (*_, counts, _) in enumerate(rows):
            for word, k in counts.items():
                lists.setdefault(word, []).append((i, k))
        at = np.array([i for own in lists.values() for i, _ in own])
        times = pa.array([k for own in lists.values() for _, k in own], pa.int32())
        offsets = pa.array(np.cumsum([0, *map(len, lists.values())]), pa.int32())
        of = lambda values, kind=pa.int64(): pa.ListArray.from_arrays(offsets, pa.array(values, kind).take(pa.array(at)))
        terms_ = pa.array([None if w is None else w.decode() for w in lists], pa.string())
        return pa.RecordBatch.from_arrays(
            [terms_, pa.array([rows[0][0]] * len(lists)), of([r[0] for r in rows]), of([r[1] for r in rows]), pa.ListArray.from_arrays(offsets, times), of([r[3] for r in rows], pa.int32())],
            ["term", "block", "row", "doc_id", "times", "length"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        only = wanted.value if wanted else None
        for batch in batches:
            for row, doc_id, text in zip(*batch.columns):
                raw = text.as_py()
                words = words_of(raw)
                counts = Counter(words if only is None else filter(only.__contains__, words))
                rows.append((row.as_py(), doc_id.as_py(), counts, len(words)))
                size += len(raw or b"") + 100
                if size > CHUNK_BYTES:
                    yield block(rows)
                    rows, size = [], 0
        if rows:
            yield block(rows)

    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    blocks = source.mapInArrow(run, "term string, block long, row array<long>, doc_id array<long>, times array<int>, length array<int>")
    # The documents' own postings have no term that could deal them out.
    dealt = blocks.withColumn("part", F.coalesce("term", F.col("block").cast("string"))).hint("rebalance", F.col("part")).sortWithinPartitions("term", "block")
    postings = dealt.select("term", F.inline(F.arrays_zip("row", "doc_id", "times", "length")))
    path = new_folder(spark, "term-postings")
    postings.write.parquet(path)
    return Index(spark.read.schema(POSTING).parquet(path))


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term: each item's distinct terms. items: item_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, w) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for w in set(words_of(t))]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([w.decode() for _, w in found], pa.string())], ["item_id", "term"])

    return items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "item_id long, term string").distinct()


def small(df: DataFrame) -> DataFrame:
    """Marked for all executors, if a count says that it is small enough."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def best(df: DataFrame, keys: list[str], order: list, limit: int, rank: str = "rank") -> DataFrame:
    """The first rows of each key; Spark keeps so many a key within tasks before it shuffles."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= limit)


@dataclass
class Asked:
    """What a block of items asks of the lists, by list: its items, their thresholds, and per item its lists and tau."""

    items: list[int | None]
    terms: dict[str, int]
    weights: np.ndarray
    begin: np.ndarray
    item: np.ndarray
    count: np.ndarray
    tau: np.ndarray
    limit: int

    @property
    def least(self) -> np.ndarray:
        """The least impact that each item wants of each list, along item."""
        w = np.repeat(self.weights, np.diff(self.begin))
        m, tau = self.count[self.item], self.tau[self.item]
        return np.maximum(1, (tau + SLACK * w * m - 1) // (SLACK * w * m))

    def lower_bounds(self, term: np.ndarray, row: np.ndarray, impact: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """item, row, the sum of the values that its lists give, and in how many lists it is."""
        held = np.diff(self.begin)[term]
        at = np.repeat(self.begin[term] - (np.cumsum(held) - held), held) + np.arange(held.sum())
        value, its_row = np.repeat(impact, held), np.repeat(row, held)
        met = value >= least[at]
        at, value, its_row = at[met], value[met], its_row[met]
        value *= np.repeat(self.weights, np.diff(self.begin))[at]
        rows, number = np.unique(its_row, return_inverse=True)
        key = number * len(self.items) + self.item[at]
        order = np.argsort(key, kind="stable")
        key = key[order]
        begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        sums = np.add.reduceat(value[order], begin) if len(key) else np.zeros(0, np.int64)
        return key[begin] % len(self.items), rows[key[begin] // len(self.items)], sums, np.diff(np.r_[begin, len(key)])

    def last_best(self, item: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Each item's limit-th largest value; 0 if it has fewer."""
        order = np.lexsort((-value, item))
        item, value = item[order], value[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        out = np.zeros(len(self.items), np.int64)
        out[item[rank == self.limit - 1]] = value[rank == self.limit - 1]
        return out


def asked_blocks(terms: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    block: list[tuple[int | None, str]] = []
    for r in terms.orderBy("item_id", "term").toLocalIterator():
        if len(block) >= BLOCK_TERMS and block[-1][0] != r.item_id:
            yield block
            block = []
        block.append((r.item_id, r.term))
    if block:
        yield block


def top_documents(index: Index, terms: DataFrame, limit: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: each item's best documents. terms: item_id, term, as item_terms gives them."""
    out = None
    for block in asked_blocks(terms):
        found = top_of_block(index, block, limit)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else terms.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def top_of_block(index: Index, block: list[tuple[int | None, str]], limit: int) -> DataFrame:
    spark = index.postings.sparkSession
    n, total = index.figures()
    figures = [F.lit(n).cast("long").alias("N"), F.lit(max(total, 1)).cast("long").alias("L")]
    values = index.lists.select("*", *figures).select("term", "row", "doc_id", F.expr(IMPACT).alias("impact"))
    wanted = spark.createDataFrame([(t,) for t in sorted({t for _, t in block})], "term string")
    often = {r.term: r.df for r in index.lists.join(F.broadcast(wanted), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df")).collect()}
    # Lists that can't add to a score are none.
    lists = {t: w for t, df in sorted(often.items()) if (w := weight(n, df)) > 0}
    number = {t: i for i, t in enumerate(lists)}
    items = list(dict.fromkeys(i for i, _ in block))
    at = {i: k for k, i in enumerate(items)}
    pairs = np.array(sorted((number[t], at[i]) for i, t in block if t in number), np.int64).reshape(-1, 2)
    begin = np.searchsorted(pairs[:, 0], np.arange(len(lists) + 1))
    asked = Asked(items, number, np.array(list(lists.values()), np.int64), begin, pairs[:, 1], np.bincount(pairs[:, 1], minlength=len(items)), np.zeros(len(items), np.int64), limit)

    # 1. Heads and lower bounds.
    numbered = spark.createDataFrame(list(number.items()), "term string, list long")
    heads = best(values.join(F.broadcast(numbered), "term"), ["list"], [F.desc("impact"), "row"], limit).select("list", "row", "impact").toPandas()
    item, _, lower, _ = asked.lower_bounds(heads["list"].to_numpy(np.int64), heads["row"].to_numpy(np.int64), heads["impact"].to_numpy(np.int64), np.ones(len(pairs), np.int64))
    asked.tau = asked.last_best(item, lower)

    # 2. All postings at or above the lowest threshold that an item sets for a list, and bounds where they meet by document.
    lowest = np.minimum.reduceat(asked.least, begin[:-1]).tolist() if len(lists) else []
    wanted = spark.createDataFrame([(t, i, x) for (t, i), x in zip(number.items(), lowest)], "term string, list long, lowest long")
    above = values.join(F.broadcast(wanted), "term").where("impact >= lowest").select("row", "list", "impact")
    shared = spark.sparkContext.broadcast(asked)

    names = ["item", "row", "lower", "upper"]

    def still(bounds: list[np.ndarray], own: np.ndarray) -> list[np.ndarray]:
        keep = bounds[3] >= np.maximum(own, shared.value.tau)[bounds[0]]
        return [x[keep] for x in bounds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        least, own = asked.least, np.zeros(len(asked.items), np.int64)
        held = [np.zeros(0, np.int64)] * 4
        best_item, best_value = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for row, list_, impact in by_rows(batches):
            item, its_row, lower, k = asked.lower_bounds(list_, row, impact, least)
            m, tau = asked.count[item], asked.tau[item]
            upper = lower + np.where(tau > 0, (m - k) * ((tau - 1) // (SLACK * m)), 0)
            better = lower > own[item]
            best_item, best_value = np.r_[best_item, item[better]], np.r_[best_value, lower[better]]
            own = np.maximum(own, asked.last_best(best_item, best_value))
            keep = best_value >= own[best_item]
            best_item, best_value = best_item[keep], best_value[keep]
            held = still([np.concatenate(c) for c in zip(held, (item, its_row, lower, upper))], own)
            if len(held[0]) > HELD_BOUNDS:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names)
                held = [x[:0] for x in held]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names)

    bounded = written(above.repartition("row").sortWithinPartitions("row").mapInArrow(run, "item long, row long, lower long, upper long"), "search-bounds")
    tau2 = best(bounded.select("item", "lower"), ["item"], [F.desc("lower")], limit).where(F.col("rank") == limit).select("item", F.col("lower").alias("tau2"))
    candidates = written(bounded.join(F.broadcast(tau2), "item", "left").where("tau2 is null or upper >= tau2").select("item", "row"), "search-candidates")

    # 3. Exact scores.
    by_list = spark.createDataFrame([(t, w, items[j], int(j)) for (t, i), w in zip(number.items(), lists.values()) for j in pairs[begin[i] : begin[i + 1], 1]], "term string, w long, item_id long, item long")
    own = values.join(small(candidates.select("row").distinct()), "row", "left_semi").join(F.broadcast(by_list), "term")
    exact = own.join(small(candidates), ["item", "row"], "left_semi").groupBy("item", "item_id", "row", "doc_id").agg(F.sum(F.expr("w * impact")).alias("score")).where("score > 0")
    ranked = best(exact, ["item"], [F.desc("score"), F.asc_nulls_last("doc_id"), "row"], limit)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def by_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks of postings that are sorted by their first column, whose values aren't torn apart."""
    held: list[list[np.ndarray]] = []
    size = 0
    for batch in batches:
        held.append([c.to_numpy() for c in batch.columns])
        size += len(batch)
        if size >= CHUNK_POSTINGS and held[0][0][0] != held[-1][0][-1]:
            first, *rest = (np.concatenate(c) for c in zip(*held))
            end = int(np.searchsorted(first, first[-1]))
            yield first[:end], *(x[:end] for x in rest)
            held, size = [[first[end:], *(x[end:] for x in rest)]], len(first) - end
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held))


def search(docs: DataFrame, items: DataFrame, limit: int = 10) -> DataFrame:
    """The best documents for each item; the index holds the items' terms."""
    terms = written(item_terms(items), "search-terms")
    return top_documents(build_index(docs, terms), terms, limit)


#: The same ranking in plain SQL, over all postings.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d WHERE len(t) > 0),
p AS (SELECT r, doc_id, len(t) AS length, unnest(t) AS term FROM d),
tf AS (SELECT r, doc_id, length, term, count(*) AS times FROM p GROUP BY ALL),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM df, s),
e AS (SELECT i.item_id, tf.r, tf.doc_id, CAST(sum(w.w * ((1000000000 * times) // (1000 * times + 8 * (100 - 90 + (90 * length * n_docs) // n_terms)))) AS BIGINT) AS score
      FROM i JOIN tf USING (term) JOIN w USING (term), s GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM e WHERE score > 0 QUALIFY rank <= 10
"""
