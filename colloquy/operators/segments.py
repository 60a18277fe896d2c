"""A stored word index in segments: postings with positions, by buckets of terms, and each segment's statistics.

A segment holds the postings (term, key, length, positions) of the rows that were added at once, as Parquet under
`postings/segment=.../bucket=...`, sorted by term. A term's bucket is its crc32, so a search knows which folders to read
before it asks Spark, and the sort lets Parquet skip other terms inside them. A row's postings are gathered and written
by the task that reads the row: nothing is shuffled, and a frequent term's postings lie in the files of many tasks. `figures/segment=...` has one row a segment: rows,
words and the largest key. A segment that is added again replaces its old self.

A query is a list of phrases: each part between blanks is one, of one or more words (`e-mail` is a phrase of two). A row
matches if it holds all phrases. The score is bm25 with the usual constants, where a phrase counts as a term; a phrase in
over half of the rows adds next to nothing, as its inverse frequency is held above zero.

The snippet of a match is the stretch of at most `words` words with most of the query's phrases, then most of their
occurrences, then the first one; what lies around its occurrences is shared out to both sides, and phrases are marked.

Defined cases: null and empty texts are rows without words; a null key is indexed like any other; rows with one key are
one row if they are in one segment, and are not told apart (a search puts their postings together); a query without words finds nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from .search import B, K1, MARKED, PLAIN, TOKEN, folded, tokens

BUCKETS = 64
#: Words whose postings a task gathers at once; one longer row is gathered whole.
PIECE_WORDS = 1 << 20
#: What keeps the inverse frequency of a common phrase above zero.
LEAST_IDF = 1e-6
SNIPPET_WORDS = 32
_PIECE = r"[\p{L}\p{N}]+[^\p{L}\p{N}]*"
_WORD = r"^[\p{L}\p{N}]+"


def bucket_of(term: str, buckets: int = BUCKETS) -> int:
    return zlib.crc32(term.encode()) % buckets


def phrases_of(query: str) -> list[list[str]]:
    """The query's phrases, each once; signs that operators are written with separate phrases."""
    table = str.maketrans(MARKED, PLAIN)
    cleaned = "".join(" " if ch in '"()*^{}' else ch for ch in query).lower().translate(table)
    found = ["".join(ch if ch.isalnum() else " " for ch in part).split() for part in cleaned.split()]
    return [list(p) for p in dict.fromkeys(tuple(p) for p in found if p)]


def pieces(ends: np.ndarray, words: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of up to so many words together; a longer row is a range of its own. ends: where each row's words end."""
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + words, "right")))
        yield a, b
        a = b


def gathered(batch: pa.RecordBatch, buckets: int) -> pa.RecordBatch:
    """Postings of rows (key, words)."""
    n = batch.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int32)
    words = batch.column(1).flatten().dictionary_encode()
    codes, row = words.indices.to_numpy(), np.repeat(np.arange(len(n), dtype=np.int32), n)
    places = np.arange(len(codes), dtype=np.int32) - np.repeat(np.cumsum(n, dtype=np.int32) - n, n)
    # Rows and places ascend already: a stable order by term keeps both.
    order = np.argsort(codes, kind="stable")
    codes, row, places = codes[order], row[order], places[order]
    first = np.flatnonzero(np.append(True, (codes[1:] != codes[:-1]) | (row[1:] != row[:-1])) if len(codes) else [])
    of_term = np.array([bucket_of(t, buckets) for t in words.dictionary.to_pylist()], np.int32)
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(codes)), pa.int32()), pa.array(places))
    codes, row = codes[first], row[first]
    return pa.RecordBatch.from_arrays([pa.array(of_term[codes]), words.dictionary.take(pa.array(codes)), batch.column(0).take(pa.array(row)), pa.array(n[row]), lists], ["bucket", "term", "key", "length", "positions"])


def postings_of(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, term, key, length and positions of rows (key, words): one row per term of a row, gathered where the row is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(batch.column(1).value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
            for a, b in pieces(ends, PIECE_WORDS):
                yield gathered(batch.slice(a, b - a), buckets)

    schema = StructType().add("bucket", IntegerType()).add("term", StringType()).add("key", rows.schema["key"].dataType).add("length", IntegerType()).add("positions", ArrayType(IntegerType()))
    return rows.select("key", "words").mapInArrow(run, schema)


def add_segment(docs: DataFrame, key: str, text: str, folder: str, name: str, buckets: int = BUCKETS, shards: int | None = None) -> None:
    """Writes the rows of docs as segment `name`, in place of an older one of that name. shards: how many tasks write it, by default as many as read docs."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    dealt = rows if shards is None else rows.repartition(shards)
    placed = postings_of(dealt.select("key", tokens(F.col("text")).alias("words")), buckets)
    placed.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings/segment={name}")
    figures = rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.regexp_count(folded(F.col("text")), F.lit(TOKEN))), F.lit(0)).alias("words"), F.max("key").alias("newest"))
    figures.write.mode("overwrite").parquet(f"{folder}/figures/segment={name}")


@dataclass
class Index:
    spark: SparkSession
    folder: str
    buckets: int = BUCKETS

    def postings(self, terms: list[str]) -> DataFrame:
        """term, key, length, positions of these terms, from their buckets only."""
        kept = sorted({bucket_of(t, self.buckets) for t in terms})
        own = self.spark.read.parquet(f"{self.folder}/postings").where(F.col("bucket").isin(kept) & F.col("term").isin(sorted(set(terms))))
        together = own.groupBy("segment", "term", "key").agg(F.first("length").alias("length"), F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
        return together.select("term", "key", "length", "positions")

    def figures(self) -> DataFrame:
        """One row: rows, words and newest of all segments."""
        return self.spark.read.parquet(f"{self.folder}/figures").agg(F.sum("rows").alias("rows"), F.sum("words").alias("words"), F.max("newest").alias("newest"))

    def lag(self, docs: DataFrame, key: str) -> DataFrame:
        """One row: newest, indexed, lag. The index's part is read from its figures."""
        newest = docs.agg(F.max(key).alias("newest"))
        return newest.join(F.broadcast(self.figures().select(F.col("newest").alias("indexed")))).select("newest", "indexed", (F.col("newest") - F.coalesce("indexed", F.lit(0))).alias("lag"))

    def occurrences(self, phrases: list[list[str]]) -> DataFrame:
        """phrase (its number), key, length, starts: where each phrase begins in the rows that hold it."""
        wanted = self.spark.createDataFrame([(w, i, j, len(p)) for i, p in enumerate(phrases) for j, w in enumerate(p)], "term string, phrase int, offset int, size int")
        own = self.postings([w for p in phrases for w in p]).join(F.broadcast(wanted), "term").withColumn("starts", F.transform("positions", lambda x: x - F.col("offset")))
        one = own.where("size = 1").select("phrase", "key", "length", "starts")
        if all(len(p) == 1 for p in phrases):
            return one
        several = own.where("size > 1").groupBy("phrase", "key").agg(F.first("length").alias("length"), F.first("size").alias("size"), F.collect_list("starts").alias("all"))
        met = several.where(F.size("all") == F.col("size")).select("phrase", "key", "length", F.array_sort(F.reduce(F.slice("all", 2, 1 << 30), F.element_at("all", 1), F.array_intersect)).alias("starts"))
        return one.unionByName(met.where(F.size("starts") > 0))

    def search(self, query: str, limit: int = 20, among: DataFrame | None = None) -> DataFrame:
        """key, score, hits (phrase, at, size) of the best rows; among: the keys (column key) that count, all if not given."""
        phrases = phrases_of(query)
        if not phrases:
            return self.postings([]).select("key", F.lit(0.0).alias("score"), F.array().cast("array<struct<phrase:int,at:int,size:int>>").alias("hits")).limit(0)
        found = self.occurrences(phrases)
        holders = found.groupBy("phrase").agg(F.count("*").alias("holders"))
        weighed = found.join(F.broadcast(holders), "phrase").join(F.broadcast(self.figures()))
        idf = F.greatest(F.log((F.col("rows") - F.col("holders") + 0.5) / (F.col("holders") + 0.5)), F.lit(LEAST_IDF))
        times = F.size("starts")
        part = idf * times * (K1 + 1) / (times + K1 * (1 - B + B * F.col("length") * F.col("rows") / F.col("words")))
        sizes = F.array(*[F.lit(len(p)) for p in phrases])
        hits = F.transform("starts", lambda x: F.struct(F.col("phrase").alias("phrase"), x.alias("at"), F.get(sizes, F.col("phrase")).alias("size")))
        met = weighed.groupBy("key").agg(F.count("*").alias("n"), F.round(F.sum(part), 4).alias("score"), F.flatten(F.collect_list(hits)).alias("hits")).where(F.col("n") == len(phrases))
        if among is not None:
            met = met.join(among.select("key").distinct(), "key", "left_semi")
        return met.select("key", "score", "hits").orderBy(F.desc("score"), "key").limit(limit)


def best_stretches(found: DataFrame, words: int = SNIPPET_WORDS) -> DataFrame:
    """key, first, last: of found (key, hits), the places of the first and behind the last occurrence in the best stretch."""
    each = found.select("key", F.inline("hits"))
    ahead = Window.partitionBy("key").orderBy("at").rangeBetween(0, words - 1)
    scored = each.select("key", "at", F.size(F.collect_set("phrase").over(ahead)).alias("kinds"), F.count("*").over(ahead).alias("n"), F.max(F.col("at") + F.col("size")).over(ahead).alias("last"))
    return scored.groupBy("key").agg(F.max(F.struct("kinds", "n", (-F.col("at")).alias("back"), "last")).alias("best")).select("key", (-F.col("best.back")).alias("first"), F.col("best.last").alias("last"))


def marked(pieces: Column, starts: Column, begin: Column, end: Column, before: str, after: str) -> Column:
    """The pieces from begin to end (words with what follows them) as text, occurrences (at, size) marked, touching ones together."""
    inside = lambda i: F.exists(starts, lambda h: (h["at"] <= i) & (i < h["at"] + h["size"]))
    begins = lambda i: F.exists(starts, lambda h: h["at"] == i) & ~F.exists(starts, lambda h: (h["at"] < i) & (i < h["at"] + h["size"]))
    ends = lambda i: F.exists(starts, lambda h: h["at"] + h["size"] == i + 1) & ~F.exists(starts, lambda h: (h["at"] <= i) & (i + 1 < h["at"] + h["size"]))

    def shown(i: Column) -> Column:
        piece = F.get(pieces, i)
        word = F.regexp_extract(piece, _WORD, 0)
        gap = F.when(i + 1 < end, F.substr(piece, F.length(word) + 1)).otherwise("")
        return F.when(inside(i), F.concat(F.when(begins(i), before).otherwise(""), word, F.when(ends(i), after).otherwise(""), gap)).otherwise(F.concat(word, gap))

    return F.array_join(F.transform(F.sequence(begin, end - 1), shown), "")


def with_snippets(found: DataFrame, docs: DataFrame, key: str, text: str, words: int = SNIPPET_WORDS, before: str = "<mark>", after: str = "</mark>", dots: str = "...") -> DataFrame:
    """found (key, score, hits) with snippet in place of hits. found is a search's result: as many rows as its limit."""
    placed = found.join(best_stretches(found, words), "key")
    texts = docs.select(F.col(key).alias("its_key"), F.col(text).alias("its_text")).join(F.broadcast(placed), F.col("its_key") == F.col("key"))
    cut = texts.withColumn("pieces", F.regexp_extract_all("its_text", F.lit(_PIECE), F.lit(0)))
    n = F.size("pieces")
    centred = F.col("first") - F.floor((words - (F.col("last") - F.col("first"))) / 2).cast("int")
    begin = F.greatest(F.lit(0), F.least(centred, n - words))
    ranged = cut.withColumn("begin", begin).withColumn("end", F.least(F.col("begin") + words, n))
    near = F.filter("hits", lambda h: (h["at"] + h["size"] > F.col("begin")) & (h["at"] < F.col("end")))
    shown = marked(F.col("pieces"), F.col("near"), F.col("begin"), F.col("end"), before, after)
    return ranged.withColumn("near", near).select("key", "score", F.concat(F.when(F.col("begin") > 0, dots).otherwise(""), shown, F.when(F.col("end") < n, dots).otherwise("")).alias("snippet"))
