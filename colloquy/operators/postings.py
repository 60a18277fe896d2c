"""Word search over an inverted index, and the search modes that share it.

The index is a table of postings (term, key, times, length), built with one explode and one aggregation and written
wherever its user wants; a search reads the query's terms only, so it costs what these words' postings cost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .search import B, K1, fused, has_cjk, query_terms, substring, tokens

EMBED_DIMENSIONS = 64


def build_postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """term, key, times and length (words of the row); a row without words has one posting of no term."""
    words = docs.select(F.col(key).alias("key"), tokens(F.col(text)).alias("words"))
    each = words.select("key", F.size("words").alias("length"), F.explode_outer("words").alias("term"))
    return each.groupBy("term", "key").agg(F.count("term").alias("times"), F.first("length").alias("length"))


def matches(postings: DataFrame, query: str) -> DataFrame:
    """key and score (bm25) of the rows that hold all words of the query."""
    terms = query_terms(query)
    rows = postings.groupBy("key").agg(F.first("length").alias("length"))
    figures = rows.agg(F.count("*").alias("docs"), F.avg("length").alias("mean"))
    own = postings.where(F.col("term").isin(*terms)) if terms else postings.limit(0)
    often = own.groupBy("term").agg(F.count("*").alias("holders"))
    weighed = own.join(F.broadcast(often), "term").join(F.broadcast(figures))
    idf = F.log(1 + (F.col("docs") - F.col("holders") + 0.5) / (F.col("holders") + 0.5))
    part = idf * F.col("times") * (K1 + 1) / (F.col("times") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return weighed.groupBy("key").agg(F.count("*").alias("n"), F.round(F.sum(part), 4).alias("score")).where(F.col("n") == len(terms)).select("key", "score")


def best_messages(postings: DataFrame, messages: DataFrame, sessions: DataFrame, query: str, provider: str | None = None, limit: int = 20) -> DataFrame:
    """Matching messages with their session's provider and title, the best first."""
    met = matches(postings, query).join(messages, F.col("key") == messages["id"])
    with_session = met.join(sessions.select(F.col("id").alias("its_session"), "provider", "title_hint"), F.col("session_id") == F.col("its_session"))
    if provider is not None:
        with_session = with_session.where(F.col("provider") == provider)
    return with_session.select("key", "session_id", "provider", "title_hint", "score").orderBy(F.desc("score"), "key").limit(limit)


def best_vectors(vectors: DataFrame, messages: DataFrame, sessions: DataFrame, scored: DataFrame, provider: str | None = None, limit: int = 10) -> DataFrame:
    """Scored vectors (key, score) with the message and session that they stand for."""
    met = scored.join(vectors.select(F.col("vec_id").alias("key"), "label"), "key").join(messages, F.col("key") == messages["turn_id"])
    with_session = met.join(sessions.select(F.col("id").alias("its_session"), "provider"), F.col("session_id") == F.col("its_session"))
    if provider is not None:
        with_session = with_session.where(F.col("provider") == provider)
    return with_session.select("key", "session_id", "provider", "score").orderBy(F.desc("score"), "key").limit(limit)


def search(docs: DataFrame, key: str, text: str, query: str, mode: str = "hybrid", postings: DataFrame | None = None, vectors_best: DataFrame | None = None, limit: int = 20) -> DataFrame:
    """key and score by mode: lexical, semantic or hybrid. Scripts without blanks are looked for as substrings; where
    there are no vectors (vectors_best, key and score), every mode is lexical."""
    if mode not in ("lexical", "semantic", "hybrid"):
        raise ValueError(f"unknown mode: {mode}")
    if mode == "semantic" and vectors_best is not None:
        return vectors_best.orderBy(F.desc("score"), "key").limit(limit)
    if has_cjk(query):
        words = substring(docs.withColumn("order", F.col(key)), key, text, query, "order", limit).select(F.col(key).alias("key"), F.lit(1.0).alias("score"))
    else:
        words = matches(postings if postings is not None else build_postings(docs, key, text), query).orderBy(F.desc("score"), "key").limit(limit)
    return fused([words, vectors_best], "key", limit) if mode == "hybrid" and vectors_best is not None else words


def lag(docs: DataFrame, key: str, postings: DataFrame) -> DataFrame:
    """How far the index is behind the newest row: one row with newest, indexed and lag."""
    newest = docs.agg(F.max(key).alias("newest"))
    return newest.join(F.broadcast(postings.where("term is not null").agg(F.max("key").alias("indexed")))).select("newest", "indexed", (F.col("newest") - F.coalesce("indexed", F.lit(0))).alias("lag"))


def missing_vectors(docs: DataFrame, key: str, text: str, order: str, vectors: DataFrame, vector_key: str, limit: int = 500) -> DataFrame:
    """Vectors (hashed word counts of unit length) for the newest rows with a text that have none yet."""
    known = vectors.select(F.col(vector_key).alias("its_key"))
    pending = docs.where(F.trim(F.col(text)) != "").join(known, F.col(key) == F.col("its_key"), "left_anti")
    newest = pending.orderBy(F.desc(order), F.desc(key)).limit(limit).select(F.col(key).alias("key"), tokens(F.col(text)).alias("words"))

    def embed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zlib

        for batch in batches:
            out = []
            for words in batch["words"]:
                v = np.bincount([zlib.crc32(w.encode()) % EMBED_DIMENSIONS for w in words], minlength=EMBED_DIMENSIONS).astype(float)
                out.append((v / max(np.linalg.norm(v), 1e-9)).tolist())
            yield pd.DataFrame({"key": batch["key"], "vector": out})

    return newest.mapInPandas(embed, "key long, vector array<float>")
