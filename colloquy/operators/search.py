"""Search: words with bm25, substrings, vectors, and the fusion of ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


K1, B = 1.2, 0.75
TOKEN = r"[\p{L}\p{N}]+"
#: Constant of reciprocal rank fusion.
RRF = 60
# Letters with marks and what they are searched as.
MARKED, PLAIN = "áàâäãåéèêëíìîïóòôöõúùûüýÿñç", "aaaaaaeeeeiiiiooooouuuuyync"


def folded(c: Column) -> Column:
    return F.translate(F.lower(F.coalesce(c, F.lit(""))), MARKED, PLAIN)


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(folded(c), F.lit(TOKEN), F.lit(0))


def _times(words: str, term: str) -> Column:
    return F.size(F.filter(words, lambda x: x == F.lit(term)))


def query_terms(query: str) -> list[str]:
    """Words of a query, without operators, folded as texts are."""
    table = str.maketrans(MARKED, PLAIN)
    cleaned = "".join(" " if ch in '"()*^{}' else ch for ch in query).lower().translate(table)
    return list(dict.fromkeys(w for part in cleaned.split() for w in "".join(ch if ch.isalnum() else " " for ch in part).split()))


def has_cjk(query: str) -> bool:
    return any("一" <= c <= "鿿" or "぀" <= c <= "ヿ" or "가" <= c <= "힯" for c in query)


def lexical(docs: DataFrame, key: str, text: str, query: str, limit: int = 20) -> DataFrame:
    """The best rows that hold all words of the query, by bm25 (higher is better); one pass counts, one ranks, nothing is exploded."""
    terms = query_terms(query)
    if not terms:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    found = docs.select(F.col(key), tokens(F.col(text)).alias("t"))
    counted = found.select(key, F.size("t").alias("n"), *[_times("t", w).alias(f"f{i}") for i, w in enumerate(terms)])
    figures = counted.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"), *[F.count_if(F.col(f"f{i}") > 0).alias(f"d{i}") for i in range(len(terms))])
    met = counted.where(" and ".join(f"f{i} > 0" for i in range(len(terms)))).join(F.broadcast(figures))
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log(1 + (F.col("docs") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5))
        score = score + idf * F.col(f"f{i}") * (K1 + 1) / (F.col(f"f{i}") + K1 * (1 - B + B * F.col("n") / F.col("mean")))
    return met.select(key, F.round(score, 4).alias("score")).orderBy(F.desc("score"), key).limit(limit)


def substring(docs: DataFrame, key: str, text: str, query: str, order: str, limit: int = 20, around: int = 40) -> DataFrame:
    """Rows that hold the query as it stands, whatever the case, the newest first, each with what is around it."""
    at = F.locate(query.lower(), F.lower(F.col(text)))
    start = F.greatest(at - around, F.lit(1))
    snippet = F.substring(F.col(text), start, at - start + len(query) + around)
    return docs.where(at > 0).select(key, order, snippet.alias("snippet")).orderBy(F.desc(order), key).limit(limit)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(vectors: DataFrame, key: str, vector: str, query: list[float], limit: int = 10) -> DataFrame:
    """The rows of the query's length that are most like it. Each task keeps its own best; no vector is shuffled."""
    q = F.array(*[F.lit(float(x)) for x in query])
    same = vectors.where(F.size(vector) == len(query))
    return same.select(key, F.round(cosine(F.col(vector), q), 6).alias("score")).where("score is not null").orderBy(F.desc("score"), key).limit(limit)


def fused(arms: list[DataFrame], key: str, limit: int = 10) -> DataFrame:
    """Reciprocal rank fusion of arms (key, score), each already cut to its best rows."""
    ranked = None
    for arm in arms:
        rank = F.row_number().over(Window.orderBy(F.desc("score"), key)) - 1
        part = arm.select(key, (1 / (RRF + rank + 1)).alias("share"))
        ranked = part if ranked is None else ranked.unionByName(part)
    return ranked.groupBy(key).agg(F.round(F.sum("share"), 6).alias("score")).orderBy(F.desc("score"), key).limit(limit)


def depth(k: int) -> int:
    """How many rows each arm of a fusion gives for k results."""
    return max(3 * k, k + 10)
