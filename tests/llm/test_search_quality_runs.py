"""Ranked search, quality and periodic runs against brute force, with nulls, repeats, ties, empty tables and clashing columns."""

import collections
import hashlib
import math
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colloquy.llm import quality, queries, ranked_search, runs
from colloquy.llm.common import words_of

DATA = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, an empty text, a very long one, repeats, and columns whose names the operators use inside."""
    long = " ".join(f"word{i % 977}" for i in range(100_000))
    rows = [(1, None, None, None, None), (None, "some text here", "en", "a", 14), (2, "", "en", "a", 0), (3, long, "en", "b", len(long)), (4, "same same", "en", "b", 9), (4, "same same", "en", "b", 9), (None, None, None, None, None), (5, " \n\t ", "en", "b", 4)]
    extra = ", row string, term int, features string, label int, score double, runs string, collapsed int, list int, item string, quality_score int, its_id int"
    return spark.createDataFrame([(*r, "r", 1, "f", 1, 0.5, "s", 2, 3, "i", 4, 5) for r in rows], DOC + extra)


def ranking(documents, items, limit=10):
    """documents and items: (id, text). The contract's ranking, by a loop over everything."""
    counted = [(i, collections.Counter(words_of(t.encode() if t else None))) for i, t in documents]
    n = sum(1 for _, c in counted if c)
    total = sum(sum(c.values()) for _, c in counted)
    df = collections.Counter(w for _, c in counted for w in c)
    out = []
    for item in dict.fromkeys(i for i, _ in items):
        terms = {w for i, t in items if i == item for w in words_of(t.encode() if t else None)}
        found = []
        for at, (doc, c) in enumerate(counted):
            m = 10 + (90 * sum(c.values()) * n) // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1000000000 * c[w] // (1000 * c[w] + 8 * m)) for w in terms if c[w])
            if score > 0:
                found.append((-score, doc is None, doc or 0, at, doc))
        out += [(item, k + 1, x[-1], -x[0]) for k, x in enumerate(sorted(found)[:limit])]
    return sorted(out, key=str)


def test_ranking_of_the_tables(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = sorted(map(tuple, queries.op11_ranked_search(spark, DATA).collect()))
    assert got == sorted(con.execute(ranked_search.ORACLE_SQL).fetchall()) and got
    rows = [con.execute(f"SELECT {k}, text FROM {t}").fetchall() for t, k in (("documents", "doc_id"), ("benchmark", "item_id"))]
    assert sorted(map(str, got)) == sorted(map(str, ranking(*rows)))


def test_ranking_of_odd_rows(spark, odd, monkeypatch):
    items = [(1, "Some SAME text"), (1, "word5 text"), (2, None), (3, ""), (None, "here word7 same"), (4, "absent"), (5, "word1 word1 word2"), (5, "word1 word1 word2")]
    table = spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, term int")
    want = ranking([(r.doc_id, r.text) for r in odd.collect()], items)
    read = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert read(ranked_search.search(odd, table)) == want
    monkeypatch.setattr(ranked_search, "BLOCK_TERMS", 1)
    monkeypatch.setattr(ranked_search, "CHUNK_POSTINGS", 3)
    monkeypatch.setattr(ranked_search, "HELD_BOUNDS", 2)
    monkeypatch.setattr(ranked_search, "BROADCAST_ROWS", 0)
    assert read(ranked_search.search(odd, table)) == want
    assert ranked_search.search(odd.limit(0), table).count() == 0 and ranked_search.search(odd, table.limit(0)).count() == 0


def test_ranking_with_ties_and_an_index_of_all_terms(spark):
    documents = [(i, " ".join(f"w{j}" for j in range(i % 7 + 1)) + (" rare" if i % 50 == 0 else "")) for i in range(400)]
    items = [(1, "w0 w3 w6"), (2, "rare w1"), (3, "w5"), (4, "rare")]
    index = ranked_search.build_index(spark.createDataFrame(documents, "doc_id long, text string"))
    terms = ranked_search.item_terms(spark.createDataFrame(items, "item_id long, text string"))
    for limit in (1, 3, 10, 500):
        got = sorted(map(tuple, ranked_search.top_documents(index, terms, limit).collect()), key=str)
        assert got == ranking(documents, items, limit)
    assert index.figures() == (400, sum(len(t.split()) for _, t in documents))


def brute_runs(words, least_length=6, least_power=4):
    out, n = [], len(words)
    for q in range(1, n // least_power + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            own = words[i : j + q]
            if len(own) >= max(least_length, least_power * q) and not any(own[:-d] == own[d:] for d in range(1, q)):
                out.append((i, len(own), q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("ab", max_size=40), st.integers(1, 9)), min_size=1, max_size=5), st.sampled_from([(6, 4), (2, 2), (5, 3)]))
def test_runs_of_texts(texts, least):
    words = [list(t) + list(t[: k + 1]) * k for t, k in texts]
    flat = np.array([ord(w) for ws in words for w in ws], np.int64)
    ends = np.cumsum([len(ws) for ws in words])
    want = [(s + e - len(ws), n, q) for ws, e in zip(words, ends) for s, n, q in brute_runs(ws, *least)]
    assert list(zip(*(x.tolist() for x in runs.runs_in(flat, ends, *least)))) == want


def run_digest(doc_id, text):
    words = (text or "").encode().split()
    words = runs.rebuilt(words, doc_id)
    found = brute_runs(words)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(found), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_periodic_runs(spark, docs, odd):
    short = docs.where(F.length("text") < 6000)
    texts = short.select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in runs.digest(runs.periodic_runs(short, prepare=runs.rebuilt)).collect()}
    assert got == {r.doc_id: run_digest(r.doc_id, r.text) for r in texts}
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in got) > 5 and sum(r[1] > 0 for r in got.values()) > 5
    small = odd.where("doc_id is null or doc_id <> 3").select("doc_id", "text").collect()
    found = runs.digest(runs.periodic_runs(odd, prepare=runs.rebuilt)).collect()
    assert sorted((tuple(r) for r in found if r.doc_id != 3), key=str) == sorted((run_digest(r.doc_id, r.text) for r in small), key=str)
    assert [(r.n_runs, r.period, r.length) for r in found if r.doc_id == 3] == [(1, 977, 100_000)] or zlib.crc32(b"3") % 10 == 0
    assert runs.periodic_runs(odd.limit(0)).count() == 0
    kept = runs.periodic_runs(spark.createDataFrame([(1, "a b  a b a b\na b c c c c c c d")], "doc_id long, text string")).first()
    assert kept.collapsed == "a b c d" and [tuple(r) for r in kept.runs] == [(0, 8, 2), (8, 6, 1)]


def test_density():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3)) @ np.array([[2.0, 0, 0], [0.5, 1, 0], [0, 0.3, 0.2]])
    covariance = np.cov(x.T)
    own = quality.Density.of(x.mean(axis=0), covariance)
    off = x - x.mean(axis=0)
    want = -0.5 * (np.einsum("ij,jk,ik->i", off, np.linalg.inv(covariance), off) + np.linalg.slogdet(covariance)[1])
    assert np.allclose(own.log(x), want)
    few = quality.shrunk(np.cov(x[:4].T), 4)
    assert np.linalg.eigvalsh(few).min() > 0 and np.isclose(np.trace(few), np.trace(np.cov(x[:4].T)))


def test_sums_of_classes(spark, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = quality.features_of(docs).join(quality.known_labels(labels), F.col("doc_id") == F.col("its_id")).cache()
    sums = quality.class_sums(rows.repartition(5))
    for y in (0, 1):
        x = np.array([quality.described(r.text) for r in docs.join(labels.where(f"quality = {y}"), "doc_id").select("text").collect()])
        assert sums[y].n == len(x) and np.allclose(sums[y].mean, x.mean(axis=0)) and np.allclose(sums[y].scatter, (x - x.mean(axis=0)).T @ (x - x.mean(axis=0)), atol=1e-6)


def test_quality_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    judged = [(r.score, r.predicted, labels[r.doc_id]) for r in queries.op12_quality(spark, sf).collect() if r.held_out and r.doc_id in labels]
    low, high = [r for r in judged if r[2] == 0], [r for r in judged if r[2] == 1]
    assert len(low) >= 5 and len(high) >= 30 and all(0 <= r[0] <= 1 and r[1] == (r[0] >= 0.3) for r in judged)
    assert sum(r[1] == 0 for r in low) >= 0.9 * len(low) and sum(r[1] == 1 for r in high) >= 0.95 * len(high)
    assert np.mean([h[0] > l[0] for h in high for l in low]) > 0.97


def test_quality_of_odd_rows(spark, odd, docs):
    labels = spark.createDataFrame([(1, 1, "x"), (4, 0, "x"), (4, 1, "x"), (3, None, "x"), (None, 1, "x")], "doc_id long, quality int, text string")
    assert sorted(map(tuple, quality.known_labels(labels).collect())) == [(1, 1), (4, 0)]
    found = quality.quality_scores(odd, labels).collect()
    assert len(found) == 8 and all(0 <= r.score <= 1 for r in found)
    assert len({r.score for r in found if r.doc_id in (1, 2, 5)}) == 1
    assert {r.score for r in quality.quality_scores(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(odd.limit(0), labels).count() == 0
    learnt = quality.learn(quality.features_of(docs), spark.read.parquet(f"{DATA}/labels.parquet"))
    kept = quality.of_quality(odd, learnt)
    assert kept.columns == odd.columns and quality.of_quality(docs, learnt).count() < docs.count()
    assert quality.of_quality(odd, learnt, 0.0).count() == 8
