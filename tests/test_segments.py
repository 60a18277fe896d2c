"""The stored word index against loops over the texts."""

import math
import re

import pytest
from pyspark.sql import functions as F

from colloquy.operators import segments as W
from colloquy.operators.search import MARKED, PLAIN

TEXTS = {
    1: "E-mail, then mail. The E mail man!", 2: None, 3: "", 4: "Mail e", 5: "résumé of an E-MAIL: " + "x " * 50 + "e-mail e-mail end", 6: "one e-mail e-mail",
    7: " ".join(f"w{i}" for i in range(100)) + " resume " + " ".join(f"v{i}" for i in range(100)), 8: "e mail" + " filler" * 40 + " man e-mail " + "filler " * 40, 9: "…", 10: "man",
}


def words_of(text):
    return re.findall(r"[^\W_]+", (text or "").lower().translate(str.maketrans(MARKED, PLAIN)))


def searched(query, limit=20, size=32):
    phrases = W.phrases_of(query)
    words = {k: words_of(t) for k, t in TEXTS.items()}
    hits = {k: [[i for i in range(len(w)) if w[i : i + len(p)] == p] for p in phrases] for k, w in words.items()}
    n, total = len(words), sum(map(len, words.values()))
    holders = [sum(bool(h[i]) for h in hits.values()) for i in range(len(phrases))]
    out = []
    for k, h in hits.items():
        if not phrases or not all(h):
            continue
        score = sum(max(math.log((n - d + 0.5) / (d + 0.5)), 1e-6) * len(s) * 2.2 / (len(s) + 1.2 * (0.25 + 0.75 * len(words[k]) * n / total)) for s, d in zip(h, holders))
        own = sorted((at, i, len(phrases[i])) for i, s in enumerate(h) for at in s)
        best = min(((-len({i for a, i, _ in own if at <= a < at + size}), -sum(at <= a < at + size for a, *_ in own), at) for at, *_ in own))
        last = max(a + s for a, _, s in own if best[2] <= a < best[2] + size)
        begin = max(0, min(best[2] - (size - (last - best[2])) // 2, len(words[k]) - size))
        end = min(begin + size, len(words[k]))
        pieces = re.findall(r"[^\W_]+(?:[\W_])*", TEXTS[k])
        shown, inside = "", [any(a <= i < a + s for a, _, s in own if a + s > begin and a < end) for i in range(len(pieces))]
        for i in range(begin, end):
            word = re.match(r"[^\W_]+", pieces[i]).group()
            joined = lambda i: any(a <= i - 1 and i < a + s for a, _, s in own)
            opens = inside[i] and any(a == i for a, *_ in own) and not joined(i)
            closes = inside[i] and any(a + s == i + 1 for a, _, s in own) and not joined(i + 1)
            shown += "<mark>" * opens + word + "</mark>" * closes + (pieces[i][len(word) :] if i + 1 < end else "")
        out.append((k, round(score, 4), "..." * (begin > 0) + shown + "..." * (end < len(pieces))))
    return sorted(out, key=lambda r: (-r[1], r[0]))[:limit]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    docs = spark.createDataFrame([(k, t, "x", 0) for k, t in TEXTS.items()], "id long, body string, term string, bucket int")
    folder = f"file://{tmp_path_factory.mktemp('index')}"
    W.add_segment(docs.where("id < 6"), "id", "body", folder, "a", shards=2)
    W.add_segment(docs.where("id >= 6"), "id", "body", folder, "b", shards=2)
    return docs, W.Index(spark, folder)


@pytest.mark.parametrize("query", ["e-mail", "mail", "e-mail man", '"resume" (of)', "RÉSUMÉ", "mail e", "absent", "e-mail absent", " - ", "", "e-mail-man", "e e-mail mail"])
def test_search_and_snippets(indexed, query):
    docs, index = indexed
    found = W.with_snippets(index.search(query), docs, "id", "body")
    assert sorted(((r.key, r.score, r.snippet) for r in found.collect()), key=lambda r: (-r[1], r[0])) == searched(query)


def test_only_the_terms_buckets_are_read(spark, indexed):
    _, index = indexed
    plan = index.postings(["mail"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(rf"PartitionFilters: \[[^]]*\(bucket#\d+ = {W.bucket_of('mail')}\)\]", plan) and "PushedFilters: [IsNotNull(term), EqualTo(term,mail)]" in plan
    every = spark.read.parquet(f"{index.folder}/postings")
    wrong = every.where(F.col("bucket") != (F.crc32(F.col("term").cast("binary")) % W.BUCKETS))
    assert wrong.count() == 0 and every.groupBy("term", "key").count().where("count > 1").count() == 0


def test_segments_are_replaced_and_lag(spark, tmp_path):
    folder = f"file://{tmp_path}/index"
    rows = lambda *r: spark.createDataFrame(list(r), "id long, body string")
    W.add_segment(rows((1, "old words"), (2, "more words")), "id", "body", folder, "a")
    W.add_segment(rows((5, "new words"), (6, None)), "id", "body", folder, "b")
    index = W.Index(spark, folder)
    assert tuple(index.lag(rows((9, "x")), "id").first()) == (9, 6, 3)
    W.add_segment(rows((3, "old")), "id", "body", folder, "a")
    assert [r.key for r in index.search("words").collect()] == [5] and [r.key for r in index.search("old").collect()] == [3]
    assert tuple(index.figures().first()) == (3, 3, 6)
    among = rows((3, "x")).select(F.col("id").alias("key"))
    assert index.search("words", among=among).count() == 0 and index.search("old", among=among).count() == 1
    W.add_segment(rows().limit(0), "id", "body", folder, "empty")
    assert tuple(index.figures().first()) == (3, 3, 6) and index.search("words").count() == 1
