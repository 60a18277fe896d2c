"""Near copies against brute force over all pairs."""

import itertools

import numpy as np
import pytest

import corpus_pipeline
from colloquy.llm import near_copies
from test_llm import DATA, DOC


def brute_kept(rows, n=5, least=0.8):
    """doc_ids that stay; the number of pairs at a similarity of at least least that are not equal sets."""
    sets = {}
    for d, t in rows:
        w = t.lower().split()
        sets[d] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}
    label = {d: d for d in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    pairs = 0
    for a, b in itertools.combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
            pairs += sets[a] != sets[b]
            x, y = sorted((root(a), root(b)))
            label[y] = x
    return {d for d in sets if label[d] == d}, pairs


@pytest.mark.parametrize("stage", [False, True])
def test_near_copies(spark, stage):
    rng = np.random.default_rng(7)
    rows = []
    for _ in range(60):
        words = [f"w{x}" for x in rng.integers(0, 5000, rng.integers(60, 400))]
        rows.append((len(rows), " ".join(words)))
        for _ in range(4):
            copy = list(words)
            for i in rng.integers(0, len(words), rng.integers(1, max(2, len(words) // 40))):
                copy[i] = f"new{rng.integers(0, 5000)}"
            rows.append((len(rows), " ".join(copy)))
    want, pairs = brute_kept(rows)
    assert pairs > 200
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], DOC)
    out = corpus_pipeline.near_duplicate_stage(spark, docs, DATA) if stage else near_copies.deduplicated(docs)
    assert {r.doc_id for r in out.collect()} == want and out.columns == docs.columns


def test_large_group_and_odd_texts(spark):
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join([*base[:i], "changed", *base[i + 1 :]])) for i in range(300)]
    docs = spark.createDataFrame([*[(d, t, 1, 1) for d, t in rows], (1000, "a b c", 1, 1), (1001, "A  b c", 1, 1), (1002, None, 1, 1), (None, "", 1, 1), (1003, " ", 1, 1)], "doc_id long, text string, row int, node int")
    kept = near_copies.deduplicated(docs)
    assert {r.doc_id for r in kept.collect()} == {0, 1000, 1002} and kept.columns == docs.columns
    assert near_copies.deduplicated(docs.limit(0)).count() == 0


def test_smallest_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("text is not null and text <> ''")
    want, _ = brute_kept([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id for r in near_copies.deduplicated(docs).collect()} == want


def template_rows(n=70):
    """Texts that share five sixths of a template (a similarity of about 0.7), each with one copy at about 0.93."""
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        at = (i * 5) % 340
        own = [*base[:at], *(f"o{i}x{k}" for k in range(60)), *base[at + 60 :]]
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join([*own[:-12], *(f"c{i}x{k}" for k in range(9)), *own[-3:]]))]
    return rows


def test_texts_of_one_template(spark):
    """More than a window of texts in one band's group that are not near copies of each other."""
    rows = template_rows()
    want, _ = brute_kept(rows)
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], DOC)
    assert {r.doc_id for r in near_copies.deduplicated(docs).collect()} == want


@pytest.mark.parametrize("most", [1000, 10])
def test_rare_pairs_leave_no_pair_out(spark, monkeypatch, most):
    """Small blocks; sets told where they meet, and left to their texts."""
    monkeypatch.setattr(near_copies, "BLOCK", 7)
    rows = template_rows(20)
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(396)} for d, t in rows}
    near = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    nodes = spark.createDataFrame([(d, d, t if most > 10 else f"{t} {t.replace('w', 'v')} {t.replace('w', 'u')}") for d, t in rows], "node long, label long, text string")
    got = near_copies.rare_pairs(nodes, 5, 0.8).collect()
    assert near and {(r.a, r.b) for r in got} >= near and len(got) < len(rows) * (len(rows) - 1) / 2
    assert near_copies.rare_pairs(nodes.withColumn("label", nodes["label"] * 0), 5, 0.8).count() == 0
