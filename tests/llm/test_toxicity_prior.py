"""The bounded sample doesn't change what class share the labels have."""

import numpy as np

from colloquy.llm import toxicity


def labelled(n=4000):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(n):
        toxic = int(rng.random() < 0.1)
        words = [f"plain{x}" for x in rng.integers(0, 300, 30)]
        words += [w for w, yes, no in (("zorgle", 0.6, 0.0), ("quibble", 0.5, 0.05)) if rng.random() < (yes if toxic else no)]
        rows.append((i, " ".join(words), toxic))
    return rows


def test_scores_do_not_depend_on_the_sample(spark):
    table = spark.createDataFrame(labelled(), "doc_id long, text string, toxic int").cache()
    docs, labels = table.select("doc_id", "text"), table.select("doc_id", "toxic")
    score = [toxicity.score_text("plain1 plain2 quibble plain3", m, toxicity.Evidence(m.weights)) for m in (toxicity.learn(docs, labels), toxicity.learn(docs, labels, sample_docs=2000), toxicity.learn(docs, labels, sample_docs=1000))]
    assert max(score) - min(score) < 0.1 and max(score) < toxicity.THRESHOLD, score


def test_weights_give_the_prior_back():
    rng = np.random.default_rng(3)
    known = (rng.random(20_000) < 0.1).astype(np.int64)
    votes = (rng.random((20_000, 3)) < np.where(known[:, None] == 1, 0.5, 0.04)).astype(np.float32)
    whole = toxicity.fit_label_model(votes, known)
    part = np.concatenate([np.flatnonzero(known == 1)[:1500], np.flatnonzero(known == 0)[:1500]])
    counts = np.bincount(known)
    found = toxicity.fit_label_model(votes[part], known[part], stands_for=(counts / 1500)[known[part]])
    lone = np.array([[1, 0, 0]], np.float32)
    assert abs(found.prior - whole.prior) < 0.02 and abs(found.posterior(lone)[0] - whole.posterior(lone)[0]) < 0.06
