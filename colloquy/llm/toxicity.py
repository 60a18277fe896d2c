"""Toxicity by weak supervision: many voters, a generative label model, and a linear classifier on its posteriors.

Voters are lexicon voters (a word) and pattern voters (a word's beginning of 3 to 7 characters), each also in a form
that fires only where the text is dense in them. A fixed English lexicon
is always among them; the others are mined: terms that are much more frequent in training documents labelled toxic than
in the others. A voter fires on a document that has its term, and abstains else.

The label model (`LabelModel`) has a class prior and, per voter and class, the chance to fire (its accuracy). It is fitted by
expectation maximisation over the votes on a bounded sample of documents, in which a known label is one more, more
trustworthy voter. Sampled documents are weighed back to the counts of both classes over all training labels, so the
prior is the labels' own at every size of the table. Voters are not independent (a word's beginnings fire together): correlations within the classes are
estimated from the residual votes (of labelled documents, if there are enough), and each voter's evidence is divided by its correlated company. Its posteriors, not
the labels, are what the linear classifier (`Classifier`, logistic regression over term presence) is trained on; the
classifier scores every document from its whole text.

Without labelled toxic documents the lexicon alone votes on a bounded sample of all documents, the label model is fitted
on these votes without labels, and the classifier on its posteriors as ever.

Defined cases: null and empty texts have no terms and get the score of the intercept; repeated rows are scored each, and
a labelled id counts once in the sample (a document with both labels counts as toxic); null labels are no labels; very
long texts are one set of terms; an empty table gives an empty result; other columns are left aside, or carried along
whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from .common import free_name, written

#: Labelled documents that mining and training use at most: toxic ones up to a half of it and others up to a half, the first by hash.
SAMPLE_DOCS = 12_000
#: Mined voters at most, and features of the classifier at most.
MAX_VOTERS = 120
MAX_FEATURES = 4_000
#: A mined term needs so many toxic documents and this share of them, and so many times the share it has among the others.
LEAST_SUPPORT = 3
LEAST_SHARE = 0.005
LEAST_LIFT = 8.0
LEXICON = ("idiot", "moron", "stupid", "scum", "trash", "pathetic", "worthless", "disgusting", "loser", "clown")
THRESHOLD = 0.7
#: Labels of each class from which on correlations are estimated on labelled documents alone.
ENOUGH_LABELS = 20
#: A text is dense in a term that at least one of so many words has.
DENSE = 200
_WORD = re.compile(r"[^\W\d_]+")


def terms_of_word(word: str) -> tuple[str, ...]:
    """The word, and its beginnings (marked by a star)."""
    return (word, *(word[:k] + "*" for k in range(3, min(7, len(word)) + 1)))


def shorter(term: str) -> list[str]:
    """The shorter beginnings of a term, in its own form."""
    dense = "!" if term.endswith("!") else ""
    word = term.rstrip("!").rstrip("*")
    return [word[:k] + "*" + dense for k in range(3, min(8, len(word) + 1)) if word[:k] + "*" + dense != term]


def features_of(counts: dict[str, int], terms) -> set[str]:
    """Terms that a text has, by terms(word); with a `!` those that it is dense in: twice at least, and one word in DENSE."""
    seen: dict[str, int] = {}
    for word, k in counts.items():
        for term in terms(word):
            seen[term] = seen.get(term, 0) + k
    n = sum(counts.values()) if seen else 0
    return {*seen, *(term + "!" for term, k in seen.items() if k >= 2 and k * DENSE >= n)}


def words_in(text: str | None) -> Counter:
    return Counter(_WORD.findall(text.lower())) if text else Counter()


@dataclass
class LabelModel:
    """prior of the toxic class; fire[class, voter]; share[voter]: what is left of its evidence beside correlated voters.

    Abstaining is no evidence by itself: which voters can fire depends on a text's language and topic. Only that none
    of them fires is, by silent[class].
    """

    prior: float
    fire: np.ndarray
    silent: np.ndarray
    share: np.ndarray
    correlations: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        on = np.log(self.fire[1]) - np.log(self.fire[0])
        none = np.log(self.silent[1]) - np.log(self.silent[0])
        odds = np.log(self.prior / (1 - self.prior)) + votes @ (on * self.share) + ~votes.any(axis=1) * none
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def fit_label_model(votes: np.ndarray, known: np.ndarray, rounds: int = 15, trust: float = 0.97, stands_for: np.ndarray | None = None) -> LabelModel:
    """votes: documents by voters, 0 or 1. known: 1, 0, or -1 where there is no label; a label is right with chance trust.

    stands_for: how many documents each one of the sample stands for, 1 if not given. It weighs shares, not how sure they are.
    """
    labelled = known >= 0
    times = np.ones(len(known)) if stands_for is None else stands_for
    prior = rate = float(np.clip(np.average(known[labelled], weights=times[labelled]) if labelled.any() else 0.1, 0.01, 0.5))
    evidence = np.where(known == 1, np.log(trust / (1 - trust)), np.where(known == 0, np.log((1 - trust) / trust), 0.0))
    # To begin with, labels where there are any, else any vote at all.
    belief = np.where(labelled, np.clip(known, 0.03, 0.97), np.where(votes.any(axis=1), 0.6, 0.05))
    none = ~votes.any(axis=1)
    enough = min((known == 0).sum(), (known == 1).sum()) >= ENOUGH_LABELS
    for _ in range(rounds):
        weight = np.stack([1 - belief, belief])
        total = weight.sum(axis=1)
        share = weight * times
        share *= (total / share.sum(axis=1))[:, None]
        fire = (share @ votes + 0.05) / (total[:, None] + 0.5)
        # A voter speaks for the toxic class only: it fires there at least as often.
        fire[0] = np.minimum(fire[0], fire[1])
        fire = np.clip(fire, 1e-5, 1 - 1e-5)
        silent = np.clip((share @ none + 0.5) / (total + 1), 1e-3, 1.0)
        # Correlations come from documents of known class; beliefs that are still wrong would make good voters look alike.
        v, p = (votes[labelled], known[labelled]) if enough else (votes, belief)
        residual = (v - p[:, None] * fire[1] - (1 - p)[:, None] * fire[0]) * np.sqrt(times[labelled] if enough else times)[:, None]
        spread = np.sqrt((residual * residual).sum(axis=0)) + 1e-9
        correlations = residual.T @ residual / np.outer(spread, spread)
        share = 1 / np.maximum(1.0, np.where(correlations > 0.3, correlations, 0.0).sum(axis=1))
        model = LabelModel(prior, fire, silent, share, correlations)
        p = np.clip(model.posterior(votes), 1e-9, 1 - 1e-9)
        odds = np.log(p / (1 - p))
        if labelled.any():
            # The share of the toxic class is what the labels say; else each round's beliefs would lift the next one's.
            low, high = -30.0, 30.0
            for _ in range(40):
                mid = (low + high) / 2
                low, high = (mid, high) if np.average(1 / (1 + np.exp(-np.clip(odds + mid, -50, 50))), weights=times) < rate else (low, mid)
            odds += low
            model.prior = float(np.clip(1 / (1 + np.exp(-(np.log(prior / (1 - prior)) + low))), 1e-6, 1 - 1e-6))
        belief = 1 / (1 + np.exp(-np.clip(odds + evidence, -50, 50)))
        prior = model.prior if labelled.any() else float(np.clip(np.average(belief, weights=times), 0.01, 0.5))
    return model


@dataclass
class Classifier:
    weights: dict[str, float]
    bias: float


def fit_linear(features: list[np.ndarray], n_features: int, target: np.ndarray, rounds: int = 1000, decay: float = 2e-5, stands_for: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets by full gradient steps with per-feature scaling. stands_for: as for the label model."""
    rows = np.repeat(np.arange(len(features)), [len(f) for f in features])
    columns = np.concatenate(features) if features else np.zeros(0, np.int64)
    # A rare class weighs more, by the square root of how rare it is.
    times = np.ones(len(target)) if stands_for is None else stands_for / stands_for.mean()
    rare = max(float(np.average(target > 0.5, weights=times)), 1e-3)
    weight = np.where(target > 0.5, min(5.0, np.sqrt((1 - rare) / rare)) if rare < 0.5 else 1.0, 1.0) * times
    w, b = np.zeros(n_features), -2.0
    scale_w, scale_b = np.full(n_features, 1e-12), 1e-12
    for _ in range(rounds):
        z = np.bincount(rows, w[columns], minlength=len(features)) + b
        error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target) * weight / len(features)
        g = np.bincount(columns, error[rows], minlength=n_features) + decay * w / 100
        scale_w += g * g
        scale_b += error.sum() ** 2
        w -= 0.6 * g / np.sqrt(scale_w)
        b -= 0.6 * error.sum() / np.sqrt(scale_b)
    return w, float(b)


def known_labels(labels: DataFrame) -> DataFrame:
    """its_id and toxic, one row per labelled id."""
    return labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").alias("its_id")).agg(F.max("toxic").alias("toxic"))


def class_counts(docs: DataFrame, labels: DataFrame) -> dict[int, int]:
    """How many documents have each label, over all of them."""
    found = docs.select("doc_id").join(known_labels(labels), F.col("doc_id") == F.col("its_id")).groupBy((F.col("toxic") == 1).cast("int").alias("toxic")).count()
    return {r.toxic: r["count"] for r in found.collect()}


def sample_words(docs: DataFrame, labels: DataFrame, sample_docs: int) -> DataFrame:
    """doc_id, toxic, words (space-joined, distinct) and times of the bounded sample, written once; its size does not grow with docs."""
    docs, known = docs.select("doc_id", "text"), known_labels(labels)
    order = [F.xxhash64("its_id"), F.col("its_id")]
    toxic = known.where("toxic = 1").orderBy(*order).limit(sample_docs // 2)
    clean = known.where("toxic <> 1").orderBy(*order).limit(sample_docs // 2)
    return words_of_sample(docs.join(F.broadcast(toxic.unionByName(clean)), F.col("doc_id") == F.col("its_id")).select("doc_id", (F.col("toxic") == 1).cast("int").alias("toxic"), "text"))


def unlabelled_words(docs: DataFrame, sample_docs: int) -> DataFrame:
    """The same of the first documents by hash, with null for toxic."""
    docs = docs.select("doc_id", "text")
    chosen = docs.select(F.xxhash64("doc_id", "text").alias("its_key")).distinct().orderBy("its_key").limit(sample_docs)
    met = docs.join(F.broadcast(chosen), F.xxhash64("doc_id", "text") == F.col("its_key"))
    return words_of_sample(met.select("doc_id", F.lit(None).cast("int").alias("toxic"), "text"))


def words_of_sample(sample: DataFrame) -> DataFrame:
    # Rows that share an id (or, without one, a text) are one document of the sample, so its bound holds.
    first = sample.groupBy(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("/"), F.xxhash64("text").cast("string"))).alias("key")).agg(F.min(F.struct(F.xxhash64("text").alias("hash"), F.col("doc_id").cast("long").alias("doc_id"), "toxic", "text")).alias("first"))
    sample = first.select("first.doc_id", "first.toxic", "first.text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [sorted(words_in(t.as_py()).items()) for t in batch.column(2)]
            words, times = ([" ".join(w for w, _ in c) for c in counts], [[k for _, k in c] for c in counts])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.string()), pa.array(times, pa.list_(pa.int32()))], ["doc_id", "toxic", "words", "times"])

    return written(sample.mapInArrow(run, "doc_id long, toxic int, words string, times array<int>"), "toxicity-sample")


def terms_in_rows(batch: pa.RecordBatch, terms) -> Iterator[set[str]]:
    """The terms of each row of a batch of sample_words."""
    for words, times in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
        yield features_of(dict(zip(words.split(), times)), terms)


def term_counts(sample: DataFrame, label: int, known=None) -> DataFrame:
    """term, n: in how many documents of a label each term is. known: a broadcast set of terms, the only ones to be counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        terms = Evidence(known.value).__getitem__ if known else terms_of_word
        for batch in batches:
            for row in terms_in_rows(batch, terms):
                found.update(row & known.value if known else row)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["term", "k"])

    return sample.where(F.col("toxic") == label).mapInArrow(run, "term string, k long").groupBy("term").agg(F.sum("k").alias("n"))


def feature_rows(sample: DataFrame, features: list[str]) -> list[tuple[int, np.ndarray]]:
    """Label and numbers of the features of each sampled document, by doc_id."""
    shared = sample.sparkSession.sparkContext.broadcast({x: i for i, x in enumerate(features)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        terms = Evidence(number).__getitem__
        for batch in batches:
            rows = [np.array(sorted(number[x] for x in found if x in number), np.int32).tobytes() for found in terms_in_rows(batch, terms)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], ["doc_id", "toxic", "features"])

    found = sample.mapInArrow(run, "doc_id long, toxic int, features binary").toLocalIterator()
    rows = sorted((r.doc_id is None, r.doc_id or 0, -1 if r.toxic is None else r.toxic, bytes(r.features)) for r in found)
    return [(toxic, np.frombuffer(x, np.int32)) for *_, toxic, x in rows]


def select_terms(toxic: dict[str, int], clean: dict[str, int], totals: tuple[int, int]) -> tuple[list[str], list[str]]:
    """Voters and features (voters first) from the terms' document counts; totals: clean and toxic documents."""
    least = max(LEAST_SUPPORT, LEAST_SHARE * totals[1])
    lexicon = [x for word in LEXICON for x in (word, word + "!")]
    known = toxic.keys() | set(lexicon)

    def strength(x: str) -> tuple[float, float]:
        yes, no = toxic.get(x, 0), clean.get(x, 0)
        ratio = (yes / (totals[1] + 1)) / ((no + 1) / (totals[0] + 1))
        return yes - no * totals[1] / max(totals[0], 1), ratio

    strengths = {x: strength(x) for x in known}
    # A beginning gives way to a longer one that has nearly all of its toxic documents and far fewer of the others.
    blunt = {x for y in known for x in shorter(y) if toxic.get(y, 0) >= 0.8 * toxic.get(x, 0) and clean.get(y, 0) < 0.6 * clean.get(x, 0)}
    ranked = sorted((x for x in known - blunt if strengths[x][1] >= LEAST_LIFT and toxic.get(x, 0) >= least), key=lambda x: (-strengths[x][0], -strengths[x][1], x))
    voters = list(dict.fromkeys([*lexicon, *ranked[:MAX_VOTERS]]))
    return voters, list(dict.fromkeys([*voters, *ranked[:MAX_FEATURES]]))


def train(rows: list[tuple[int, np.ndarray]], n_voters: int, features: list[str], counts: dict[int, int]) -> Classifier:
    """The label model on the votes, and the classifier on its posteriors. counts: all documents of each label, which rows are a sample of; a label of -1 is none."""
    votes = np.zeros((len(rows), n_voters), np.float32)
    for i, (_, found) in enumerate(rows):
        votes[i, found[found < n_voters]] = 1
    known = np.array([y for y, _ in rows], np.int64)
    sampled = np.bincount(known[known >= 0], minlength=2)
    stands_for = np.array([counts.get(y, 0) / max(int(sampled[y]), 1) for y in (0, 1)] + [1.0])[known]
    label_model = fit_label_model(votes, known, stands_for=stands_for)
    w, bias = fit_linear([found for _, found in rows], len(features), label_model.posterior(votes), stands_for=stands_for)
    return Classifier({x: float(v) for x, v in zip(features, w) if abs(v) > 1e-4}, bias)


def learn(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Classifier:
    """docs (doc_id, text) and labels (doc_id, toxic) of training rows only.

    The terms of the sample are counted on the executors; the driver gets the counts of those that enough toxic
    documents have, and the numbers of at most MAX_FEATURES + MAX_VOTERS features of each sampled document.
    """
    sample = sample_words(docs, labels, sample_docs)
    totals = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not totals.get(1):
        voters = [x for word in LEXICON for x in (word, word + "!")]
        rows = feature_rows(unlabelled_words(docs, sample_docs), voters)
        return train(rows, len(voters), voters, {}) if rows else Classifier({}, -4.0)
    least = max(LEAST_SUPPORT, LEAST_SHARE * totals[1])
    toxic = {r.term: r.n for r in term_counts(sample, 1).where(F.col("n") >= least).toLocalIterator()}
    known = {*toxic, *LEXICON, *(x + "!" for x in LEXICON)}
    shared = sample.sparkSession.sparkContext.broadcast(known)
    clean = {r.term: r.n for r in term_counts(sample, 0, shared).toLocalIterator()}
    voters, features = select_terms(toxic, clean, (totals.get(0, 0), totals[1]))
    return train(feature_rows(sample, features), len(voters), features, class_counts(docs, labels))


class Evidence(dict):
    """The known terms (a set or dictionary) of each word seen so far."""

    LIMIT = 400_000

    def __init__(self, known):
        super().__init__()
        self.known = known

    def __missing__(self, word: str) -> tuple[str, ...]:
        found = tuple(t for t in terms_of_word(word) if t in self.known or t + "!" in self.known)
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = found
        return found


def score_text(text: str | None, model: Classifier, evidence: Evidence) -> float:
    found = features_of(words_in(text), evidence.__getitem__)
    z = model.bias + sum(model.weights[x] for x in sorted(found) if x in model.weights)
    return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def toxicity_scores(docs: DataFrame, model: Classifier, carry: str | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted; with carry all columns of docs, and the score under that name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs if carry else docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    names = source.columns
    at = names.index("text")
    out_names = names if carry else ["doc_id", "held_out"]
    score = carry or "score"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        evidence = Evidence(model.weights)
        for batch in batches:
            scores = [score_text(t.as_py(), model, evidence) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)) for c in out_names), pa.array(scores, pa.float64())], names=[*out_names, score])

    found = source.mapInArrow(run, StructType([f for f in source.schema.fields if f.name in out_names]).add(score, DoubleType()))
    return found if carry else found.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def without_toxic(docs: DataFrame, model: Classifier, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold, with the columns of docs; repeated rows stay."""
    score = free_name(docs, "toxicity_score")
    return toxicity_scores(docs, model, score).where(F.col(score) < threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
