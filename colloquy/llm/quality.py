"""Quality by a regularised quadratic discriminant over transformed statistics of whole texts.

Every text is described by the same numbers (`FEATURES`): shares of kinds of characters and words, of what repeats, and
how they vary from line to line; shares are taken as arcsin of the root, counts as logarithms, so that they are nearer to
normal. Per class the labelled training documents give a mean and a covariance, from sums that Spark adds up over all of
them: the driver gets one row of sums a class. The covariances are shrunk twice, towards the pooled one by how
few documents a class has, then towards a multiple of the identity by the oracle-approximating rule. The inverse of each
Cholesky factor is kept; a text's score is the difference of two log-densities, each from a Mahalanobis distance in the
factor's coordinates. A logistic curve, fitted on at most `SAMPLE_DOCS` training documents (the first by hash), turns
the difference into a chance.

Defined cases: null, empty and blank texts all have the features of the empty text and get its score; a labelled id
counts with each row that has it, and as 0 if it has both labels; null labels are no labels; without documents of both
classes every score is the share of class 1 among the labels, a half without labels; repeated rows are scored each;
very long texts are read whole; an empty table gives an empty result; other columns are left aside or carried along,
whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from .common import free_name, written

#: Training documents on which the logistic curve is fitted at most.
SAMPLE_DOCS = 10_000
THRESHOLD = 0.3
FEATURES = (
    "chars", "words", "word_length", "line_words", "upper", "digits", "points", "symbols", "shouts", "bars", "spaces", "accents",
    "shouted_words", "marked_words", "long_words", "distinct_words", "top_word", "echoes", "distinct_pairs", "distinct_lines", "packed",
    "worst_symbols", "worst_upper", "worst_echoes", "plain_lines",
)
#: Words of a stretch in which the worst shares are looked for.
STRETCH = 40
#: Prior documents of the pooled covariance in each class's.
POOLED_WEIGHT = 30.0
#: Bytes of each kind of characters.
_BYTES = {name: np.frombuffer(chars, np.uint8) for name, chars in {"upper": bytes(range(65, 91)), "digits": b"0123456789", "points": b".,;:'\"()-", "symbols": b"#$%&*@^~+=<>{}[]\\/_`", "shouts": b"!?", "bars": b"|"}.items()}


def share(k: float, n: float) -> float:
    return float(np.arcsin(np.sqrt(min(1.0, k / n)))) if n else 0.0


def is_marked(word: str) -> bool:
    """Ends in a sign that ends no ordinary word, or in a doubled one."""
    last = word[-1]
    return not last.isalnum() and (last not in ".,;:!?)\"'" or last == word[-2:-1])


def worst(flags: np.ndarray) -> float:
    """The largest share of true flags in a stretch of STRETCH words; a last stretch of under a half belongs to the one before."""
    begins = np.arange(0, max(1, len(flags) - STRETCH // 2), STRETCH)
    return share(float((np.add.reduceat(flags, begins) / np.diff(np.r_[begins, len(flags)])).max()), 1.0) if len(flags) else 0.0


def described(text: str | None) -> list[float]:
    """The features of a whole text."""
    text = text or ""
    words = text.split()
    n, k = len(text), len(words)
    if not k:
        return [0.0] * len(FEATURES)
    raw = text.encode()
    bytes_ = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kinds = [share(bytes_[which].sum(), n) for which in _BYTES.values()]
    counts = Counter(words)
    shouted, marked = {w for w in counts if len(w) > 1 and w.isupper()}, {w for w in counts if is_marked(w)}
    number = {w: i for i, w in enumerate(counts)}
    codes = np.fromiter(map(number.__getitem__, words), np.int64, k)
    is_shouted, is_marked_ = (np.fromiter((w in which for w in counts), np.int64, len(counts))[codes] for which in (shouted, marked))
    echo = np.r_[0, codes[1:] == codes[:-1]].astype(np.int64)
    pairs = len(np.unique(codes[1:] * len(counts) + codes[:-1]))
    letters = sum(len(w) * c for w, c in counts.items())
    lines = [line for line in text.split("\n") if line.strip()]
    return [
        np.log1p(n), np.log1p(k), np.log(letters / k), np.log1p(k / max(1, len(lines))), *kinds,
        share(n - letters, n), share(len(raw) - n, len(raw)), share(is_shouted.sum(), k), share(is_marked_.sum(), k), share(sum(c for w, c in counts.items() if len(w) > 20), k),
        np.log1p(len(counts)) / np.log1p(k), share(max(counts.values()), k), share(echo.sum(), k), np.log1p(pairs) / np.log1p(k), share(len(set(lines)), len(lines)), np.log(len(zlib.compress(raw, 1)) / (len(raw) + 20)),
        worst(is_marked_), worst(is_shouted), worst(echo), share(sum(line.rstrip()[-1] in ".!?:\"" for line in lines), len(lines)),
    ]


@dataclass
class Sums:
    """Of one class: documents, sums of their features and of the features' products."""

    n: float
    total: np.ndarray
    products: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return self.total / max(self.n, 1)

    @property
    def scatter(self) -> np.ndarray:
        return self.products - self.n * np.outer(self.mean, self.mean)


def shrunk(covariance: np.ndarray, n: float) -> np.ndarray:
    """Towards a multiple of the identity, as far as the oracle-approximating rule says for so many rows."""
    p = len(covariance)
    squares, trace = float((covariance * covariance).sum()), float(np.trace(covariance))
    spare = (n + 1 - 2 / p) * (squares - trace * trace / p)
    rho = 1.0 if spare <= 0 else min(1.0, ((1 - 2 / p) * squares + trace * trace) / spare)
    rho = max(rho, 1e-3)
    return (1 - rho) * covariance + rho * max(trace / p, 1e-9) * np.eye(p)


@dataclass
class Density:
    """A normal density: the inverse of its covariance's Cholesky factor, and the factor's log-determinant, are kept."""

    mean: np.ndarray
    inverse: np.ndarray
    log_det: float

    @classmethod
    def of(cls, mean: np.ndarray, covariance: np.ndarray) -> Density:
        factor = np.linalg.cholesky(covariance)
        return cls(mean, np.linalg.inv(factor), 2 * float(np.log(np.diag(factor)).sum()))

    def log(self, x: np.ndarray) -> np.ndarray:
        """Without the constant that all densities share."""
        y = (x - self.mean) @ self.inverse.T
        return -0.5 * ((y * y).sum(axis=1) + self.log_det)


@dataclass
class Discriminant:
    """Features are centred and scaled first; low and high are the classes' densities, or None where a class is missing."""

    centre: np.ndarray
    scale: np.ndarray
    low: Density | None
    high: Density | None
    slope: float
    bias: float

    def difference(self, features: np.ndarray) -> np.ndarray:
        """Signed logarithm of the difference of the log-densities."""
        if self.low is None or self.high is None:
            return np.zeros(len(features))
        x = (features - self.centre) / self.scale
        d = self.high.log(x) - self.low.log(x)
        return np.sign(d) * np.log1p(np.abs(d))

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(features) + self.bias, -500, 500)))


def discriminant(low: Sums, high: Sums) -> Discriminant:
    """Without a curve yet."""
    p, n = len(FEATURES), low.n + high.n
    centre, scale = np.zeros(p), np.ones(p)
    odds = float(np.log((high.n + 0.5) / (low.n + 0.5))) if n else 0.0
    if low.n < 2 or high.n < 2:
        return Discriminant(centre, scale, None, None, 0.0, odds)
    pooled = (low.scatter + high.scatter) / (n - 2)
    centre, scale = (low.total + high.total) / n, np.sqrt(np.maximum(np.diag(pooled), 1e-8))
    pooled = pooled / np.outer(scale, scale)

    def density(sums: Sums) -> Density:
        own = sums.scatter / np.outer(scale, scale)
        return Density.of((sums.mean - centre) / scale, shrunk((own + POOLED_WEIGHT * pooled) / (sums.n - 1 + POOLED_WEIGHT), sums.n + POOLED_WEIGHT))

    return Discriminant(centre, scale, density(low), density(high), 1.0, odds)


def with_curve(model: Discriminant, d: np.ndarray, label: np.ndarray) -> Discriminant:
    """The logistic curve over the difference, by bounded Newton steps from the slope 1; a prior keeps it near that where classes don't overlap."""
    if model.low is None or not 0 < label.sum() < len(label):
        return model
    x, first = np.stack([d, np.ones_like(d)], axis=1), np.array([1.0, 0.0])
    w = first.copy()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(2), x.T @ (p - label) + (w - first))
        w = w - step * min(1.0, 0.5 / max(np.abs(step).max(), 1e-12))
    model.slope, model.bias = max(float(w[0]), 0.05), float(w[1])
    return model


def known_labels(labels: DataFrame) -> DataFrame:
    """its_id and quality, one row per labelled id."""
    return labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").alias("its_id")).agg((F.min("quality") >= 1).cast("int").alias("quality"))


def features_of(docs: DataFrame) -> DataFrame:
    """doc_id and features, a row per document: learning and scoring both read these, so that each text is read once."""
    kept = ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([described(t.as_py()) for t in batch.column(len(kept))]).reshape(len(batch), len(FEATURES))
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * len(FEATURES)), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], values], [*kept, "features"])

    source = docs.select(*kept, "text")
    return source.mapInArrow(run, StructType(source.schema.fields[:-1]).add("features", ArrayType(DoubleType())))


def class_sums(rows: DataFrame) -> dict[int, Sums]:
    """rows: quality, features. Sums within tasks, then over them; as many rows of sums reach the driver as there are classes and products."""
    p = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {y: np.zeros(1 + p + p * p) for y in (0, 1)}
        for batch in batches:
            label = batch.column(0).to_numpy(zero_copy_only=False)
            x = matrix(batch.column(1))
            for y, s in sums.items():
                own = x[label == y]
                s += np.r_[len(own), own.sum(axis=0), (own.T @ own).ravel()]
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array([sums[0].tolist(), sums[1].tolist()], pa.list_(pa.float64()))], ["quality", "sums"])

    each = rows.select("quality", "features").mapInArrow(run, "quality int, sums array<double>").select("quality", F.posexplode("sums"))
    out = {y: np.zeros(1 + p + p * p) for y in (0, 1)}
    for r in each.groupBy("quality", "pos").agg(F.sum("col").alias("s")).collect():
        out[r.quality][r.pos] = r.s
    return {y: Sums(v[0], v[1 : p + 1], v[p + 1 :].reshape(p, p)) for y, v in out.items()}


def learn(rows: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Discriminant:
    """rows: doc_id, features. labels: doc_id, quality, of training rows only."""
    known = rows.select("doc_id", "features").join(known_labels(labels), F.col("doc_id") == F.col("its_id"))
    sums = class_sums(known)
    model = discriminant(sums[0], sums[1])
    first = known.withColumns({"h": F.xxhash64("doc_id"), "f": F.xxhash64("features")}).orderBy("h", "f").limit(sample_docs)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.difference(matrix(batch.column(1))))], ["quality", "difference"])

    sample = first.select("quality", "features").mapInArrow(run, "quality int, difference double").toPandas()
    return with_curve(model, sample["difference"].to_numpy(float), sample["quality"].to_numpy(float))


def matrix(features: pa.Array) -> np.ndarray:
    return features.flatten().to_numpy().reshape(-1, len(FEATURES))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def scored(source: DataFrame, model: Discriminant, score: str, given: str) -> DataFrame:
    """source's columns but the features, and score. given: the column of texts, which stays, or of features."""
    shared = source.sparkSession.sparkContext.broadcast(model)
    names = source.columns
    at, is_text = names.index(given), dict(source.dtypes)[given] == "string"
    kept = [i for i in range(len(names)) if is_text or i != at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([described(t.as_py()) for t in batch.column(at)]).reshape(len(batch), len(FEATURES)) if is_text else matrix(batch.column(at))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(shared.value.score(x))], names=[*(names[i] for i in kept), score])

    return source.mapInArrow(run, StructType([source.schema.fields[i] for i in kept]).add(score, DoubleType()))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of docs (doc_id, text), learnt from labels (doc_id, quality) of training rows."""
    rows = written(features_of(docs), "quality-features")
    found = scored(rows.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "features"), learn(rows, labels), "score", "features")
    return found.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def of_quality(docs: DataFrame, model: Discriminant, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score at least the threshold, with the columns of docs; repeated rows stay."""
    score = free_name(docs, "quality_score")
    return scored(docs, model, score, "text").where(F.col(score) >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
