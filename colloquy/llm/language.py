"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy.

A text is its lower-cased, white-space separated words; a word is a sequence of bytes (of at most `LONGEST`, longer ones
are cut into several, between characters) between two boundary marks. A forward and a backward GRU read every sequence,
and a softmax over both states labels every byte position with a language. A document's distribution is pooled from all
its positions: the mean of their log probabilities, sharpened as evidence adds up (by the square root of the number of
positions, at most tenfold) and normalised again. `train` learns the network by backpropagation through time (Adam) on
words of a bounded sample of labelled documents, each position labelled with its document's language.

The states begin anew at each word, so a word's positions score the same wherever it stands; a task therefore reads a
word once and remembers its sums, while every position of the whole text counts.

Training takes the same number of labelled documents from each language, by hash, `SAMPLE_DOCS` in all at most, and
`SAMPLE_WORDS` words of each; equal rows count once there. Beyond `MAX_LANGUAGES` languages the commonest are learned.

Defined cases: a text that is null or has no letter is `und` with score 0; a language is whatever value the labels have;
with no labelled document at all every text is `und`; ties go to the language that sorts first; repeated rows and null
or repeated ids give results of their own; very long texts are pooled piece by piece; an empty table gives an empty
result; other columns are left aside, or carried along whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from .common import free_name

#: Labelled documents that training uses at most, words of each (spread over the whole text), and languages.
SAMPLE_DOCS = 4000
SAMPLE_WORDS = 60
MAX_LANGUAGES = 200
HIDDEN = 24
EMBEDDING = 16
STEPS = 500
BATCH = 512
LONGEST = 64
#: Words that a task remembers; beyond, it starts anew.
REMEMBERED = 300_000
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")
_EDGE = 256  # boundary mark


@dataclass
class Model:
    languages: list[str]
    weights: dict[str, np.ndarray]


def pieces_of(word: bytes) -> list[bytes]:
    """The word in pieces of at most LONGEST bytes, cut between characters."""
    out = []
    while len(word) > LONGEST:
        at = LONGEST
        while at > LONGEST - 4 and word[at] & 0xC0 == 0x80:
            at -= 1
        out.append(word[:at])
        word = word[at:]
    return [*out, word]


def initial(n_languages: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    def normal(*shape: int) -> np.ndarray:
        return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

    w = {"embed": normal(257, EMBEDDING) * 4, "out": normal(2 * HIDDEN, n_languages), "out_b": np.zeros(n_languages, np.float32)}
    for d in "fb":
        w |= {f"{d}_in": normal(EMBEDDING, 3 * HIDDEN), f"{d}_b": np.zeros(3 * HIDDEN, np.float32), f"{d}_gate": normal(HIDDEN, 2 * HIDDEN), f"{d}_new": normal(HIDDEN, HIDDEN)}
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def pad(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(time, word) bytes between boundary marks, and which positions are bytes of the word."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    most = int(lengths.max())
    codes = np.full((most + 2, len(words)), _EDGE, np.int64)
    real = np.zeros((most + 2, len(words)), bool)
    real[1:-1] = np.arange(most)[:, None] < lengths[None, :]
    codes.T[real.T] = np.frombuffer(b"".join(words), np.uint8)
    return codes, real


def run_direction(w: dict[str, np.ndarray], d: str, table: np.ndarray, codes: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States after each position; with keep also what the backward pass needs. table: input part of each byte's gates."""
    steps, n = codes.shape
    h = np.zeros((n, HIDDEN), np.float32)
    states, kept = np.empty((steps, n, HIDDEN), np.float32), []
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        x = table[codes[t]]
        gates = sigmoid(x[:, : 2 * HIDDEN] + h @ w[f"{d}_gate"])
        r, z = gates[:, :HIDDEN], gates[:, HIDDEN:]
        new = np.tanh(x[:, 2 * HIDDEN :] + (r * h) @ w[f"{d}_new"])
        if keep:
            kept.append((t, h, r, z, new))
        h = h + z * (new - h)
        states[t] = h
    return states, kept


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=-1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=-1, keepdims=True))


def tables(w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {d: w["embed"] @ w[f"{d}_in"] + w[f"{d}_b"] for d in "fb"}


def label_positions(w: dict[str, np.ndarray], codes: np.ndarray, input_tables: dict[str, np.ndarray]) -> np.ndarray:
    """Log probabilities (time, word, language)."""
    f, _ = run_direction(w, "f", input_tables["f"], codes, False)
    b, _ = run_direction(w, "b", input_tables["b"], codes, False)
    return log_softmax(f @ w["out"][:HIDDEN] + b @ w["out"][HIDDEN:] + w["out_b"])


def gradients(w: dict[str, np.ndarray], codes: np.ndarray, real: np.ndarray, labels: np.ndarray, row_weights: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over positions and its gradient, through time in both directions."""
    t_all = tables(w)
    states, kept = {}, {}
    for d in "fb":
        states[d], kept[d] = run_direction(w, d, t_all[d], codes, True)
    both = np.concatenate([states["f"], states["b"]], axis=2)
    logp = log_softmax(both @ w["out"] + w["out_b"])
    mask = real * row_weights[None, :]
    total = max(float(mask.sum()), 1.0)
    index = np.broadcast_to(labels[None, :, None], (*real.shape, 1))
    loss = -float((np.take_along_axis(logp, index, 2)[:, :, 0] * mask).sum()) / total
    d_logits = np.exp(logp)
    np.put_along_axis(d_logits, index, np.take_along_axis(d_logits, index, 2) - 1, 2)
    d_logits *= (mask / total)[:, :, None]
    g = {k: np.zeros_like(v) for k, v in w.items()}
    n_lang = d_logits.shape[2]
    g["out"] = both.reshape(-1, 2 * HIDDEN).T @ d_logits.reshape(-1, n_lang)
    g["out_b"] = d_logits.sum(axis=(0, 1))
    d_both = d_logits @ w["out"].T
    for k, d in enumerate("fb"):
        d_states = d_both[:, :, k * HIDDEN : (k + 1) * HIDDEN]
        d_table = np.zeros_like(t_all[d])
        d_h = np.zeros_like(d_states[0])
        for t, h, r, z, new in reversed(kept[d]):
            d_h = d_h + d_states[t]
            d_new = d_h * z * (1 - new * new)
            d_z = d_h * (new - h) * z * (1 - z)
            d_rh = d_new @ w[f"{d}_new"].T
            d_r = d_rh * h * r * (1 - r)
            d_gates = np.concatenate([d_r, d_z], axis=1)
            g[f"{d}_new"] += (r * h).T @ d_new
            g[f"{d}_gate"] += h.T @ d_gates
            np.add.at(d_table, codes[t], np.concatenate([d_gates, d_new], axis=1))
            d_h = d_h * (1 - z) + d_rh * r + d_gates @ w[f"{d}_gate"].T
        g[f"{d}_in"] = w["embed"].T @ d_table
        g[f"{d}_b"] = d_table.sum(axis=0)
        g["embed"] += d_table @ w[f"{d}_in"].T
    return loss, {k: v.astype(np.float32) for k, v in g.items()}


def train(samples: list[tuple[str, list[bytes]]], steps: int = STEPS, seed: int = 7) -> Model:
    """samples: language and words of each labelled document. Languages count alike, however many documents they have."""
    languages = sorted({lang for lang, words in samples if words})
    if not languages:
        return Model([], {})
    number = {lang: i for i, lang in enumerate(languages)}
    rng = np.random.default_rng(seed)
    pieces = [(p, number[lang]) for lang, words in samples for w in words for p in pieces_of(w)]
    words, labels = [p for p, _ in pieces], np.array([y for _, y in pieces])
    share = np.bincount(labels, minlength=len(languages)) / len(labels)
    w = initial(len(languages), rng)
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    # Batches of words of like length, in random order.
    lengths = np.array([len(p) for p in words])
    for step in range(1, steps + 1):
        centre = lengths[rng.integers(len(words))]
        near = rng.integers(len(words), size=4 * BATCH)
        pick = near[np.argsort(np.abs(lengths[near] - centre), kind="stable")[:BATCH]]
        codes, real = pad([words[i] for i in pick])
        y = labels[pick]
        _, g = gradients(w, codes, real, y, (1.0 / (len(languages) * share[y])).astype(np.float32))
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        rate = 0.01 * min(1.0, step / 30) * (0.5 * (1 + np.cos(np.pi * step / steps)) + 0.02)
        for k in w:
            x = g[k] * min(1.0, 1.0 / max(norm, 1e-9))
            m[k] += 0.1 * (x - m[k])
            v[k] += 0.01 * (x * x - v[k])
            w[k] = w[k] - (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Model(languages, w)


class Words(dict):
    """Number of each word of a task, in the order of their first sight."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Reader:
    """Sums of position log probabilities of words, remembered by word."""

    def __init__(self, model: Model):
        self.model, self.tables = model, tables(model.weights) if model.languages else {}
        self.forget()

    def forget(self) -> None:
        self.words, self.n_read = Words(), 0
        self.sums = np.zeros((1024, len(self.model.languages)), np.float32)

    def read_new(self) -> None:
        fresh = list(self.words)[self.n_read :] if self.n_read < len(self.words) else []
        if not fresh:
            return
        if len(self.sums) < len(self.words):
            self.sums = np.concatenate([self.sums, np.zeros((len(self.words), self.sums.shape[1]), np.float32)])
        parts = [(self.n_read + i, p) for i, word in enumerate(fresh) for p in pieces_of(word)]
        parts.sort(key=lambda x: len(x[1]))
        for at in range(0, len(parts), 4096):
            some = parts[at : at + 4096]
            codes, real = pad([p for _, p in some])
            logp = label_positions(self.model.weights, codes, self.tables)
            np.add.at(self.sums, [i for i, _ in some], (logp * real[:, :, None]).sum(axis=0))
        self.n_read = len(self.words)

    def distribution(self, text: str) -> tuple[np.ndarray, int]:
        """Summed log probabilities and the number of positions of a text."""
        total, n = np.zeros(len(self.model.languages)), 0
        words = text.lower().encode().split()
        for at in range(0, len(words), 1 << 18):
            some = words[at : at + (1 << 18)]
            ids = np.fromiter(map(self.words.__getitem__, some), np.int64, len(some))
            self.read_new()
            total += self.sums[ids].sum(axis=0, dtype=np.float64)
            n += sum(map(len, some))
            if len(self.words) > REMEMBERED:
                self.forget()
        return total, n

    def warm(self, texts: list[str]) -> None:
        """Reads the new words of several texts together."""
        for text in texts:
            for word in text.lower().encode().split():
                self.words[word]
            if len(self.words) > REMEMBERED:
                self.forget()
        self.read_new()

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.model.languages or not _LETTER.search(text):
            return UNDETERMINED, 0.0
        total, n = self.distribution(text)
        # The mean over positions, made sharper with their number as evidence adds up, at most tenfold.
        p = np.exp(log_softmax(total / n * min(10.0, max(1.0, n**0.5))))
        best = int(p.argmax())
        return self.model.languages[best], float(min(1.0, p[best]))


def sample_of(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_words: int = SAMPLE_WORDS) -> list[tuple[str, list[bytes]]]:
    """Language and evenly spread words of at most sample_docs labelled documents; the words are chosen on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1):
                words = (text.as_py() or "").lower().encode().split()
                step = max(1.0, len(words) / sample_words)
                out.append([words[int(i * step)] for i in range(min(sample_words, len(words)))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.binary()))], ["lang", "words"])

    known = docs.where("lang is not null")
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()
    quota = max(1, sample_docs // max(1, len(counts)))
    # About twice the quota of each language by hash, then exactly the quota: what is ordered stays bounded.
    key = F.xxhash64("doc_id", "text")
    share = F.create_map(*[F.lit(x) for r in counts for x in (r.lang, min(1.0, (2.0 * quota + 20) / r["count"]))]) if counts else F.lit(None)
    drawn = known.select("lang", "text", key.alias("key")).where(F.pmod("key", F.lit(1 << 30)) < F.try_element_at(share, F.col("lang")) * F.lit(float(1 << 30))) if counts else known.select("lang", "text", key.alias("key"))
    keys = drawn.select("lang", "key").distinct().withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("key"))).where(F.col("nth") <= quota)
    chosen = keys.select(F.col("lang").alias("its_lang"), F.col("key").alias("its_key"))
    met = drawn.join(F.broadcast(chosen), (F.col("lang") == F.col("its_lang")) & (F.col("key") == F.col("its_key"))).dropDuplicates(["lang", "key"]).select("lang", "text")
    rows = met.mapInArrow(run, "lang string, words array<binary>").toLocalIterator()
    return sorted((r.lang, [bytes(w) for w in r.words]) for r in rows)


def training_rows(docs: DataFrame) -> DataFrame:
    """All but the held-out quarter."""
    return docs.where(~held_out())


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame) -> Model:
    return train(sample_of(training_rows(docs)))


def identify(docs: DataFrame, model: Model, carry: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each document; with carry all columns of docs, and the last two under those names."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    source = docs if carry else docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    names = source.columns
    at = names.index("text")
    out_names = names if carry else ["doc_id", "held_out"]
    label, score = carry or ("lang_pred", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = part.column(at).to_pylist()
                if shared.value.languages:
                    reader.warm([t for t in texts if t])
                found = [reader.predict(t) for t in texts]
                columns = [part.column(names.index(c)) for c in out_names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([l for l, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], [*out_names, label, score])

    schema = StructType([f for f in source.schema.fields if f.name in out_names]).add(label, StringType()).add(score, DoubleType())
    return source.mapInArrow(run, schema)


def with_language(docs: DataFrame, model: Model, least: float = 0.5, languages: tuple[str, ...] | None = None) -> DataFrame:
    """The rows of docs in a determined language (one of languages, if given) that scores least or more, with the columns of docs."""
    label = free_name(docs, "lang_pred")
    score = free_name(docs, "lang_score")
    found = identify(docs, model, (label, score)).where((F.col(label) != UNDETERMINED) & (F.col(score) >= least))
    if languages is not None:
        found = found.where(F.col(label).isin(*languages))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])
