"""The near-duplicate stage of the pipeline: SimHash anchors and what they can't reach; one document of each group stays.

Two texts link if their sets of `shingle`-word shingles have a Jaccard similarity of at least `least`. Texts of equal
sets are one node. Candidates come from three places, and each is checked exactly, by the similarity of the texts:

* the operator's own anchors (`simhash.linked`) over 64-bit fingerprints of the shingle sets: all within two bits;
* at a similarity of 0.8 fingerprints differ in about 10 bits, in 15 or more for one pair in twenty, which no covering
  by anchors reaches. So candidates also share one of BANDS bands of ROWS minimum hashes; at 0.8 a pair shares none with
  a chance of 7 in 100,000. Those whose one-bit sketches differ too much already go. Of a band's group each node is first
compared with the NEXT before it in the order of the sketches, turned from band to band, which brings near copies
  together without all their pairs;
* groups of a band of which not all came together are joined exactly, by the rarest of their shingles (`rare_pairs`):
  sets of that similarity share one of the rarest fifth of either's shingles. Nodes that share a rare shingle are
  compared across components in blocks of BLOCK nodes, so that no task holds a whole group and no pair is left out.

Defined cases: null and empty texts (no words) are one group; texts of fewer words are one shingle; ties, repeated rows and null ids
as in `simhash.deduplicated`; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from .common import cut, free_name, written
from .simhash import SEED, components, linked

SHINGLE = 5
LEAST = 0.8
BANDS, ROWS = 24, 5
NEXT = 3
BLOCK = 512
#: Sets of up to so many shingles are compared where they meet at a rare one; larger ones by their texts afterwards.
SET_SHINGLES = 1000
#: Bits of BANDS * ROWS in which the sketches of a candidate pair may differ: 12 are expected at 0.8, with a deviation of 3.3.
SKETCH_BITS = 27
#: Shingles that are hashed at once.
PIECE = 1 << 12
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_RANDOM = np.random.default_rng(SEED)
_FLIP = _RANDOM.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64)
_TIMES = _RANDOM.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)
_PLACES = _RANDOM.integers(0, 1 << 64, 64, np.uint64) | np.uint64(1)
_OF_BAND = _RANDOM.integers(0, 1 << 64, (BANDS, 1), np.uint64)


class WordHashes(dict):
    """Hash of each word seen so far."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word, SEED)
        return found


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: bytes | None, hashes: WordHashes, n: int = SHINGLE) -> np.ndarray:
    """The distinct shingles' hashes, sorted; none without words."""
    words = text.translate(_LOWER).split() if text else []
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(n, len(h))
    total = np.full(max(len(h) - k + 1, 0) if k else 0, k, np.uint64)
    for i in range(k):
        total += mixed(h[i : i + len(total)] * _PLACES[i])
    return np.unique(mixed(total))


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    common = len(np.intersect1d(x, y, assume_unique=True))
    every = len(x) + len(y) - common
    return common / every if every else 1.0


def minimums(found: np.ndarray) -> np.ndarray:
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(found), PIECE):
        low = np.minimum(low, ((found[a : a + PIECE] ^ _FLIP) * _TIMES).min(axis=1))
    return low


def signature(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bands' keys and the sketch (two numbers) of a set that is not empty."""
    low = minimums(found)
    keys = mixed((mixed(low.reshape(BANDS, ROWS)) * _PLACES[:ROWS]).sum(axis=1, keepdims=True) + _OF_BAND)[:, 0]
    bits = np.packbits(((mixed(low) >> np.uint64(20)) & np.uint64(1)).astype(np.uint8))
    return keys.view(np.int64), np.frombuffer(bits.tobytes().ljust(16, b"\0"), np.int64)


def fingerprint_of(found: np.ndarray) -> int:
    """Bits set in more than half of a set's hashes."""
    counts = np.zeros(64, np.int64)
    for a in range(0, len(found), PIECE):
        counts += np.unpackbits(found[a : a + PIECE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((counts * 2 > len(found)).astype(np.uint8), bitorder="little").view(np.int64)[0])


def signatures(docs: DataFrame, shingle: int, names: tuple[str, str, str]) -> DataFrame:
    """docs with node (hash of the shingle set, 0 without words), keys and sketch (two numbers, then the fingerprint) under these names."""
    in_names = docs.columns
    at = in_names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes = WordHashes()
        for batch in batches:
            nodes, keys, sketches = [], [], []
            for t in batch.column(at).cast(pa.binary()):
                found = shingle_set(t.as_py(), hashes, shingle)
                nodes.append(np.array([xxhash.xxh64_intdigest(found.tobytes(), SEED)], np.uint64).view(np.int64)[0] if len(found) else 0)
                key, sketch = signature(found) if len(found) else ((), ())
                keys.append(key)
                sketches.append([*sketch, fingerprint_of(found)] if len(found) else [])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))], [*in_names, *names])

    schema = StructType(list(docs.schema.fields)).add(names[0], LongType()).add(names[1], ArrayType(LongType())).add(names[2], ArrayType(LongType()))
    return docs.mapInArrow(run, schema)


def banded(nodes: DataFrame) -> DataFrame:
    """Of each band's groups, in the order of their sketches: a, b and bits (that their sketches differ in) of nodes at most
    NEXT places apart; and for groups of more than NEXT + 1 nodes each node, the band's key and -1. nodes: node, keys, sketch.
    """
    each = nodes.select("node", F.posexplode("keys").alias("band", "key"), F.col("sketch")[0].alias("s0"), F.col("sketch")[1].alias("s1"))
    # Each band sorts by another part of the sketch first.
    turned = F.expr("shiftleft(s0, (band * 5) % 64) ^ shiftrightunsigned(s1, (band * 3) % 64)")
    rows = each.select("key", turned.alias("turned"), "node", "s0", "s1").repartition("key").sortWithinPartitions("key", "turned", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a, b, bits):
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(bits, pa.int32())], ["a", "b", "bits"])

        rest = [np.zeros(0, np.int64)] * 4
        for batch in batches:
            held = len(rest[0])
            key, node, s0, s1 = (np.concatenate([r, batch.column(c).to_numpy(zero_copy_only=False)]) for r, c in zip(rest, (0, 2, 3, 4)))
            for k in range(1, NEXT + 2):
                i = np.arange(max(held, k), len(key))
                i = i[key[i] == key[i - k]]
                if not len(i):
                    break
                if k > NEXT:
                    large = np.unique(np.concatenate([i, i - k]))
                    yield out(node[large], key[large], np.full(len(large), -1))
                    break
                bits = np.bitwise_count((s0[i] ^ s0[i - k]).view(np.uint64)).astype(np.int32) + np.bitwise_count((s1[i] ^ s1[i - k]).view(np.uint64))
                ok = (bits <= SKETCH_BITS) & (node[i] != node[i - k])
                i, bits = i[ok], bits[ok]
                if len(i):
                    yield out(np.minimum(node[i], node[i - k]), np.maximum(node[i], node[i - k]), bits)
            rest = [x[-NEXT - 1 :] for x in (key, node, s0, s1)]

    return rows.mapInArrow(run, "a long, b long, bits int")


def anchored(nodes: DataFrame) -> DataFrame:
    """a, b, bits of pairs whose fingerprints the anchors link, through one node of each fingerprint."""
    own = cut(nodes.where("size(sketch) > 0").select("node", F.col("sketch")[2].alias("fp")))
    first = cut(own.groupBy("fp").agg(F.min("node").alias("first")))
    equal = own.join(first, "fp").select(F.col("first").alias("a"), F.col("node").alias("b")).where("a <> b")
    near = linked(first.select("fp"))
    for x in "ab":
        near = near.join(first.select(F.col("fp").alias(x), F.col("first").alias(f"node_{x}")), x)
    between = near.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))
    return equal.unionByName(between).select("a", "b", F.lit(0).alias("bits"))


def rare_pairs(open_nodes: DataFrame, shingle: int, least: float) -> DataFrame:
    """a, b: pairs of different labels that share one of either's rarest shingles and may be similar enough, by 32 bits
    of each shingle (which can't hide a shared one) or, for sets too large for that, by their sizes and places; of
    pairs that would join the same components enough to join them. open_nodes: node, label, text.

    Sets of a similarity of least or more share at least ceil(least * n) of the n shingles of either, so one of the
    n - ceil(least * n) + 1 that come first in an order that both follow: here the rarest first. Where they share one at
    places i and j, at most 1 + min(n - i, m - j) shingles from there on are shared; the first one they share leaves room
    for all that the similarity needs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                found = shingle_set(text.as_py(), hashes, shingle).view(np.int64)
                for at in range(0, len(found), PIECE):
                    some = found[at : at + PIECE]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), node, np.int64)), pa.array(np.full(len(some), len(found), np.int32)), pa.array(some)], ["node", "n", "shingle"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            found = [shingle_set(text.as_py(), hashes, shingle).view(np.int64) for text in batch.column(2).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([np.sort((x >> 32).astype(np.int32)) if len(x) <= SET_SHINGLES else None for x in found], pa.list_(pa.int32()))], ["its_node", "label", "members"])

    labels = written(open_nodes.select("node", "label", "text").mapInArrow(sets, "its_node long, label long, members array<int>"), "open-sets")
    each = written(open_nodes.select("node", "text").mapInArrow(run, "node long, n int, shingle long"), "open-shingles")
    often = each.groupBy("shingle").agg(F.count("*").cast("int").alias("often"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("often", "shingle"))
    prefix = each.join(often, "shingle").withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * F.lit(least - 1e-9)) + 1)
    shared = prefix.where("often > 1").join(labels.select("its_node", "label").hint("merge"), F.col("node") == F.col("its_node")).select("shingle", "node", "label", F.col("n").cast("long").alias("n"), F.col("place").cast("long").alias("place"))
    rare = cut(shared)
    torn = rare.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("n").alias("least_n")).where("low < high").select("shingle", "least_n")
    # Places that leave room with the smallest partner only; with a larger one more has to be shared.
    rare = cut(rare.join(torn, "shingle").where(1 + F.col("n") - F.col("place") >= F.lit(least / (1 + least)) * (F.col("n") + F.col("least_n")) - 1e-9).drop("least_n"))
    members = labels.select("its_node", "members").hint("merge")
    sizes = rare.groupBy("shingle").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    salted = rare.join(sizes, "shingle").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    meeting = salted.select("shingle", "node", "label", "n", "place", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pairs_of = meeting.select("shingle", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "node", "label", "n", "place")
    rows = pairs_of.join(members, F.col("node") == F.col("its_node")).repartition("shingle", "low", "high").sortWithinPartitions("shingle", "low", "high", "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(group: list) -> Iterator[pa.RecordBatch]:
            node, label, n, place, own = *(np.array(x) for x in group[:4]), group[4]
            for i in range(len(node) - 1):
                room = 1 + np.minimum(n[i] - place[i], n[i + 1 :] - place[i + 1 :])
                j = np.flatnonzero((label[i + 1 :] != label[i]) & (room >= least / (1 + least) * (n[i] + n[i + 1 :]) - 1e-9)) + i + 1
                told = [x for x in j.tolist() if own[i] is not None and own[x] is not None]
                near = []
                if told:
                    every = np.concatenate([own[x] for x in told])
                    at = np.minimum(np.searchsorted(own[i], every), len(own[i]) - 1)
                    common = np.add.reduceat((own[i][at] == every).astype(np.int64), np.append(0, np.cumsum(n[told])[:-1]))
                    near = np.array(told)[common >= least * (n[i] + n[told] - common)].tolist()
                open_ones = [x for x in j.tolist() if own[i] is None or own[x] is None]
                some = open_ones
                for x in near:
                    if label[x] != label[i]:
                        some.append(x)
                        label[label == label[x]] = label[i]  # one component from here on
                if some:
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[some])), pa.array(np.maximum(node[i], node[some]))], ["a", "b"])

        held: list[list] = [[], [], [], [], []]
        key = None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in range(7)]
            own = [x.values.to_numpy(zero_copy_only=False) if x.is_valid else None for x in batch.column(7)]
            for k, row in enumerate(zip(*columns[:3])):
                if row != key:
                    yield from pairs(held)
                    held, key = [[], [], [], [], []], row
                for values, column in zip(held, (*columns[3:], own)):
                    values.append(column[k])
        yield from pairs(held)

    return rows.select("shingle", "low", "high", "node", "label", "n", "place", "members").mapInArrow(compare, "a long, b long").distinct()


def judged(pairs: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """a, b, near of each pair, from the texts (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            near = [jaccard(*(shingle_set(t.as_py(), hashes, shingle) for t in two)) >= least for two in zip(*(batch.column(c).cast(pa.binary()) for c in (2, 3)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.bool_())], ["a", "b", "near"])

    one, two = (texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    return pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, near boolean")


def deduplicated(docs: DataFrame, shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """One row of each group, with the columns of docs: the one of the smallest doc_id (nulls last, then the first row as read)."""
    row, node, keys, sketch = (free_name(docs, x) for x in ("row", "node", "keys", "sketch"))
    kept = written(signatures(docs, shingle, (node, keys, sketch)).withColumn(row, F.monotonically_increasing_id()), "near-copies")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col(row).alias("row"))).alias("first")
    nodes = cut(kept.groupBy(F.col(node).alias("node")).agg(first, F.min(F.struct(F.col(keys).alias("keys"), F.col(sketch).alias("sketch"))).alias("s")).select("node", "first", "s.keys", "s.sketch"))
    found = written(banded(nodes).unionByName(anchored(nodes)), "near-copy-pairs")
    left = cut(found.where("bits >= 0").groupBy("a", "b").agg(F.min("bits").alias("bits")))
    large = cut(found.where("bits < 0").select(F.col("a").alias("node"), F.col("b").alias("key")).distinct())
    paired = left.select(F.col("a").alias("node")).unionByName(left.select(F.col("b").alias("node"))).unionByName(large.select("node")).distinct()
    rows = nodes.join(paired, "node", "left_semi").select("node", F.col("first.row").alias("at"))
    texts = written(kept.select(F.col(row).alias("at"), "text").join(rows, "at").select("node", "text"), "near-copy-texts")
    grouped = nodes
    if not left.isEmpty() or not large.isEmpty():
        # The likeliest pair of each node first; most others then are inside one group and need no texts.
        first_of = cut(left.groupBy("a").agg(F.min(F.struct("bits", "b")).alias("best")).select("a", "best.b"))
        labels = components(cut(judged(first_of, texts, shingle, least).where("near").select("a", "b")))
        rest = apart(left.join(first_of.hint("merge"), ["a", "b"], "left_anti"), labels)
        labels = components(cut(judged(rest, texts, shingle, least).where("near").select("a", "b")), known=labels)
        still_open = torn(large, labels)
        if not still_open.isEmpty():
            pairs = cut(rare_pairs(still_open.join(texts, "node"), shingle, least))
            labels = components(cut(judged(pairs, texts, shingle, least).where("near").select("a", "b")), known=labels)
        grouped = nodes.join(labels.hint("merge"), "node", "left").withColumn("node", F.coalesce("label", "node"))
    best = grouped.groupBy("node").agg(F.min("first").alias("first")).select(F.col("first.row").alias(row))
    return kept.join(best, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def torn(large: DataFrame, labels: DataFrame) -> DataFrame:
    """node and label of all nodes in groups (key) whose nodes have different labels."""
    named = cut(large.join(labels.hint("merge"), "node", "left").select("node", "key", F.coalesce("label", "node").alias("label")))
    keys = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    return cut(named.join(keys, "key", "left_semi").select("node", "label").distinct())


def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """a, b of pairs whose nodes have different labels (their own, where they have none)."""
    for x in "ab":
        pairs = pairs.join(labels.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}")).hint("merge"), x, "left")
    return cut(pairs.where("coalesce(label_a, a) <> coalesce(label_b, b)").select("a", "b"))
