"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits; two link if they differ in at most two. Equal fingerprints are one node from the start, so
copies are never compared. Of two linked fingerprints, one of the two halves (31 bits each, the last two bits are left
to the comparison) differs in one bit at most. In a half, the anchors are the words of the perfect Hamming code of
length 31: every half has exactly one anchor within the covering radius 1 (its home), and a half that differs in one
bit from it lies within 1 + 1 = 2 of that anchor. So every fingerprint is replicated to all anchors within two of its
halves (1 or 16 of them), and at each anchor the fingerprints at home are compared with all that came.

An anchor compares its rows in slices of the sorted order, in numpy. At an anchor with more than `DIRECT` rows pairs
would grow with the square, so its rows are linked through midpoints instead, which is exact as well: two fingerprints
are within two bits iff some word lies within one bit of both, so each row goes to the 65 words around it and is linked
to the smallest fingerprint there. Links are between distinct fingerprints; components come from rounds that hang each
node on its least neighbour and merge what hangs together, over joins that adaptive execution may split.

Defined cases: null and empty texts (no words) have fingerprint zero and link as any other; texts of one or two words
are one shingle; repeated rows and null ids are kept, and ids in a component count as its name if not null; very long
texts are hashed in pieces; an empty table gives an empty result; other columns are left aside, or carried along
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from .common import cut, free_name, narrow, tidy, written

SEED = 42
SHINGLE = 3
#: Rows at one anchor above which links go through midpoints.
DIRECT = 256
#: Shingle hashes that are summed at once.
PIECE = 1 << 16
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def fingerprint(text: bytes | None, n: int = SHINGLE) -> int:
    """Bits set in more than half of the shingles' hashes; 0 without words."""
    import xxhash

    words = text.translate(_LOWER).split() if text else []
    # bytes.split() parts at ASCII white space: 0x20 and 0x09-0x0D, as the definition has it.
    if not words:
        return 0
    if len(words) <= n:
        shingles = [b" ".join(words)]
    else:
        shingles = [b" ".join(x) for x in zip(*(words[i:] for i in range(n)))]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for a in range(0, len(shingles), PIECE):
        hashes = np.array([digest(s, SEED) for s in shingles[a : a + PIECE]], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (counts * 2 > len(shingles)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, carry: str | None = None) -> DataFrame:
    """doc_id, fp (long) of each document; with carry all columns of docs, and the fingerprint under that name."""
    source = docs if carry else docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    names = source.columns
    at, fp = names.index("text"), carry or "fp"
    out_names = names if carry else ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([fingerprint(t.as_py()) for t in batch.column(at).cast(pa.binary())], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)) for c in out_names), found], [*out_names, fp])

    return source.mapInArrow(run, StructType([f for f in source.schema.fields if f.name in out_names]).add(fp, LongType()))


def syndrome(half: np.ndarray) -> np.ndarray:
    """Of the Hamming code whose check of position i (1 to 31) is i in binary: 0 for a code word, else the position to flip."""
    out = np.zeros(len(half), np.int64)
    for i in range(31):
        out ^= ((half >> i) & 1) * (i + 1)
    return out


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, home) for all anchors within two of each half; home marks the one within one."""
    s = syndrome(half)
    rows, points, homes = [], [], []
    every = np.arange(len(half))
    near = np.where(s > 0, half ^ (np.int64(1) << np.maximum(s - 1, 0)), half)
    rows.append(every)
    points.append(near)
    homes.append(np.ones(len(half), bool))
    off = every[s > 0]  # around a code word there is no other one within two
    for i in range(1, 32):
        j = s[off] ^ i  # positions i and j have the syndrome together
        ok = (j > i) & (j < 32)  # j = 0 would be the home again
        rows.append(off[ok])
        points.append(half[off[ok]] ^ (np.int64(1) << (i - 1)) ^ (np.int64(1) << (j[ok] - 1)))
        homes.append(np.zeros(int(ok.sum()), bool))
    return np.concatenate(rows), np.concatenate(points), np.concatenate(homes)


def replicate(fps: DataFrame) -> DataFrame:
    """fp at each of its anchors: anchor (with the half's number), fp, home."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 14):
                fp = batch.column(0).slice(at, 1 << 14).to_numpy(zero_copy_only=False)
                for number, shift in ((0, 0), (1, 31)):
                    row, point, home = anchors((fp >> shift) & 0x7FFFFFFF)
                    yield pa.RecordBatch.from_arrays([pa.array(point * 2 + number), pa.array(fp[row]), pa.array(home)], ["anchor", "fp", "home"])

    return fps.select("fp").mapInArrow(run, "anchor long, fp long, home boolean")


def compare(at_anchors: DataFrame, threshold: int) -> DataFrame:
    """Links (a < b) of the rows at each anchor; b null marks a row of an anchor with more than DIRECT rows, for midpoints.

    Rows come sorted by anchor; a run of one anchor is held only up to DIRECT rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        large: int | None = None  # the anchor whose rows are passed on as they come

        def links(anchor, fp, home):
            nonlocal large
            if not len(anchor):
                return
            starts = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
            counts = np.diff(np.append(starts, len(anchor)))
            size = np.repeat(counts, counts)
            big = (size > DIRECT) | (anchor == large if large is not None else False)
            if big.any():
                yield fp[big], None
            ends = np.repeat(starts + counts, counts)
            i = np.flatnonzero((size > 1) & ~big)
            for k in range(1, DIRECT):
                i = i[i + k < ends[i]]
                if not len(i):
                    break
                x, y = fp[i], fp[i + k]
                ok = (home[i] | home[i + k]) & (np.bitwise_count((x ^ y).view(np.uint64)) <= threshold) & (x != y)
                if ok.any():
                    yield np.minimum(x, y)[ok], np.maximum(x, y)[ok]

        def out(found):
            for a, b in found:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b) if b is not None else pa.nulls(len(a), pa.int64())], ["a", "b"])

        for batch in batches:
            part = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(3)]
            anchor, fp, home = (np.concatenate([x, y]) for x, y in zip(rest, part))
            if not len(anchor):
                continue
            last = int(np.searchsorted(anchor, anchor[-1]))  # its run may go on in the next batch
            yield from out(links(anchor[:last], fp[:last], home[:last]))
            if large is not None and large != anchor[-1]:
                large = None
            if len(anchor) - last > DIRECT or large == anchor[-1]:
                large = int(anchor[-1])
                yield from out(iter([(fp[last:], None)]))
                rest = tuple(x[:0] for x in (anchor, fp, home))
            else:
                rest = anchor[last:], fp[last:], home[last:]
        yield from out(links(*rest))

    return at_anchors.mapInArrow(run, "a long, b long")


def through_midpoints(fps: DataFrame) -> DataFrame:
    """Links of fingerprints within two bits, each to the smallest at a shared word within one bit of both."""
    around = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(v - (1 << 64) if v >= 1 << 63 else v)) for v in (1 << i for i in range(64))])
    at = fps.select("fp", F.explode(around).alias("word"))
    # Both sides come from one cut, so that the join deals both itself and adaptive execution can split a hot word.
    least = cut(at.groupBy("word").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("word", "a"))
    return at.join(least, "word").where("a <> fp").select(F.least("a", "fp").alias("a"), F.greatest("a", "fp").alias("b")).distinct()


def linked(fps: DataFrame, threshold: int = 2) -> DataFrame:
    """Distinct links (a < b) between distinct fingerprints, enough of them to hold every component together."""
    if threshold != 2:
        raise ValueError("anchors and midpoints are laid out for two bits")
    distinct = fps.select("fp").distinct()
    rows = replicate(distinct).repartition("anchor").sortWithinPartitions("anchor")
    found = cut(compare(rows, threshold).distinct())
    direct = found.where("b is not null")
    hot = found.where("b is null").select(F.col("a").alias("fp"))
    if hot.isEmpty():
        return direct
    return direct.unionByName(through_midpoints(cut(hot.distinct()))).distinct()


def components(links: DataFrame, max_rounds: int = 60, known: DataFrame | None = None) -> DataFrame:
    """node, label (the smallest node of its component) for all nodes of links (a, b); what the rounds shuffled is let go.

    known: such labels of other links; the result holds for these links and those together, and for the nodes of both.
    """
    labels = settled(links, max_rounds, known)
    tidy(links.sparkSession)
    return labels


def settled(links: DataFrame, max_rounds: int, known: DataFrame | None = None) -> DataFrame:
    """The labels of `components`.

    Each round hangs every node on the least of its neighbours, follows these to the end, and puts the ends in the place of
    the nodes. Links inside what has come together go then, and so do repeated ones, so a dense group costs its links once
    and not in each round; two rounds leave half of the nodes at most. Sums are pre-aggregated, and both sides of each join
    are read from files, so a node with very many links can be split, and sizes are those of the files. The tables of the rounds have as many parts as their rows need,
    whatever the session's number of shuffle partitions.
    """
    rest = links.select("a", "b")
    rows = 2 * rest.count()
    steps = []
    if known is not None:
        own = rest.select(F.explode(F.array("a", "b")).alias("node")).select("node", F.col("node").alias("label"))
        of_all = rows + known.count()
        steps.append((narrow(known.select("node", "label").unionByName(own).groupBy("node").agg(F.min("label").alias("label")), "labels", of_all), of_all))
        rest, rows = replaced(rest, steps[-1][0], rows)
    for _ in range(max_rounds):
        if not rows and steps:
            labels, _ = steps.pop()
            while steps:
                labels = followed(*steps.pop(), labels)
            return labels
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = narrow(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), "labels", rows)
        steps.append((ends(least, rows), rows))
        rest, rows = replaced(rest, steps[-1][0], rows)
    raise RuntimeError("components did not settle")


def followed(labels: DataFrame, rows: int, more: DataFrame) -> DataFrame:
    """labels, each in turn with its label in more, if it has one."""
    far = more.select(F.col("node").alias("via"), F.col("label").alias("far"))
    return narrow(labels.select("node", F.col("label").alias("via")).join(far, "via", "left").select("node", F.coalesce("far", "via").alias("label")), "labels", rows)


def ends(labels: DataFrame, rows: int) -> DataFrame:
    """labels (a smaller node or itself for each node) followed to the nodes that are their own; each pass doubles the way."""
    while True:
        far = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        after = narrow(labels.select("node", F.col("label").alias("via")).join(far, "via").select("node", F.col("far").alias("label"), (F.col("far") < F.col("via")).alias("moved")), "labels", rows)
        if after.where("moved").isEmpty():
            return labels
        labels = after.select("node", "label")


def replaced(links: DataFrame, labels: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """Distinct links (a < b) of the labels in place of the nodes, and twice their number."""
    for x in "ab":
        links = links.join(labels.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}")), x)
    between = links.where("label_a <> label_b").select(F.least("label_a", "label_b").alias("a"), F.greatest("label_a", "label_b").alias("b"))
    rest = narrow(between.distinct(), "links", rows)
    return rest, 2 * rest.count()


def classes(nodes: DataFrame, threshold: int = 2) -> DataFrame:
    """nodes (distinct fp, further columns) with label, the smallest fingerprint of their component."""
    labels = components(cut(linked(nodes, threshold)))
    return cut(nodes.join(labels, nodes["fp"] == labels["node"], "left").select(*nodes.columns, F.coalesce("label", "fp").alias("label")))


def near_duplicates(docs: DataFrame, threshold: int = 2) -> DataFrame:
    """doc_id, fp (long), component_id (smallest doc_id reachable), one row per document."""
    fps = cut(fingerprints(docs))
    grouped = classes(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), threshold)
    names = cut(grouped.groupBy("label").agg(F.min("first_id").alias("component_id")))
    of_fp = cut(grouped.join(names, "label").select(F.col("fp").alias("its_fp"), "component_id"))
    return fps.join(of_fp, F.col("fp") == F.col("its_fp")).select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, threshold: int = 2) -> DataFrame:
    """One row of each component, with the columns of docs: the one of the smallest doc_id (nulls last, then the first row as read)."""
    fp, row = free_name(docs, "fp"), free_name(docs, "row")
    kept = written(fingerprints(docs, fp).withColumn(row, F.monotonically_increasing_id()), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col(row).alias("row"))).alias("first")
    grouped = classes(cut(kept.groupBy(F.col(fp).alias("fp")).agg(first)), threshold)
    chosen = grouped.groupBy("label").agg(F.min("first").alias("first")).select(F.col("first.row").alias(row))
    return kept.join(chosen, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
