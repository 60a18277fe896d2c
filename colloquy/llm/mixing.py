"""Mixing sources to target weights by capped water-filling.

Every source asks for its weight's share of all words. Sources that would have to be repeated more than `max_epochs`
times are clamped there, and what they leave is shared among the rest by weight, until no source is above its cap.
Within a source, `target // source_size` whole repetitions are taken, and the fraction that is left is taken from the
documents in a seeded pseudo-random order; the document on which the fraction ends gives its first words only. So each
source's words meet its target to one word, and no document gives more than `max_epochs` times its size.

Order within a source is that of md5(seed, doc_id, md5(text)), so rows without an id, or with one id and several texts,
spread over all slices as others do. What a source's fraction needs is only where in that order it ends (`edges_of`): sums per slice of the hash name one slice, sums in that slice name a part
of it, and there the documents are put in order, equal ones as one group. So no window runs over a source, no document
is shuffled, and every row finds its share by comparing its place with its source's edge. Rows that are equal in id
and text where a fraction ends are numbered in salted groups. Sources are ranked by a range-partitioned sort, and the water level
needs only sums: no list of sources or documents reaches the driver.

Defined cases: null text has size 0, null source is a source of its own (last in rank), null doc_id sorts as the empty
string, repeated rows are documents of their own (equal ones in a stable but unspecified order among themselves),
an empty table gives an empty result. All columns of the input may be carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free_name, written

#: Hash slices per source, and leading hexadecimal digits of the key that part a slice again.
SLICES = 256
DIGITS = 3
#: Up to so many sources their targets (a short row each) are broadcast; beyond, they are joined as any table.
BROADCAST_SOURCES = 100_000
#: Groups among which equal rows are numbered.
SALTS = 256


def size_of(text: Column) -> Column:
    """Words of the text, split at ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ranked(sources: DataFrame, order: list[Column]) -> DataFrame:
    """Adds rank (0, 1, ...) in a total order, by range partitions and their offsets."""
    parts = cut(sources.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("within")))
    counts = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return parts.join(F.broadcast(before), "part").withColumn("rank", F.col("before") + F.col("within")).drop("part", "within", "before")


def water_level(sources: DataFrame, total: float, max_epochs: float) -> DataFrame:
    """Adds target to (source_size, weight): the capped, proportional share of total."""
    capped = F.lit(False)
    cap = F.col("source_size") * F.lit(float(max_epochs))
    n_capped = -1
    while True:
        free, full, n = sources.agg(F.sum(F.when(~capped, F.col("weight"))), F.sum(F.when(capped, cap)), F.sum(F.when(capped, 1).otherwise(0))).first()
        level = max(0.0, total - (full or 0.0)) / free if free else 0.0
        if not free or n == n_capped:
            return sources.withColumn("target", F.when(capped, cap).otherwise(F.col("weight") * F.lit(level)).cast("double"))
        # The level only rises as sources are capped, so what is capped stays so and one number is the whole state.
        n_capped, capped = n, cap < F.col("weight") * F.lit(level)


def keyed_of(docs: DataFrame, seed: str, own: Column | None = None) -> DataFrame:
    """doc_id, source, size and the place in the source's order (slice, key), with own if given."""
    text_hash = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    key = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text_hash).cast("binary"))
    keyed = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), key.alias("key"), *([own.alias("own")] if own is not None else []))
    return keyed.withColumn("slice", (F.conv(F.substring("key", 1, 8), 16, 10).cast("long") % SLICES).cast("int"))


def with_source(rows: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    """rows and what sources (its_source, ...) say of their source."""
    few = F.broadcast(sources) if n_sources <= BROADCAST_SOURCES else sources
    return rows.join(few, rows["source"].eqNullSafe(sources["its_source"]))


def running(rows: DataFrame, amount: str, before: str, *order: str) -> DataFrame:
    """Adds the sum of amount over what comes earlier in its source."""
    earlier = Window.partitionBy("source").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(before, F.coalesce(F.sum(amount).over(earlier), F.lit(0)))


def edges_of(keyed: DataFrame, slices: DataFrame, targets: DataFrame, n_sources: int) -> DataFrame:
    """its_source, edge (a place), n (equal rows there) and left (words that they give): where each source's fraction ends."""
    at = "rest >= before and rest < before + words"
    slice_of = with_source(running(slices, "words", "before", "slice"), targets.select("its_source", "rest"), n_sources).where(at)
    edge_slices = cut(slice_of.select("its_source", F.col("slice").alias("edge_slice"), "before", "rest"))
    inside = with_source(keyed, edge_slices, n_sources).where("slice = edge_slice").drop("its_source")
    groups = cut(inside.groupBy("source", "slice", "key", "size", "before", "rest").agg(F.count("*").alias("n")).withColumn("part", F.substring("key", 1, DIGITS)).withColumn("words", F.col("n") * F.col("size")))
    parts = groups.groupBy("source", "part", "before", "rest").agg(F.sum("words").alias("words")).withColumnRenamed("before", "start")
    edge_parts = running(parts, "words", "earlier", "part").withColumn("before", F.col("start") + F.col("earlier")).where(at).select(F.col("source").alias("its_source"), F.col("part").alias("edge_part"), F.col("before").alias("part_before"))
    close = with_source(groups.drop("before"), edge_parts, n_sources).where("part = edge_part").drop("its_source")
    last = running(close, "words", "earlier", "key").withColumn("before", F.col("part_before") + F.col("earlier")).where(at)
    return last.select(F.col("source").alias("its_source"), place().alias("edge"), "n", (F.col("rest") - F.col("before")).alias("left"))


def place() -> Column:
    return F.struct("slice", "key")


def plan_of(keyed: DataFrame, weights: tuple[float, ...], max_epochs: float) -> tuple[DataFrame, int]:
    """Per source: its_source, source_size, target, whole, edge, n and left; and the number of sources."""
    slices = cut(keyed.groupBy("source", "slice").agg(F.sum("size").alias("words")))
    sources = cut(slices.groupBy("source").agg(F.sum("words").alias("source_size")))
    total, n_sources = sources.agg(F.sum("source_size"), F.count("*")).first()
    rank = ranked(sources, [F.col("source").isNull().cast("int"), F.col("source")])
    weighted = cut(rank.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))))
    targets = water_level(weighted, float(total or 0), max_epochs)
    targets = cut(targets.select(F.col("source").alias("its_source"), "source_size", F.round("target", 6).alias("target")).withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")).withColumn("rest", F.when(F.col("source_size") > 0, F.round(F.col("target") - F.col("whole") * F.col("source_size"))).otherwise(0).cast("long")))
    edges = edges_of(keyed, slices, targets, n_sources).withColumnRenamed("its_source", "edge_source")
    return cut(targets.join(edges, targets["its_source"].eqNullSafe(edges["edge_source"]), "left").drop("edge_source")), n_sources


def placed(keyed: DataFrame, plan: DataFrame, n_sources: int) -> DataFrame:
    """Adds source_size, target, whole (repetitions) and part (words of one more) to each row."""
    met = with_source(keyed, plan, n_sources).drop("its_source")
    at_edge = F.coalesce(place() == F.col("edge"), F.lit(False))
    # Without an edge the fraction is the whole source.
    part = F.when(F.col("edge").isNull() | (place() < F.col("edge")), F.col("size")).when(at_edge, F.col("left")).otherwise(0)
    if plan.where("n > 1").isEmpty():
        return met.withColumn("part", part.cast("long"))
    several = at_edge & (F.col("n") > 1)
    equal = written(met.where(several).withColumn("row", F.monotonically_increasing_id()).withColumn("salt", F.pmod("row", F.lit(SALTS))), "mix-equal")
    counts = equal.groupBy("source", "salt").agg(F.count("*").alias("many"))
    offsets = cut(running(counts, "many", "offset", "salt").select(F.col("source").alias("its_source"), F.col("salt").alias("its_salt"), "offset"))
    numbered = equal.join(offsets, equal["source"].eqNullSafe(offsets["its_source"]) & (F.col("salt") == F.col("its_salt"))).withColumn("nth", F.col("offset") + F.row_number().over(Window.partitionBy("source", "salt").orderBy("row")) - 1)
    shared = numbered.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("nth") * F.col("size"))).cast("long"))
    others = met.where(~several).withColumn("part", part.cast("long"))
    return others.unionByName(shared.select(*others.columns))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), max_epochs: float = 3.0, seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target, taken, whole (repetitions) and part (words of one more).

    Sources in code point order, null last, have the weights in turn.
    """
    keyed = written(keyed_of(docs, seed), "mix-sizes")
    out = placed(keyed, *plan_of(keyed, weights, max_epochs))
    return out.select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("part")).alias("taken"), "whole", "part")


def mixture(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), max_epochs: float = 3.0, seed: str = "mix") -> DataFrame:
    """The mix itself: a row per repetition of a document, numbered from 0 in copy, with the columns of docs and n_words.

    The plan is made from numbers alone; texts are read once more and never shuffled. The one document of a source on
    which its fraction ends gives, in its last repetition, only its first words, as far as the target goes (n_chars is
    that text's length then). New columns are named copy and n_words, or with underscores added where docs has such names.
    """
    copy, n_words = (free_name(docs, c) for c in ("copy", "n_words"))
    plan, n_sources = plan_of(written(keyed_of(docs, seed), "mix-sizes"), weights, max_epochs)
    own = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    taken = placed(keyed_of(docs, seed, own), plan, n_sources)
    rows = taken.where((F.col("whole") > 0) | (F.col("part") > 0)).withColumn("copies", F.col("whole") + (F.col("part") > 0).cast("long"))
    each = rows.select("own", "whole", "part", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("nth"))
    fields = {c: F.col(f"own.c{i}") for i, c in enumerate(docs.columns)}
    partial = (F.col("nth") == F.col("whole")) & (F.col("part") < F.col("size"))
    words = F.regexp_extract_all(fields["text"], F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    first_words = F.array_join(F.slice(words, F.lit(1), F.col("part").cast("int")), "")
    changed = {"text": first_words, "n_chars": F.length(first_words).cast(dict(docs.dtypes).get("n_chars", "long"))}
    columns = [(F.when(partial, changed[c]).otherwise(x) if c in changed else x).alias(c) for c, x in fields.items()]
    return each.select(*columns, F.col("nth").alias(copy), F.when(F.col("nth") == F.col("whole"), F.col("part")).otherwise(F.col("size")).alias(n_words))


#: The order within a source spelt for DuckDB, with the same slices: slice number first, then the key.
ORACLE_SQL = """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
                  md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap FROM s),
-- the level is that at which the sum of least(cap, level * weight) is the total: sources are capped in order of cap / weight
o AS (SELECT *, coalesce(sum(cap) OVER w, 0) AS capped, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS free, sum(source_size) OVER () AS total
      FROM r WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT coalesce((SELECT (total - capped) / free FROM o WHERE (total - capped) / free <= cap / weight ORDER BY cap / weight LIMIT 1), 1e300) AS level),
t AS (SELECT source, source_size, round(CASE WHEN cap < weight * level THEN cap ELSE weight * level END, 6)::DOUBLE AS target FROM r, l),
u AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
v AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(round(target - whole * source_size) AS BIGINT) ELSE 0 END AS rest FROM u),
b AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY ('0x' || substr(k, 1, 8))::BIGINT % 256, k, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT b.doc_id, b.size, v.source_size, v.target, CAST(v.whole * b.size + greatest(0, least(b.size, v.rest - b.before)) AS BIGINT) AS taken,
       v.whole, CAST(greatest(0, least(b.size, v.rest - b.before)) AS BIGINT) AS part
FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.source
"""
