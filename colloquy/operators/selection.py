"""Exact order statistics of large groups by repeated range counts: no task orders a group's values.

The value at a place of a group's order lies in a bracket, all of the group to begin with. Each round asks Spark's
mergeable sketch for two values around the place inside the bracket, counts exactly how many values are below, between
and above them, and goes on with the part that holds the place: the middle one, a hundredth of the bracket or so,
or, where the sketch was off, the part beside it. When a bracket holds one value, or at most SMALL values, the place is
looked up in the order of its distinct values. Rounds grow with the logarithm of the largest group; each is two
aggregations with partial sums in the tasks, and one row a group and place passes from round to round.

Groups of at most SMALL rows go straight to that look-up. Null values don't count; a group without values has no row;
equal values are as many places; NaN is the largest value, as Spark orders it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import fresh_folder

#: Rows whose distinct values one task may order.
SMALL = 100_000
#: Half of the share of a bracket that the next one is to hold, and the sketch's accuracy (one in so many rows).
MARGIN = 0.005
ACCURACY = 2_000
#: A broken comparison would go on for ever; two groups of 100 need two rounds, of 10**18 need nine.
MOST_ROUNDS = 64


def _stored(df: DataFrame, name: str) -> DataFrame:
    """A table of a row per group and place, written so that no round works out the ones before again."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _looked_up(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, place, value. rows: key, value; wanted: key, place, below, low, high, whose bracket holds few rows or one value."""
    met = rows.join(wanted, "key").where("value >= low and value <= high")
    counts = met.groupBy("key", "place", "below", "value").agg(F.count("*").alias("equal"))
    upto = F.col("below") + F.sum("equal").over(Window.partitionBy("key", "place").orderBy("value"))
    return counts.withColumn("upto", upto).where("upto > place and upto - equal <= place").select("key", "place", "value")


def at_places(rows: DataFrame, places: DataFrame, small: int = SMALL) -> DataFrame:
    """key, place, value: the value at each place (from 0) of its key's ascending order. rows: key, value; places: key, place."""
    rows = rows.where("value is not null").select("key", "value")
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    asked = places.select("key", F.col("place").cast("long").alias("place")).distinct()
    brackets = _stored(asked.join(sizes, "key").where("place >= 0 and place < n").select("key", "place", F.lit(0).cast("long").alias("below"), "n", "low", "high"), "brackets")
    few = (F.col("n") <= small) | (F.col("low") == F.col("high"))
    out = _looked_up(rows, brackets.where(few).drop("n"))
    wide = brackets.where(~few)
    for _ in range(MOST_ROUNDS):
        if wide.isEmpty():
            return out
        wide = _stored(_narrowed(rows, wide), "brackets")
        out = out.unionByName(_looked_up(rows, wide.where(few).drop("n")))
        wide = wide.where(~few)
    raise RuntimeError(f"brackets didn't narrow in {MOST_ROUNDS} rounds")


def _narrowed(rows: DataFrame, wide: DataFrame) -> DataFrame:
    inside = rows.join(wide, "key").where("value >= low and value <= high")
    # The sketch's points are the same for all groups: the finest of them that lie around the place are taken.
    points = [i * MARGIN for i in range(round(1 / MARGIN) + 1)]
    sketch = inside.groupBy("key", "place", "below", "n", "low", "high").agg(F.percentile_approx("value", points, ACCURACY).alias("points"))
    at = (F.col("place") - F.col("below")) / F.greatest(F.col("n") - 1, F.lit(1))
    first = F.greatest(F.floor(at / MARGIN).cast("int") - 1, F.lit(0))
    last = F.least(F.ceil(at / MARGIN).cast("int") + 1, F.lit(len(points) - 1))
    cut = sketch.select("key", "place", "below", "n", "low", "high", F.get("points", first).alias("a"), F.get("points", last).alias("b"))
    part = F.when(F.col("value") < F.col("a"), 0).when(F.col("value") <= F.col("b"), 1).otherwise(2)
    counted = rows.join(cut, "key").where("value >= low and value <= high").groupBy("key", "place", "below", part.alias("part")).agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    # Three rows a group and place at most.
    before = F.coalesce(F.sum("n").over(Window.partitionBy("key", "place").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counted.withColumn("below", F.col("below") + before)
    return placed.where((F.col("below") <= F.col("place")) & (F.col("place") < F.col("below") + F.col("n"))).select("key", "place", "below", "n", "low", "high")


def percentiles(df: DataFrame, key: str, value: str, ps: tuple[float, ...] = (50.0, 95.0), small: int = SMALL) -> DataFrame:
    """Nearest-rank percentiles per key: the value at place round(p/100 * (n - 1)), halves to even."""
    rows = df.where(F.col(value).isNotNull()).select(F.col(key).alias("key"), F.col(value).alias("value"))
    # A null key is a group too; joins need a name for it.
    named = rows.select(F.col("key").alias("own"), F.coalesce(F.concat(F.lit("="), F.col("key").cast("string")), F.lit("")).alias("key"), "value")
    sizes = named.groupBy("key").agg(F.count("*").alias("n"), F.first("own").alias("own"))
    place = lambda p: F.bround(F.lit(p / 100) * (F.col("n") - 1), 0).cast("long")
    asked = sizes.select("key", "own", F.inline(F.array(*[F.struct(F.lit(p).alias("p"), place(p).alias("place")) for p in ps])))
    found = asked.join(at_places(named, asked, small), ["key", "place"])
    return found.groupBy(F.col("key").alias("its_key"), F.col("own").alias(key)).agg(*[F.max(F.when(F.col("p") == p, F.col("value"))).alias(f"p{int(p)}") for p in ps]).select(key, *[f"p{int(p)}" for p in ps])


def newest(rows: DataFrame, ts: str, tie: str, cap: int, small: int = SMALL) -> DataFrame:
    """The cap newest rows by ts, then tie. A large cap is a threshold found by counts, not a list that one task gathers.

    Rows without ts come last, and only those of the threshold's own time are ordered by tie.
    """
    if cap <= small:
        return rows.orderBy(F.desc(ts), F.desc(tie)).limit(cap)
    n = rows.where(F.col(ts).isNotNull()).count()
    if n <= cap:
        return rows.where(F.col(ts).isNotNull()).unionByName(rows.where(F.col(ts).isNull()).orderBy(F.desc(tie)).limit(cap - n))
    keyed = rows.select(F.lit(0).alias("key"), F.col(ts).alias("value"))
    place = rows.sparkSession.createDataFrame([(0, n - cap)], "key int, place long")
    threshold = at_places(keyed, place, small).first().value
    later = rows.where(F.col(ts) > F.lit(threshold))
    return later.unionByName(rows.where(F.col(ts) == F.lit(threshold)).orderBy(F.desc(tie)).limit(cap - later.count()))
