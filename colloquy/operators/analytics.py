"""Time series, top lists, usage and health figures over captures, messages and sessions.

All functions take DataFrames of the logical tables and return DataFrames. `now` is a parameter, never the clock; where
it is None it is the newest time of the table. Every top list has a unique key as its last sort column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .selection import percentiles

BUCKETS = ("hour", "day", "week", "month")
DAY = 86_400
MAX_DAYS, MAX_ROWS = 365, 1_000


def clamp(n: int, low: int, high: int) -> int:
    return max(low, min(high, n))


def bucket_unit(by: str) -> str:
    """A known unit, else day."""
    return by if by in BUCKETS else "day"


def bucket(seconds: Column, by: str) -> Column:
    """The beginning of the bucket, as text; weeks begin on Monday."""
    return F.date_format(F.date_trunc(bucket_unit(by), F.timestamp_seconds(seconds)), "yyyy-MM-dd HH:mm:ss")


def newest(df: DataFrame, column: str) -> DataFrame:
    """One row, column `now`: the newest time of a table."""
    return df.agg(F.max(column).alias("now"))


def since(df: DataFrame, column: str, seconds: float, now: float | None = None) -> DataFrame:
    """Rows of the last seconds before now; the newest time of the table is one row, joined by broadcast."""
    if now is not None:
        return df.where(F.col(column) >= now - seconds)
    return df.join(F.broadcast(newest(df, column)), F.col(column) >= F.col("now") - seconds).drop("now")


def timeseries(captures: DataFrame, messages: DataFrame, by: str = "day", days: int = 30, provider: str | None = None, now: float | None = None) -> DataFrame:
    """Captures, messages and sessions per bucket. Both arms are aggregated before they are joined."""
    window = clamp(days, 1, MAX_DAYS) * DAY
    c, m = since(captures, "created_at", window, now), since(messages, "ts", window, now)
    if provider is not None:
        c, m = c.where(F.col("provider") == provider), m.where(F.col("provider") == provider)
    left = c.groupBy(bucket(F.col("created_at"), by).alias("bucket")).agg(F.count("*").alias("captures"))
    right = m.groupBy(bucket(F.col("ts"), by).alias("bucket")).agg(F.count("*").alias("messages"), F.countDistinct("session_id").alias("sessions"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return left.join(right, "bucket", "full_outer").select("bucket", zero("captures"), zero("messages"), zero("sessions"))


def top_models(captures: DataFrame, limit: int = 20, days: int = 30, now: float | None = None) -> DataFrame:
    """Groups on the raw columns, so that a null and a literal placeholder stay apart."""
    rows = since(captures, "created_at", clamp(days, 1, MAX_DAYS) * DAY, now).where(F.col("direction").isin("response", "conversation", "network_intercept"))
    counts = rows.groupBy("model_name", "provider").agg(F.count("*").alias("n"))
    named = counts.select(F.coalesce("model_name", F.lit("(unknown)")).alias("model"), F.coalesce("provider", F.lit("(unknown)")).alias("by_provider"), "n")
    return named.orderBy(F.desc("n"), "model", "by_provider").limit(clamp(limit, 1, MAX_ROWS))


def top_hosts(captures: DataFrame, limit: int = 20, days: int = 30, now: float | None = None) -> DataFrame:
    rows = since(captures, "created_at", clamp(days, 1, MAX_DAYS) * DAY, now).where("host <> ''")
    counts = rows.groupBy("host").agg(F.count("*").alias("n"), F.countDistinct("pair_id").alias("pairs"), F.max("created_at").alias("last_seen"))
    return counts.orderBy(F.desc("n"), "host").limit(clamp(limit, 1, MAX_ROWS))


def token_usage(messages: DataFrame, by: str = "day", days: int = 365, now: float | None = None) -> DataFrame:
    rows = since(messages, "ts", clamp(days, 1, MAX_DAYS) * DAY, now)
    return rows.groupBy(bucket(F.col("ts"), by).alias("bucket")).agg(F.coalesce(F.sum("token_estimate"), F.lit(0)).alias("tokens"), F.count_if(F.col("token_estimate").isNotNull()).alias("counted"), F.count("*").alias("messages"))


def stats(captures: DataFrame) -> DataFrame:
    """(dimension, name, n): the total and counts by provider, source and direction, in one pass by grouping sets."""
    dims = ["provider", "source_id", "direction"]
    exploded = captures.select(F.explode(F.array(F.struct(F.lit("total").alias("dimension"), F.lit(None).cast("string").alias("name")), *[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("name")) for d in dims])).alias("d"))
    return exploded.groupBy("d.dimension", "d.name").agg(F.count("*").alias("n"))


def source_activity(captures: DataFrame) -> DataFrame:
    return captures.groupBy("source_id").agg(F.count("*").alias("n"), F.max("created_at").alias("last_seen"))


def capture_windows(captures: DataFrame, now: float | None = None) -> DataFrame:
    """Per source and direction: captures of the last five minutes, hour and day, and in all."""
    at = F.lit(now) if now is not None else F.col("now")
    rows = captures if now is not None else captures.join(F.broadcast(newest(captures, "created_at")))
    within = lambda s: F.count_if(F.col("created_at") >= at - s)
    return rows.groupBy("source_id", "direction").agg(within(300).alias("n_5m"), within(3600).alias("n_1h"), within(86_400).alias("n_24h"), F.count("*").alias("n"))


def normalisation_ratio(captures: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions over pairs, null without pairs; it may exceed one."""
    a = captures.agg(F.countDistinct("pair_id").alias("pairs"))
    b = messages.agg(F.countDistinct("session_id").alias("sessions"))
    return a.join(F.broadcast(b)).select("pairs", "sessions", F.round(F.try_divide("sessions", "pairs"), 4).alias("ratio"))


def channel_status(captures: DataFrame, known: list[str], now: float) -> DataFrame:
    """active (5 min), idle (1 h), stale (24 h), inactive, never, per known channel; a channel `x*` holds all that begin so."""
    channels = captures.sparkSession.createDataFrame([(c,) for c in known], "channel string")
    last = source_activity(captures)
    fits = F.when(F.col("channel").endswith("*"), F.col("source_id").startswith(F.rtrim(F.col("channel"), F.lit("*")))).otherwise(F.col("source_id") == F.col("channel"))
    met = last.join(F.broadcast(channels), fits, "right").groupBy("channel").agg(F.max("last_seen").alias("last_seen"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    age = F.lit(now) - F.col("last_seen")
    status = F.when(F.col("last_seen").isNull(), "never").when(age <= 300, "active").when(age <= 3600, "idle").when(age <= 86_400, "stale").otherwise("inactive")
    return met.select("channel", "n", status.alias("status"))


def error_counts(errors: DataFrame, window_seconds: float, now: float | None = None) -> DataFrame:
    return since(errors, "ts", window_seconds, now).groupBy("stage", "level").agg(F.count("*").alias("n"))


def pinning(failures: DataFrame, captures: DataFrame, window_seconds: float, now: float, min_failures: int = 5, threshold: float = 0.20) -> DataFrame:
    """Hosts with TLS failures: failures, successes (distinct pairs through the proxy), rate, newest category of all times, suspicion.

    The rate has to exceed the threshold: five failures and twenty successes are not suspect.
    """
    cutoff = now - window_seconds
    failed = failures.groupBy("host").agg(F.count_if(F.col("created_at") >= cutoff).alias("failures"), F.max_by("error_category", F.struct("created_at", "id")).alias("last_category")).where("failures > 0")
    ok = captures.where((F.col("source_id") == "proxy-default") & (F.col("created_at") >= cutoff)).groupBy("host").agg(F.countDistinct("pair_id").alias("ok"))
    rate = F.col("failures") / (F.col("failures") + F.col("successes"))
    met = failed.join(ok, "host", "left").withColumn("successes", F.coalesce("ok", F.lit(0)))
    return met.select("host", "failures", "successes", F.round(rate, 4).alias("rate"), "last_category", ((F.col("failures") >= min_failures) & (rate > threshold)).alias("suspect"))


def nearest_rank(values: Column, p: float) -> Column:
    """The value at place round(p/100 * (n - 1)), halves to even, of an ordered array; null for an empty one."""
    at = F.bround(F.lit(p / 100) * (F.size(values) - 1), 0).cast("int")
    return F.when(F.size(values) > 0, F.get(values, at))


def exact_percentiles(df: DataFrame, key: str, value: str, ps: tuple[float, ...] = (50.0, 95.0)) -> DataFrame:
    """Nearest-rank percentiles per key, exact, however many values a key has."""
    return percentiles(df, key, value, ps)


def source_health(captures: DataFrame, errors: DataFrame | None, known: list[str]) -> DataFrame:
    """Per known source: captures, failures (status 400 and above), drop rate and latency percentiles."""
    sources = captures.sparkSession.createDataFrame([(s,) for s in known], "source_id string")
    counts = captures.groupBy("source_id").agg(F.count("*").alias("n"), F.count_if(F.col("status_code") >= 400).alias("failed"), F.max("created_at").alias("last_seen"))
    both = F.broadcast(sources).join(counts, "source_id", "left").join(exact_percentiles(captures, "source_id", "latency_ms"), "source_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    rate = F.try_divide(zero("failed").cast("double"), zero("n") + zero("failed"))
    return both.select("source_id", zero("n").alias("n"), zero("failed").alias("failed"), F.round(rate, 4).alias("drop_rate"), "last_seen", "p50", "p95")


def host_report(captures: DataFrame, limit: int = 20, samples: int = 3) -> DataFrame:
    """Per host: counts by direction, body lengths, distinct paths and the first of them. Paths are made distinct before they are gathered."""
    length = F.coalesce(F.length("body"), F.lit(0))
    counts = captures.groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("direction") == "request").alias("requests"), F.count_if(F.col("direction") == "response").alias("responses"), F.round(F.avg(length), 4).alias("avg_body"), F.max(length).alias("max_body"))
    ranked = captures.select("host", "path").distinct().withColumn("nth", F.row_number().over(Window.partitionBy("host").orderBy("path")))
    paths = ranked.groupBy("host").agg(F.count("*").alias("n_paths"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("nth") <= samples, F.col("path")))), ",").alias("paths"))
    return counts.orderBy(F.desc("n"), "host").limit(limit).join(paths, "host")


def first_of_pair(captures: DataFrame) -> DataFrame:
    """Per pair its first time, and the session of that very row."""
    return captures.groupBy("pair_id").agg(F.min("created_at").alias("first_at"), F.min_by("session_hint", F.struct("created_at", "id")).alias("session_hint"))


def export_summary(captures: DataFrame, messages: DataFrame) -> DataFrame:
    a = captures.agg(F.count("*").alias("captures"), F.countDistinct("pair_id").alias("pairs"), F.sum(F.length("body")).alias("body_chars"))
    return a.join(F.broadcast(messages.agg(F.count("*").alias("messages"), F.countDistinct("session_id").alias("sessions"))))


def provider_directions(captures: DataFrame) -> DataFrame:
    directions = ["request", "response", "conversation", "network_intercept"]
    return captures.groupBy(F.coalesce("provider", F.lit("(unknown)")).alias("provider")).agg(*[F.count_if(F.col("direction") == d).alias(d) for d in directions])


def singletons(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n = 1").select(key)


def missing_expected(captures: DataFrame, expected: dict[str, list[str]]) -> DataFrame:
    """Per provider: which of its expected sources were seen, and which were not."""
    want = captures.sparkSession.createDataFrame(list(expected.items()), "provider string, expected array<string>")
    seen = captures.groupBy("provider").agg(F.collect_set("source_id").alias("seen"))
    both = F.broadcast(want).join(seen, "provider", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
    text = lambda c: F.array_join(F.array_sort(c), ",")
    return both.select("provider", text(F.array_intersect("expected", "seen")).alias("detected"), text(F.array_except("expected", "seen")).alias("missing"))
