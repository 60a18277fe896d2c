"""Beacons: validation, the lane by target matrix, time series, and the roll-up of scenarios from their legs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Lanes, layers and statuses that a beacon may have, and keys that its details may not have.
LANES = ["browser", "desktop", "cli", "mcp"]
LAYERS = ["L0", "L1", "L2", "L3a", "L3b", "L3c", "L3d", "L3e", "L3f", "L3g", "L3h", "L4a", "L4b", "L4c"]
STATUSES = ["pass", "fail", "skip", "degraded", "infra_error"]
FORBIDDEN_KEYS = ["content_text", "content_json", "body", "request_body", "response_body", "api_key", "apikey", "token", "access_token", "refresh_token", "cookie", "cookies", "authorization", "auth", "user_email", "user_id", "userid", "username", "email", "password", "secret", "pii"]
MAX_SKEW, MAX_META_BYTES, MAX_TARGET = 300.0, 4096, 64
CRITICAL_TIERS = ["S0", "D0"]
#: Colours by severity, the least severe first.
COLOURS = ["green", "grey", "yellow", "red"]


def rejection(now: Column, layers: list[str] = LAYERS) -> Column:
    """The first reason to reject a beacon (lane, layer, status, target, case_id, ts, meta_json), or null."""
    lower = lambda c: F.lower(F.coalesce(c, F.lit("")))
    # Escaped characters go first, so that a key is a plain run up to its quote, however long the details are.
    plain = F.regexp_replace(lower(F.col("meta_json")), r"\\.", "")
    keys = F.regexp_extract_all(plain, F.lit(r'"([^"]*+)"\s*:'), F.lit(1))
    unknown = lambda c, known: F.coalesce(~F.col(c).isin(*known), F.lit(True))
    return (
        F.when(unknown("lane", LANES), "invalid_lane").when(unknown("layer", layers), "invalid_layer").when(unknown("status", STATUSES), "invalid_status")
        .when(F.coalesce(~F.col("target").rlike(r"^[a-z0-9_\-]+$") | (F.length("target") > MAX_TARGET), F.lit(True)), "invalid_target")
        .when(F.col("case_id").isNotNull() & ~F.col("case_id").rlike(r"^[A-Z]\d{2}$"), "invalid_case_id")
        .when(F.coalesce(F.abs(F.col("ts") - now) > MAX_SKEW, F.lit(True)), "ts_skew")
        .when(F.arrays_overlap(keys, F.array(*[F.lit(k) for k in FORBIDDEN_KEYS])), "pii_detected")
        .when(F.octet_length(F.coalesce("meta_json", F.lit(""))) > MAX_META_BYTES, "meta_too_large")
    )


def validated(beacons: DataFrame, now: float, layers: list[str] = LAYERS) -> DataFrame:
    return beacons.withColumn("rejected_for", rejection(F.lit(now), layers))


def matrix(beacons: DataFrame, now: float, window_hours: float = 24.0, tiers: DataFrame | None = None) -> DataFrame:
    """Per lane and target: counts by status, distinct passing layers, newest pass, pass rate and colour.

    tiers (target, tier, plane_required) is a small table; other targets have no tier and require one plane.
    """
    rows = beacons.where(F.col("ts") >= now - window_hours * 3600)
    per = rows.groupBy("lane", "target").agg(*[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATUSES], F.count_distinct(F.when(F.col("status") == "pass", F.col("layer"))).alias("planes"), F.max(F.when(F.col("status") == "pass", F.col("ts"))).alias("last_pass"))
    if tiers is not None:
        per = per.join(F.broadcast(tiers), "target", "left")
    else:
        per = per.withColumns({"tier": F.lit(None).cast("string"), "plane_required": F.lit(None).cast("int")})
    total = sum((F.col(f"n_{s}") for s in STATUSES[1:]), F.col(f"n_{STATUSES[0]}"))
    rate = F.col("n_pass") / total
    troubled = (F.col("n_fail") > 0) | (F.col("n_degraded") > 0)
    critical = F.coalesce(F.col("tier").isin(*CRITICAL_TIERS), F.lit(False))
    stale = F.coalesce(F.col("last_pass") < now - 6 * 3600, F.lit(True))
    colour = (
        F.when(critical & (F.col("planes") < F.coalesce("plane_required", F.lit(1))), "red").when(critical & (F.col("n_fail") >= 3), "red").when(stale & troubled, "red")
        .when(critical & (F.col("n_fail") >= 1), "yellow").when((rate < 0.80) & troubled, "yellow").when(F.col("n_degraded") >= 1, "yellow").when(rate >= 0.90, "green").otherwise("grey")
    )
    return per.select("lane", "target", *[f"n_{s}" for s in STATUSES], "planes", "last_pass", F.round(rate, 4).alias("pass_rate"), colour.alias("colour"))


def lane_severity(of_targets: DataFrame) -> DataFrame:
    """Per lane the most severe colour of its targets."""
    rank = F.array_position(F.array(*[F.lit(c) for c in COLOURS]), F.col("colour"))
    return of_targets.groupBy("lane").agg(F.max_by("colour", rank).alias("colour"), F.count("*").alias("targets"))


def latest_by_case(beacons: DataFrame) -> DataFrame:
    """Per lane, target and case the newest status."""
    newest = F.struct("ts", "id")
    return beacons.where("case_id is not null").groupBy("lane", "target", "case_id").agg(F.max_by("status", newest).alias("status"), F.max("ts").alias("ts"))


def status_series(beacons: DataFrame, bucket_seconds: int = 3600) -> DataFrame:
    start = (F.floor(F.col("ts") / bucket_seconds) * bucket_seconds).cast("long").alias("bucket")
    return beacons.groupBy(start).agg(*[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATUSES])


def signals(beacons: DataFrame, keys: list[str]) -> DataFrame:
    """Newest pass and newest failure per key."""
    newest = lambda s: F.max(F.when(F.col("status") == s, F.col("ts"))).alias(f"last_{s}")
    return beacons.groupBy(*keys).agg(newest("pass"), newest("fail"))


def leg_health(now: float, window_hours: float) -> Column:
    """unknown, green, yellow (failed after its last pass) or red (failures only) from last_pass and last_fail."""
    cutoff = now - window_hours * 3600
    passed, failed = F.coalesce(F.col("last_pass") >= cutoff, F.lit(False)), F.coalesce(F.col("last_fail") >= cutoff, F.lit(False))
    return F.when(~passed & ~failed, "unknown").when(passed & ~failed, "green").when(~passed, "red").when(F.col("last_fail") > F.col("last_pass"), "yellow").otherwise("green")


def scenario_status(legs: DataFrame, beacons: DataFrame, now: float, window_hours: float = 24.0) -> DataFrame:
    """Per scenario the legs that are active and degraded, and its status.

    legs (scenario, leg, target, lane, layer, wanted) is a small registry; its lane and layer may be null, which means
    any: the most specific signals that exist count (lane and layer, then lane, then layer, then the target alone).
    """
    steps = [["target", "lane", "layer"], ["target", "lane"], ["target", "layer"], ["target"]]
    registry = F.broadcast(legs)
    found = None
    for rank, keys in enumerate(steps):
        of_keys = signals(beacons, keys).withColumnsRenamed({k: f"its_{k}" for k in keys})
        fits = [F.col(k) == F.col(f"its_{k}") for k in keys] + [F.col(k).isNull() for k in ("lane", "layer") if k not in keys]
        condition = fits[0]
        for f in fits[1:]:
            condition = condition & f
        part = of_keys.join(registry, condition, "right").select("scenario", "leg", "wanted", F.lit(rank).alias("rank"), "last_pass", "last_fail")
        found = part if found is None else found.unionByName(part)
    known = F.col("last_pass").isNotNull() | F.col("last_fail").isNotNull()
    best = found.groupBy("scenario", "leg", "wanted").agg(F.min_by(F.struct("last_pass", "last_fail"), F.struct((~known).alias("no"), F.col("rank"))).alias("s")).select("scenario", "wanted", "s.*")
    of_legs = best.withColumn("health", leg_health(now, window_hours))
    rolled = of_legs.groupBy("scenario", "wanted").agg(F.count("*").alias("legs"), F.count_if(F.col("health") == "green").alias("active"), F.count_if(F.col("health") == "yellow").alias("degraded"), F.count_if(F.col("health") == "unknown").alias("unknown"))
    status = F.when(F.col("active") >= F.col("wanted"), "redundant").when(F.col("active") >= 2, "minimal").when(F.col("active") == 1, "impaired").otherwise("down")
    return rolled.select("scenario", "wanted", "legs", "active", "degraded", F.when(F.col("unknown") == F.col("legs"), "grey").otherwise(status).alias("status"))


def degraded(scenarios: DataFrame) -> DataFrame:
    return scenarios.where("active < wanted")
