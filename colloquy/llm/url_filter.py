"""URL rules: a blocked Bloom filter of the listed keys lets possible hits through to an exact hash join.

A rule has a host, a path prefix and a verdict. It fits its host and every subdomain where the url's path starts with
the rule's path; of several that fit, the one with the longest key (host and path) wins, and of equally long ones
(two verdicts for one key) the blocking one. A url without a fitting rule is allowed.

Everything is built-in DataFrame functions: each url makes one candidate key per (host suffix, listed path length), of
which the filter drops nearly all that are not listed. Urls without a possible hit are judged as they are; the others'
possible hits are exploded and joined, and the longest hit is picked per url. The filter is an array of 64-bit blocks in
segments, built on the executors and handed to the scan as one value of about a byte a rule; beyond `MAX_BLOCKS` blocks
it no longer grows, so that more false positives reach the join, which removes them.

Defined cases: null urls and urls without `://` have an empty host and path and fit nothing; an empty table gives an
empty result; repeated rows stay; other columns of the input pass through only where asked for (`keep`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Larger lists are joined without a broadcast.
BROADCAST_RULES = 200_000
#: The filter's 64-bit blocks at most (64 MB: eight bits a key for 67 million rules), and blocks of one segment.
MAX_BLOCKS = 1 << 23
SEGMENT = 1 << 12


def host_of(url: Column) -> Column:
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def bloom_mask(key: Column) -> Column:
    """Four bits of a 64-bit block, from the upper bits of the key's hash."""
    h = F.xxhash64(key)
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, s).bitwiseAND(F.lit(63)).cast("int")) for s in (40, 46, 52, 58)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3])


def bloom_block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("int")


def blocks_for(n_rules: int) -> int:
    """A power of two with about eight bits a key, up to MAX_BLOCKS."""
    n_blocks = 1
    while n_blocks * 8 < n_rules and n_blocks < MAX_BLOCKS:
        n_blocks *= 2
    return n_blocks


def build_filter(rules: DataFrame, n_blocks: int) -> DataFrame:
    """One row, held: the filter's blocks as an array of segments."""
    own = rules.groupBy(bloom_block(F.col("rule"), n_blocks).cast("long").alias("id")).agg(F.bit_or(bloom_mask(F.col("rule"))).alias("mask"))
    every = rules.sparkSession.range(n_blocks).join(own, "id", "left").select((F.col("id") / SEGMENT).cast("int").alias("segment"), F.struct("id", F.coalesce("mask", F.lit(0)).alias("mask")).alias("block"))
    segments = every.groupBy("segment").agg(F.transform(F.array_sort(F.collect_list("block")), lambda x: x["mask"]).alias("blocks"))
    return segments.agg(F.transform(F.array_sort(F.collect_list(F.struct("segment", "blocks"))), lambda x: x["blocks"]).alias("held"))


def is_possible(key: Column, held: Column, n_blocks: int) -> Column:
    block = bloom_block(key, n_blocks)
    mask = bloom_mask(key)
    return F.element_at(F.element_at(held, F.shiftright(block, SEGMENT.bit_length() - 1) + 1), block.bitwiseAND(SEGMENT - 1) + 1).bitwiseAND(mask) == mask


def url_verdicts(pages: DataFrame, rules: DataFrame, url: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = "allow") -> DataFrame:
    """Columns keep, host, path, rule (null if none fits) and verdict. rules: host, path, verdict.

    Path lengths are taken from the list itself, host suffixes from the url, so an url has no more candidate keys than
    its labels times its path's length.
    """
    listed = cut(rules.select(F.concat(F.lower("host"), F.col("path")).alias("rule"), F.length("path").alias("n"), "verdict").where("rule is not null").groupBy("rule", "n").agg(F.max("verdict").alias("rule_verdict")))
    n_rules, lengths = listed.agg(F.count("*"), F.sort_array(F.collect_set("n"))).first()
    n_blocks = blocks_for(n_rules)
    kept = F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]) if keep else F.struct(F.lit(1))
    base = pages.select(kept.alias("kept"), host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    of_lengths = F.filter(F.array(*[F.lit(n) for n in lengths or [0]]), lambda n: F.length("path") >= n)
    keys = F.when(F.col("host") != "", F.flatten(F.transform(suffixes, lambda h: F.transform(of_lengths, lambda n: F.concat(h, F.substring(F.col("path"), F.lit(1), n))))))
    held = cut(build_filter(listed, n_blocks)).scalar()
    filtered = base.withColumn("held", held).withColumn("possible", F.filter(F.array_distinct(keys), lambda k: is_possible(k, F.col("held"), n_blocks))).drop("held")
    own = [F.col(f"kept.k{i}").alias(c) for i, c in enumerate(keep)]
    clear = filtered.where("coalesce(size(possible), 0) <= 0").select(*own, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    hits = filtered.where("size(possible) > 0").withColumn("row", F.monotonically_increasing_id()).select("row", "kept", "host", "path", F.explode("possible").alias("rule"))
    met = hits.join(F.broadcast(listed) if n_rules <= BROADCAST_RULES else listed, "rule", "left")
    best = F.max(F.when(F.col("rule_verdict").isNotNull(), F.struct(F.length("rule").alias("n"), "rule", "rule_verdict"))).alias("best")
    judged = met.groupBy("row").agg(F.first("kept").alias("kept"), F.first("host").alias("host"), F.first("path").alias("path"), best)
    return clear.unionByName(judged.select(*own, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict")))


ORACLE_SQL = r"""
WITH u AS (SELECT page_id,
                  translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(rule_host, rule_path, rule_verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
n AS (SELECT row_number() OVER () AS id, * FROM u),
b AS (SELECT id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(rule_verdict, length(rule_host || rule_path)) AS v
      FROM n JOIN r ON (host = rule_host OR host LIKE '%.' || rule_host) AND starts_with(path, rule_path) GROUP BY id)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM n LEFT JOIN b USING (id)
"""
