"""Addresses that share tokens or referrers.

All pairs of addresses behind a widely shared token grow with the square of the group, so
``ip_correlation`` forms pairs only from given start addresses, and ``ip_similarity`` only pairs
that are alike enough.  The shared tokens are also reported per address.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .joins import apart, join_on_summary
from .similarity import HOT_GROUP, similar_sets

INPUTS = ("client_ip", "cdn_token_id", "referrer_domain")


def _incidence(rows: DataFrame) -> DataFrame:
    """Distinct (kind, value, ip) with the times between which it was seen."""
    items = F.array(
        F.struct(F.lit("token").alias("kind"), F.expr("if(cdn_token_id = '', NULL, cdn_token_id)").alias("value")),
        F.struct(F.lit("referrer").alias("kind"), F.col("referrer_domain").alias("value")),
    )
    return (
        rows.where("client_ip <> '-' AND client_ip <> ''")
        .select(F.col("client_ip").alias("ip"), "fold_ts", F.inline(items))
        .where("value IS NOT NULL")
        .groupBy("kind", "value", "ip")
        .agg(F.min("fold_ts").alias("first_seen"), F.max("fold_ts").alias("last_seen"))
    )


def shared_tokens(rows: DataFrame) -> DataFrame:
    """Per address: tokens, tokens shared with other addresses, and the largest such group."""
    (tokens,) = apart(_incidence(rows), "kind = 'token'")
    tokens = tokens.select("value", "ip")
    groups = tokens.groupBy("value").agg(F.count("*").alias("addresses"))
    return (
        join_on_summary(tokens, groups, ["value"], "addresses")
        .groupBy("ip")
        .agg(
            F.count("*").alias("tokens"),
            F.count_if(F.col("addresses") > 1).alias("shared_tokens"),
            F.max("addresses").alias("largest_group"),
        )
    )


def ip_correlation(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """Correlation edges from each start address (column ``ip``) to every address sharing a token.

    shared_tokens and shared_referers are counts, ``overlap_sec`` is the time both addresses
    were active, and the score is the Jaccard index over tokens and referrers together.  Work
    and result grow with starts x addresses, never with all pairs.
    """
    seen = _incidence(rows)
    tokens, referrers, own, spans = apart(seen, "kind = 'token'", "kind = 'referrer'", "true", "true")
    own = own.join(starts.select("ip").distinct(), "ip", "left_semi").select("kind", "value", F.col("ip").alias("ip1"))
    pairs = (
        own.where("kind = 'token'")
        .join(tokens.select("value", F.col("ip").alias("ip2")), "value")
        .where("ip1 <> ip2")
        .groupBy("ip1", "ip2")
        .agg(F.count("*").alias("shared_tokens"))
    )
    # Referrers are compared only for pairs that share a token: a referrer of everyone makes no pairs.
    visited = pairs.select("ip1", "ip2").join(own.where("kind = 'referrer'").select("ip1", "value"), "ip1")
    common = (
        visited.join(referrers.select("value", F.col("ip").alias("ip2")), ["value", "ip2"])
        .groupBy("ip1", "ip2")
        .agg(F.count("*").alias("shared_referers"))
    )
    shared = pairs.join(common, ["ip1", "ip2"], "left").fillna(0, ["shared_referers"])
    per_ip = spans.groupBy("ip").agg(
        F.count("*").alias("items"), F.min("first_seen").alias("first"), F.max("last_seen").alias("last")
    )
    left = per_ip.select(*[F.col(n).alias(f"{n}1") for n in per_ip.columns])
    right = per_ip.select(*[F.col(n).alias(f"{n}2") for n in per_ip.columns])
    both = shared.join(left, "ip1").join(right, "ip2")
    common = F.col("shared_tokens") + F.col("shared_referers")
    overlap = F.unix_seconds(F.least("last1", "last2")) - F.unix_seconds(F.greatest("first1", "first2"))
    return both.select(
        "ip1",
        "ip2",
        "shared_tokens",
        "shared_referers",
        F.greatest(overlap, F.lit(0)).alias("overlap_sec"),
        F.round(common / (F.col("items1") + F.col("items2") - common), 6).alias("score"),
    )


def _numbered(starts: DataFrame) -> DataFrame:
    """Starts with a word and a bit of their own; written, so that the numbers stay."""
    numbered = starts.select("ip").distinct().withColumn("_id", F.monotonically_increasing_id())
    bit = F.expr("shiftleft(1L, CAST(_id % 64 AS INT))")
    return materialize(numbered.select("ip", F.shiftright("_id", 6).alias("word"), bit.alias("bit")), "starts")


def _gathered(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key, "word").agg(F.bit_or("bits").alias("bits"))


def ip_reach(rows: DataFrame, starts: DataFrame, max_hops: int = 2) -> tuple[DataFrame, DataFrame]:
    """For each address the starts that reach it, by hops, as bits: (ip, hops, word, bits), and the numbered starts.

    All starts are searched at once, 64 in a word.  A hop goes address -> token -> address, and only
    bits that are new at an address go on, so a hop costs the pairs of addresses that just gained a
    start, not starts x addresses.
    """
    (pairs,) = apart(_incidence(rows), "kind = 'token'")
    pairs = materialize(pairs.select("value", "ip"), "address-tokens")
    numbered = _numbered(starts)
    frontier = _gathered(numbered.select("ip", "word", F.col("bit").alias("bits")), "ip")
    reached, levels = frontier, []
    for hop in range(1, max_hops + 1):
        tokens = _gathered(frontier.join(pairs, "ip"), "value")
        arrived = _gathered(tokens.join(pairs, "value"), "ip")
        old = reached.select("ip", "word", F.col("bits").alias("_old"))
        new = arrived.join(old, ["ip", "word"], "left").withColumn("bits", F.expr("bits & ~coalesce(_old, 0L)"))
        frontier = materialize(new.where("bits <> 0").select("ip", "word", "bits"), f"reached-{hop}")
        levels.append(frontier.withColumn("hops", F.lit(hop)))
        reached = _gathered(reached.unionByName(frontier), "ip")
    return reduce(DataFrame.unionByName, levels).select("ip", "hops", "word", "bits"), numbered


def ip_paths(rows: DataFrame, starts: DataFrame, max_hops: int = 2) -> DataFrame:
    """Addresses reached from each start address over shared tokens, with the least hops: ``ip_reach`` as pairs."""
    found, numbered = ip_reach(rows, starts, max_hops)
    each = found.select("ip", "hops", "word", F.expr("explode(filter(sequence(0, 63), i -> (shiftright(bits, i) & 1L) = 1L))").alias("_i"))
    each = each.select("ip", "hops", "word", F.expr("shiftleft(1L, _i)").alias("bit"))
    return each.join(numbered.withColumnRenamed("ip", "start"), ["word", "bit"]).select("start", "ip", "hops")


def ip_similarity(rows: DataFrame, least: float, hot_group: int = HOT_GROUP) -> tuple[DataFrame, DataFrame]:
    """Addresses by what they share, over the whole log: classes of equal addresses, and alike classes.

    The classes are (ip, cls, items); the pairs (cls1, cls2, shared_tokens, shared_referers, score) have
    a Jaccard index over tokens and referrers of at least ``least``.  No pair behind a popular token or
    referrer is formed unless it is a result (see ``similarity``).
    """
    seen = materialize(_incidence(rows).select("kind", "value", "ip"), "address-items")
    named = seen.select(F.col("ip").alias("key"), F.concat_ws(":", "kind", "value").alias("item"))
    classes, pairs = similar_sets(named, least, hot_group)
    pairs = materialize(pairs, "alike-addresses")
    one = pairs.join(seen.where("kind = 'token'").select(F.col("ip").alias("cls1"), "value"), "cls1")
    both = one.join(seen.where("kind = 'token'").select(F.col("ip").alias("cls2"), "value"), ["cls2", "value"])
    tokens = both.groupBy("cls1", "cls2").agg(F.count("*").alias("shared_tokens"))
    out = pairs.join(tokens, ["cls1", "cls2"], "left").fillna(0, ["shared_tokens"])
    out = out.select("cls1", "cls2", "shared_tokens", (F.col("shared") - F.col("shared_tokens")).alias("shared_referers"), F.round("score", 6).alias("score"))
    return classes.select(F.col("key").alias("ip"), "cls", F.col("size").alias("items")), out
