"""Block lists: current state from actions, flags on requests, address ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import ipv4_number
from ..session import materialize
from .joins import join_on_summary

# Kinds of block-list entries.
TYPES = ["ips", "tokens", "referers"]


def blacklist_state(actions: DataFrame) -> DataFrame:
    """Entries in force after all actions (seq, type, value, op add|remove).

    Unknown types and empty values are rejected; the last action of an entry decides.
    """
    valid = actions.where(F.col("type").isin(TYPES) & (F.col("value") != ""))
    last = valid.groupBy("type", "value").agg(F.max_by("op", "seq").alias("op"))
    return last.where("op = 'add'").select("type", "value")


def expand_policy_reports(reports: DataFrame) -> DataFrame:
    """Bulk reports (seq, blocked_ips, blocked_tokens, blocked_referers) as add actions."""
    lists = {"ips": "blocked_ips", "tokens": "blocked_tokens", "referers": "blocked_referers"}
    out = None
    for type_, column in lists.items():
        part = reports.select("seq", F.lit(type_).alias("type"), F.explode(column).alias("value"), F.lit("add").alias("op"))
        out = part if out is None else out.unionByName(part)
    return out


# Where each kind of entry can occur in a request.
BLOCK_KEYS = {"ips": ["remote_addr"], "tokens": ["http_x_session_token", "log_session_token"], "referers": ["referer"]}
# Bits per entry of the filter, and the most words it may have (1 MB in every task).
FILTER_BITS = 16
FILTER_WORDS = 1 << 17


def _filter_bits(type_: Column, value: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(type_, value, F.lit(seed)), F.lit(bits)) for seed in (1, 2)]


def present_filter(entries: DataFrame) -> tuple[Column, int]:
    """A Bloom filter over (type, value) as a constant array of 64-bit words, and its bits.

    It grows with the list up to ``FILTER_WORDS``; beyond that it lets more absent keys through,
    which the join then sorts out.
    """
    words = min(FILTER_WORDS, max(1, entries.count() * FILTER_BITS // 64))
    bits = words * 64
    at = F.explode(F.array(*_filter_bits(F.col("type"), F.col("value"), bits)))
    placed = entries.select(at.alias("at")).select(F.expr("at div 64").alias("word"), F.expr("shiftleft(1L, CAST(at % 64 AS INT))").alias("bit"))
    held = [0] * words
    for row in placed.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():
        held[row["word"]] = row["bits"]
    # Text is folded to one array constant; single literals would make a plan of as many nodes.
    return F.split(F.lit(",".join(map(str, held))), ",").cast("array<bigint>"), bits


def blocked_flag(requests: DataFrame, blacklist: DataFrame) -> DataFrame:
    """Adds ``blocked``: the address, a token field or the exact referer is on the list.

    Keys that a Bloom filter of the list rules out never leave their row.  Only rows with a key that
    may be listed go through one join with the list, once for each such key.
    """
    # Written once: the filter and the join read the list.
    state = materialize(blacklist.select("type", "value").where("value IS NOT NULL").distinct(), "blacklist")
    words, bits = present_filter(state)

    def maybe(type_: str, column: str) -> Column:
        hit = F.lit(True)
        for at in _filter_bits(F.lit(type_), F.col(column), bits):
            word = F.get(words, F.shiftright(at, 6).cast("int"))
            hit = hit & (F.call_function("shiftright", word, (at % 64).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return F.when(F.col(column).isNotNull() & hit, F.struct(F.lit(type_).alias("type"), F.col(column).alias("value")))

    found = F.filter(F.array(*[maybe(t, c) for t, columns in BLOCK_KEYS.items() for c in columns]), lambda k: k.isNotNull())
    columns = requests.columns
    # Written once, so that the log is parsed once for both kinds of rows.
    keyed = materialize(requests.withColumn("_keys", found).withColumn("_open", F.size("_keys") > 0), "block-keys")
    clear, open_ = keyed.where("NOT _open"), keyed.where("_open").withColumn("_row", F.monotonically_increasing_id())
    long = open_.select(F.struct(*columns).alias("_request"), "_row", F.inline("_keys"))
    listed = long.join(state.withColumn("_listed", F.lit(True)), ["type", "value"], "left")
    flags = listed.groupBy("_row").agg(F.any_value("_request").alias("_request"), F.coalesce(F.max("_listed"), F.lit(False)).alias("blocked"))
    return clear.select(*columns, F.lit(False).alias("blocked")).unionByName(flags.select("_request.*", "blocked"))


def blocked_by_range(requests: DataFrame, ranges: DataFrame, address: str = "client_ip") -> DataFrame:
    """Requests whose address lies in a blocked CIDR range or equals a blocked address.

    Each range is (prefix length, network).  Distinct addresses are matched by equality on the
    network of every prefix length in use, of which there are at most 33.
    """
    slash = F.col("cidr").contains("/")
    length = F.when(slash, F.substring_index("cidr", "/", -1)).otherwise("32").try_cast("int")
    number = ipv4_number(F.substring_index("cidr", "/", 1))

    def network(value, bits):
        return F.floor(value / F.pow(F.lit(2.0), F.lit(32) - bits)).cast("bigint")

    nets = ranges.select(length.alias("bits")).where("bits BETWEEN 0 AND 32").distinct()
    bits = [row["bits"] for row in nets.collect()]
    blocked = (
        ranges.select(length.alias("bits"), number.alias("ip"))
        .where("bits BETWEEN 0 AND 32 AND ip IS NOT NULL")
        .select("bits", network(F.col("ip"), F.col("bits")).alias("net"))
        .distinct()
    )
    choices = F.array(*[F.lit(b) for b in bits]).cast("array<int>")
    addresses = (
        requests.groupBy(address).agg(F.count("*").alias("_n"))
        .withColumn("_ip", ipv4_number(F.col(address)))
        .select(address, "_n", "_ip", F.explode(choices).alias("bits"))
        .withColumn("net", network(F.col("_ip"), F.col("bits")))
    )
    hits = addresses.join(blocked, ["bits", "net"], "left_semi").groupBy(address).agg(F.max("_n").alias("_n"))
    return join_on_summary(requests, hits, [address], "_n").select(*requests.columns)
