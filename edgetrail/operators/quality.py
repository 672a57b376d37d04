"""Data-quality checks; each returns the rows that break a rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import ipv4_number

# The client lab's address plan.
CLIENT_FIRST, CLIENT_LAST = "192.168.0.151", "192.168.0.250"
CLIENT_SUBNET = ("192.168.0.0", "192.168.0.255")

# Rules of a run manifest.
MANIFEST_STATUS = ["scheduled", "running", "completed", "failed", "cancelled"]
ATTACK_FAMILIES = ["M1", "M2", "M3", "M4", "M5"]
DATASET_PREFIX = r"^tnsm_100lc_[0-9]{8}_.+$"
SCENARIO = r"^[NA][1-7]$"
CLIENT_ID = r"^lc[0-9]{3}$"

# Fixed value: the form of a date-time with its zone; the calendar day is tested apart.
DATE_TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt]([01][0-9]|2[0-3]):[0-5][0-9]:([0-5][0-9]|60)([.][0-9]+)?([Zz]|[+-]([01][0-9]|2[0-3]):[0-5][0-9])$"
MANIFEST_TIMES = ["scheduled_at", "started_at", "ended_at"]

PROVENANCE = ["run_id", "scenario_id", "logical_client_id", "seed"]


def check_unique(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values that occur more than once, per column: (field, value, rows)."""
    items = [F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns]
    counts = df.select(F.inline(F.array(*items))).groupBy("field", "value").agg(F.count("*").alias("rows"))
    return counts.where("rows > 1")


def check_distribution(df: DataFrame, column: str, expected: DataFrame) -> DataFrame:
    """Values whose row count differs from ``expected`` (value, rows), on either side."""
    seen = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("observed"))
    want = expected.select("value", F.col("rows").alias("expected"))
    both = seen.join(want, "value", "full_outer")
    filled = both.select("value", F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("observed", F.lit(0)).alias("observed"))
    return filled.where("expected <> observed")


def check_addresses(df: DataFrame, column: str, reserved: Sequence[str], first: str = CLIENT_FIRST, last: str = CLIENT_LAST) -> DataFrame:
    """Addresses outside the subnet, reserved, unexpected, or missing from the client range."""
    seen = df.select(F.col(column).alias("ip")).distinct().withColumn("n", ipv4_number(F.col("ip")))
    low, high = (ipv4_number(F.lit(a)) for a in CLIENT_SUBNET)
    from_, to = (ipv4_number(F.lit(a)) for a in (first, last))
    problem = (
        F.when(F.col("n").isNull() | ~F.col("n").between(low, high), "outside_subnet")
        .when(F.col("ip").isin(list(reserved)), "reserved")
        .when(~F.col("n").between(from_, to), "unexpected")
    )
    wrong = seen.select("ip", problem.alias("problem")).where("problem IS NOT NULL")
    spark = df.sparkSession
    start, stop = (_number(a) for a in (first, last))
    whole = spark.range(start, stop + 1).select(_dotted(F.col("id")).alias("ip"))
    missing = whole.join(seen, "ip", "left_anti").select("ip", F.lit("missing").alias("problem"))
    return wrong.unionByName(missing)


def _number(ip: str) -> int:
    a, b, c, d = (int(p) for p in ip.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


def _dotted(n: Column) -> Column:
    parts = [F.shiftright(n, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]
    return F.concat_ws(".", *parts)


def is_date_time(text: Column) -> Column:
    """Whether a text is a date-time with a zone and a day that exists; null for null."""
    day = F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd"))
    return F.when(text.isNotNull(), text.rlike(DATE_TIME) & day.isNotNull())


def check_manifest(df: DataFrame) -> DataFrame:
    """Broken manifest rules per run: (run_id, rule). Times may be null or not be there as columns at all."""
    c = F.col
    rules = {
        "schema_version": F.coalesce(c("schema_version") == 1, F.lit(False)),
        "run_id": F.coalesce(F.length("run_id") >= 8, F.lit(False)),
        "dataset_prefix": F.coalesce(c("dataset_prefix").rlike(DATASET_PREFIX), F.lit(False)),
        "scenario_id": F.coalesce(c("scenario_id").rlike(SCENARIO), F.lit(False)),
        "attack_family": c("attack_family").isNull() | c("attack_family").isin(ATTACK_FAMILIES),
        "seed": F.coalesce(c("seed") >= 0, F.lit(False)),
        "status": F.coalesce(c("status").isin(MANIFEST_STATUS), F.lit(False)),
        "client_ids_present": F.coalesce(F.size("logical_client_ids") >= 1, F.lit(False)),
        "client_ids_unique": F.coalesce(
            F.size(F.array_distinct("logical_client_ids")) == F.size("logical_client_ids"), F.lit(False)
        ),
        "client_ids_pattern": F.coalesce(
            F.forall("logical_client_ids", lambda i: F.coalesce(i.rlike(CLIENT_ID), F.lit(False))), F.lit(False)
        ),
        "parameters": c("parameters").isNotNull(),
        "expected_request_count": F.coalesce(c("expected_request_count") >= 0, F.lit(True)),
        "observed_request_count": F.coalesce(c("observed_request_count") >= 0, F.lit(True)),
        **{t: F.coalesce(is_date_time(c(t)), F.lit(True)) for t in MANIFEST_TIMES if t in df.columns},
    }
    broken = F.filter(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()]), lambda r: r.isNotNull())
    return df.select("run_id", F.explode(broken).alias("rule"))


def reconcile_manifest(manifest: DataFrame, rows: DataFrame) -> DataFrame:
    """Expected against observed requests and sessions per run, from both sides."""
    pairs = rows.where("run_id <> '-'").groupBy("run_id", "viewing_session_id").agg(F.count("*").alias("n"))
    seen = pairs.groupBy("run_id").agg(F.sum("n").alias("observed"), F.count("*").alias("sessions"))
    both = manifest.select("run_id", "expected_request_count").join(seen, "run_id", "full_outer")
    observed = F.coalesce("observed", F.lit(0))
    state = (
        F.when(F.col("expected_request_count").isNull(), "unplanned")
        .when(F.col("observed").isNull(), "missing")
        .when(observed < F.col("expected_request_count"), "short")
        .when(observed > F.col("expected_request_count"), "excess")
        .otherwise("match")
    )
    return both.select(
        "run_id", F.col("expected_request_count").alias("expected"), observed.alias("observed"),
        F.coalesce("sessions", F.lit(0)).alias("sessions"), state.alias("state"),
    )


def check_client_addresses(requests: DataFrame, clients: DataFrame) -> DataFrame:
    """Clients seen from another address than the inventory gives, or not in the inventory."""
    seen = (
        requests.where("logical_client_id <> '-' AND logical_client_id <> ''")
        .groupBy("logical_client_id", "client_ip")
        .agg(F.count("*").alias("requests"))
    )
    known = clients.select("logical_client_id", "source_ip")
    both = seen.join(known, "logical_client_id", "left")
    return both.where("source_ip IS NULL OR source_ip <> client_ip")


def duplicate_events(requests: DataFrame, key: str = "request_log_id") -> DataFrame:
    return requests.groupBy(key).agg(F.count("*").alias("rows")).where("rows > 1")


def missing_events(requests: DataFrame, expected: DataFrame, key: str = "request_log_id") -> DataFrame:
    return expected.select(key).distinct().join(requests.select(key), key, "left_anti")


def replay_difference(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows that only one of two folds of the same batch produced."""
    only = first.exceptAll(second).withColumn("side", F.lit("first"))
    return only.unionByName(second.exceptAll(first).withColumn("side", F.lit("second")))


def replay_summary(first: DataFrame, second: DataFrame, key: str, counters: Sequence[str] = ()) -> DataFrame:
    """One row over two folds of a batch, ``second`` with the batch delivered twice: ``nodes`` of the first fold, how many
    keys ``changed`` in a column that is no counter or are on one side only, and how many have all ``counters`` doubled."""
    plain = [c for c in first.columns if c not in {key, *counters}]
    both = first.withColumn("_side", F.lit(1)).unionByName(second.withColumn("_side", F.lit(2)))
    values = F.struct(*[F.col(c) for c in plain]) if plain else F.lit(0)
    side = {i: [F.max(F.when(F.col("_side") == i, F.col(c))) for c in counters] for i in (1, 2)}
    doubled = F.lit(bool(counters))
    for once, twice in zip(side[1], side[2], strict=True):
        doubled = doubled & twice.eqNullSafe(once * 2)
    keys = both.groupBy(key).agg(
        F.count_if(F.col("_side") == 1).alias("in_first"),
        F.count_if(F.col("_side") == 2).alias("in_second"),
        F.min(values).eqNullSafe(F.max(values)).alias("same"),
        doubled.alias("doubled"),
    )
    matched = (F.col("in_first") == 1) & (F.col("in_second") == 1)
    return keys.agg(
        F.coalesce(F.sum("in_first"), F.lit(0)).alias("nodes"),
        F.count_if(~(matched & F.col("same"))).alias("changed"),
        F.count_if(matched & F.col("doubled")).alias("doubled"),
    )


def split_leakage(df: DataFrame, key: str, split: str) -> DataFrame:
    """Keys that occur in more than one dataset split."""
    pairs = df.select(key, split).where(F.col(key).isNotNull()).distinct()
    return pairs.groupBy(key).agg(F.count("*").alias("splits")).where("splits > 1")


def without_provenance(df: DataFrame) -> DataFrame:
    """An export without the columns that name the run, scenario, client or seed."""
    return df.drop(*PROVENANCE)


def set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on one side only: (key, side)."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    only_left = a.join(b, key, "left_anti").withColumn("side", F.lit("left"))
    return only_left.unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))
