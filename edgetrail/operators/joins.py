"""Join helpers for skewed keys and small lookup tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A lookup of at most this many rows is broadcast; the check counts no further than that.
BROADCAST_ROWS = 200_000
# Rows of one key that one shuffle task can hold with ease.
HOT_ROWS = 5_000_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only after counting; beyond the bound Spark joins by shuffle."""
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


def apart(df: DataFrame, *branches: Column | str) -> list[DataFrame]:
    """Filtered branches of one aggregated frame that share its shuffle.

    A plain filter would be pushed below the aggregation, and each branch would then scan and
    shuffle the input again.  Re-packing the row keeps the filters above the shared shuffle.
    """
    packed = df.select(F.struct(*df.columns).alias("_row"))
    opened = packed.select(F.inline(F.array("_row")))
    return [opened.where(b) for b in branches]


def join_on_summary(
    rows: DataFrame, summary: DataFrame, keys: Sequence[str], rows_column: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Inner join of rows with one summary row per key, safe when single keys are huge.

    ``rows_column`` of the summary counts the input rows of the key.  Keys above ``hot_rows``
    number at most (all rows / hot_rows), so their summaries are broadcast, and their rows get
    a salt that spreads them over the shuffle in which the other keys meet their summaries.
    The rows are read once.
    """
    values = [c for c in summary.columns if c not in keys]
    hot, cold = apart(summary, F.col(rows_column) > hot_rows, F.col(rows_column) <= hot_rows)
    hot = hot.select(*keys, *[F.col(v).alias(f"_hot_{v}") for v in values], F.lit(True).alias("_hot"))
    cold = cold.select(
        *keys, *[F.col(v).alias(f"_cold_{v}") for v in values], F.lit(True).alias("_cold"), F.lit(0).cast("bigint").alias("_salt")
    )
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*rows.columns), F.lit(100_000)) + 1).otherwise(0).cast("bigint")
    met = rows.join(F.broadcast(hot), list(keys), "left").withColumn("_salt", salt)
    met = met.join(cold, [*keys, "_salt"], "left").where("_hot OR _cold")
    chosen = [F.when(F.col("_hot"), F.col(f"_hot_{v}")).otherwise(F.col(f"_cold_{v}")).alias(v) for v in values]
    return met.select(*rows.columns, *chosen)
