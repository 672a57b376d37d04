"""Ordered folds as mergeable aggregates.

A fold replays rows in (time, arrival) order onto one record per key.  Each kept value is
stored with the order of the row it came from, so partial results of disjoint inputs merge
in any order: two batches merged give the same record as one pass over both.

All values with the same rule share one aggregate: a struct led by the row order, of which
the minimum or maximum is kept.  Partial aggregation runs before the shuffle, so a key that
holds a large share of the rows costs one partial record per task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = ("fold_ts", "arrival")


def _seq() -> Column:
    return F.struct(*[F.col(name) for name in ORDER])


@dataclass(frozen=True)
class Fold:
    """Rules of one record type; every dict maps a result name to an input expression."""

    key: str
    source: str | None = None
    where: str | None = None
    first: dict[str, str] = field(default_factory=dict)
    last: dict[str, str] = field(default_factory=dict)
    last_known: dict[str, tuple[str, str]] = field(default_factory=dict)
    sums: dict[str, str] = field(default_factory=dict)
    maxes: dict[str, str] = field(default_factory=dict)
    first_order_of: dict[str, str] = field(default_factory=dict)
    finish: dict[str, str] = field(default_factory=dict)

    def key_of(self) -> Column:
        """The key of a row, NULL for a row that the fold leaves out."""
        key = F.expr(self.source or self.key)
        return F.when(F.expr(self.where), key) if self.where else key

    def partial(self, rows: DataFrame, *also: Column) -> DataFrame:
        """One mergeable record per key of these rows; ``also`` are further grouping columns."""
        if self.where:
            rows = rows.where(self.where)
        rows = rows.withColumn(self.key, F.expr(self.source or self.key)).withColumn("_seq", _seq())
        aggs = []
        if self.first:
            values = [F.expr(e).alias(n) for n, e in self.first.items()]
            aggs.append(F.min(F.struct("_seq", *values)).alias("_first"))
        if self.last:
            values = [F.expr(e).alias(n) for n, e in self.last.items()]
            aggs.append(F.max(F.struct("_seq", *values)).alias("_last"))
        for name, (value, condition) in self.last_known.items():
            kept = F.when(F.expr(condition), F.struct("_seq", F.expr(value).alias("v")))
            aggs.append(F.max(kept).alias(f"_known_{name}"))
        for name, condition in self.first_order_of.items():
            aggs.append(F.min(F.when(F.expr(condition), F.col("_seq"))).alias(f"_order_{name}"))
        aggs += [F.sum(F.expr(e)).alias(f"_sum_{n}") for n, e in self.sums.items()]
        aggs += [F.max(F.expr(e)).alias(f"_max_{n}") for n, e in self.maxes.items()]
        return rows.groupBy(self.key, *also).agg(*aggs)

    def single(self, rows: DataFrame) -> DataFrame:
        """A mergeable record of each row, as ``partial`` gives it for a row alone: no shuffle."""
        types = {f.name: f.dataType for f in self.partial(rows).schema}
        if self.where:
            rows = rows.where(self.where)
        rows = rows.withColumn(self.key, F.expr(self.source or self.key)).withColumn("_seq", _seq())
        made = {}
        for name, kept in (("_first", self.first), ("_last", self.last)):
            if kept:
                made[name] = F.struct("_seq", *[F.expr(e).alias(n) for n, e in kept.items()])
        for name, (value, condition) in self.last_known.items():
            made[f"_known_{name}"] = F.when(F.expr(condition), F.struct("_seq", F.expr(value).alias("v")))
        made |= {f"_order_{n}": F.when(F.expr(e), F.col("_seq")) for n, e in self.first_order_of.items()}
        made |= {f"_sum_{n}": F.expr(e) for n, e in self.sums.items()}
        made |= {f"_max_{n}": F.expr(e) for n, e in self.maxes.items()}
        return rows.select(self.key, *[made[n].cast(t).alias(n) for n, t in types.items() if n != self.key])

    def merge(self, partials: DataFrame) -> DataFrame:
        """Combine partial records of several inputs."""
        aggs = []
        for name in partials.columns:
            if name == "_first" or name.startswith("_order_"):
                aggs.append(F.min(name).alias(name))
            elif name.startswith("_sum_"):
                aggs.append(F.sum(name).alias(name))
            elif name.startswith("_"):
                aggs.append(F.max(name).alias(name))
        return partials.groupBy(self.key).agg(*aggs)

    def result(self, partials: DataFrame, *also: str) -> DataFrame:
        """The finished records, with further columns of the partial ones."""
        cols = [F.col(f"_first.{n}").alias(n) for n in self.first]
        cols += [F.col(f"_last.{n}").alias(n) for n in self.last]
        cols += [F.col(f"_known_{n}.v").alias(n) for n in self.last_known]
        cols += [F.col(f"_sum_{n}").alias(n) for n in self.sums]
        cols += [F.col(f"_max_{n}").alias(n) for n in self.maxes]
        cols += [F.col(f"_order_{n}") for n in self.first_order_of]
        out = partials.select(self.key, *also, *cols)
        for name, expr in self.finish.items():
            out = out.withColumn(name, F.expr(expr))
        return out.drop(*[f"_order_{n}" for n in self.first_order_of])

    def apply(self, rows: DataFrame) -> DataFrame:
        return self.result(self.partial(rows))
