"""Similarity join of sets: all pairs with at least a given Jaccard index, without listing a popular item's pairs.

Keys with equal sets form one class, and only classes are compared.  Items are put in order, rare ones
first.  Two sets x and y that are alike enough share at least c = ceil(least * size) items each, so the
k-th item they share lies among the first size - c + k of both.  Sets meet under their first shared item;
a group that is too large is not paired but split by the second shared item, then the third, and so on.
Inside a large group only pairs are formed that the k items they share make alike enough already, so
they are all results.  The join is exact for every threshold above 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize
from .joins import join_on_summary

# Sets of one group that are compared pair by pair; larger groups are split further.
HOT_GROUP = 2_000


def set_classes(items: DataFrame) -> DataFrame:
    """(key, cls, size) from distinct (key, item): keys with equal sets share the least key as their class.

    Sets are told apart by their size and two 64-bit sums that do not depend on order, so a set of any
    size costs one record per task.
    """
    marks = items.groupBy("key").agg(
        F.count("*").alias("size"), F.bit_xor(F.xxhash64("item")).alias("_a"), F.bit_xor(F.xxhash64("item", F.lit(1))).alias("_b")
    )
    marks = materialize(marks, "set-marks")
    first = marks.groupBy("size", "_a", "_b").agg(F.min("key").alias("cls"), F.count("*").alias("_n"))
    return join_on_summary(marks, first, ["size", "_a", "_b"], "_n").select("key", "cls", "size")


def _needed(size: Column, least: float) -> Column:
    """Items that a set must share with any other to be alike enough."""
    return F.ceil(size * F.lit(least) - F.lit(1e-9))


def similar_sets(items: DataFrame, least: float, hot_group: int = HOT_GROUP) -> tuple[DataFrame, DataFrame]:
    """Classes (key, cls, size) and all pairs of classes (cls1 < cls2, shared, score) with score >= ``least``.

    ``items`` has distinct (key, item), both text; keys or items that are NULL take no part.
    """
    items = materialize(items.where("key IS NOT NULL AND item IS NOT NULL").select("key", "item"), "set-items")
    classes = materialize(set_classes(items), "set-classes")
    kept = items.join(classes.where("key = cls").select("cls", "size"), F.col("key") == F.col("cls")).select("cls", "size", "item")
    seen = kept.groupBy("item").agg(F.count("*").alias("_n")).where("_n > 1")  # an item of one set joins nothing
    place = F.row_number().over(Window.partitionBy("cls").orderBy("_n", "item")) + F.col("_alone")
    shared = join_on_summary(kept, seen, ["item"], "_n")
    alone = classes.where("key = cls").select("cls", "size").join(shared.groupBy("cls").agg(F.count("*").alias("_some")), "cls")
    sets = shared.join(alone.select("cls", (F.col("size") - F.col("_some")).alias("_alone")), "cls")
    # Items of one set alone come first in the order, so places count them.
    sets = materialize(sets.withColumn("place", place).select("cls", "size", "item", "place"), "sets")

    needed = _needed(F.col("size"), least)
    nodes = sets.where(F.col("place") <= F.col("size") - needed + 1).select(F.col("item").alias("group"), "cls", "size", "place")
    pairs, depth = None, 1
    while True:
        sizes = nodes.groupBy("group").agg(F.count("*").alias("_n")).where("_n > 1")
        nodes = materialize(join_on_summary(nodes, sizes, ["group"], "_n"), f"set-groups-{depth}")
        near = F.least("size1", "size2") >= F.greatest("size1", "size2") * F.lit(least) - F.lit(1e-9)
        cold = nodes.where(F.col("_n") <= hot_group)
        found = _sides(cold, "group").where(near)
        hot = nodes.where(F.col("_n") > hot_group)
        if not hot.isEmpty():
            # These share depth items and are small enough for that to suffice.
            most = F.floor(F.lit(depth * (1 + least) / least + 1e-9))
            small = hot.where(F.col("size") <= most - depth)
            partners = small.withColumn("partner", F.explode(F.sequence(F.lit(depth).cast("bigint"), (most - F.col("size")).cast("bigint"))))
            left = partners.select("group", F.col("partner").alias("_size"), F.col("cls").alias("cls1"), F.col("size").alias("size1"))
            right = small.select("group", F.col("size").alias("_size"), F.col("cls").alias("cls2"), F.col("size").alias("size2"))
            found = found.unionByName(left.join(right, ["group", "_size"]).where("cls1 < cls2").drop("_size", "group"))
        pairs = found if pairs is None else pairs.unionByName(found)
        if hot.isEmpty():
            break
        # All other pairs share one more item, which leaves room for it in both sets.
        more = hot.select("group", "cls", "size", F.col("place").alias("_from"))
        deeper = more.join(sets.select("cls", "item", "place"), "cls").where(
            (F.col("place") > F.col("_from")) & (F.col("place") <= F.col("size") - F.greatest(needed, F.lit(depth + 1)) + depth + 1)
        )
        nodes = deeper.select(F.concat_ws("\x1f", "group", "item").alias("group"), "cls", "size", "place")
        depth += 1
    pairs = materialize(pairs.distinct(), "set-pairs")
    one = pairs.join(sets.select(F.col("cls").alias("cls1"), "item"), "cls1")
    both = one.join(sets.select(F.col("cls").alias("cls2"), "item"), ["cls2", "item"])
    counted = both.groupBy("cls1", "cls2", "size1", "size2").agg(F.count("*").alias("shared"))
    score = F.col("shared") / (F.col("size1") + F.col("size2") - F.col("shared"))
    scored = counted.withColumn("score", score).where(F.col("score") >= F.lit(least) - F.lit(1e-9))
    return classes, scored.select("cls1", "cls2", "shared", "score")


def _sides(nodes: DataFrame, *on: str) -> DataFrame:
    left = nodes.select(*on, F.col("cls").alias("cls1"), F.col("size").alias("size1"))
    right = nodes.select(*on, F.col("cls").alias("cls2"), F.col("size").alias("size2"))
    return left.join(right, list(on)).where("cls1 < cls2").drop(*on)
