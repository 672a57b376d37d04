"""Inventory and checks of HLS playlists.

Inputs are two tables: playlist files (content_id, path, body) and all files of the tree
(content_id, path), where ``path`` is relative to the content folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.playlists import master_variants, playlist_fields
from ..functions.values import filled

MASTER = "master.m3u8"


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def _below(folder: Column, uri: Column) -> Column:
    name = F.substring_index(uri, "?", 1)
    return F.when(folder == "", name).otherwise(F.concat(folder, F.lit("/"), name))


def media_playlists(playlists: DataFrame) -> DataFrame:
    """One row per media playlist with the fields of its body."""
    media = playlists.where(F.substring_index("path", "/", -1) != MASTER)
    folder = _folder(F.col("path"))
    rendition = F.when(folder == "", F.col("content_id")).otherwise(F.substring_index(folder, "/", -1))
    return media.select("content_id", "path", rendition.alias("rendition"), playlist_fields(F.col("body")).alias("p")).select(
        "content_id", "path", "rendition", "p.*"
    )


def variants(playlists: DataFrame) -> DataFrame:
    """One row per variant of each master playlist."""
    master = playlists.where(F.col("path") == MASTER)
    return master.select("content_id", F.explode(master_variants(F.col("body"))).alias("v")).select(
        "content_id", "v.uri", "v.attributes"
    )


def reference_errors(playlists: DataFrame, files: DataFrame) -> DataFrame:
    """Error texts per content: missing master, no media, missing variants and segments."""
    contents = files.select("content_id").distinct()
    media = media_playlists(playlists)
    masters = playlists.where(F.col("path") == MASTER)
    existing = files.select("content_id", F.col("path").alias("target")).distinct()

    no_master = contents.join(masters, "content_id", "left_anti").select("content_id", F.lit("missing master.m3u8").alias("error"))
    no_media = contents.join(media, "content_id", "left_anti").select("content_id", F.lit("no media playlists").alias("error"))
    named = variants(playlists).select("content_id", F.substring_index("uri", "?", 1).alias("target"))
    no_variant = named.join(existing, ["content_id", "target"], "left_anti").select(
        "content_id", F.concat(F.lit("missing master variant: "), "target").alias("error")
    )
    ends = F.array(
        *[F.struct(F.lit(k).alias("key"), F.col(k).alias("uri")) for k in ("first_segment", "last_segment")]
    )
    used = media.select("content_id", "path", F.inline(ends)).where("uri IS NOT NULL")
    used = used.withColumn("target", _below(_folder(F.col("path")), F.col("uri")))
    shown = F.concat_ws("/", "content_id", filled(_folder(F.col("path"))), "uri")
    no_segment = used.join(existing, ["content_id", "target"], "left_anti").select(
        "content_id", F.concat(F.lit("missing referenced "), "key", F.lit(": "), shown).alias("error")
    )
    return no_master.unionByName(no_media).unionByName(no_variant).unionByName(no_segment).distinct()


def inventory(playlists: DataFrame, files: DataFrame, required: Sequence[str] = ("1080p", "720p")) -> DataFrame:
    """Per content: type, playlists, missing renditions and number of errors."""
    media = media_playlists(playlists)
    per_content = media.groupBy("content_id").agg(
        F.count("*").alias("playlists"),
        F.max(~F.col("has_endlist")).alias("open"),
        *[F.max(F.col("rendition") == r).alias(f"_has_{i}") for i, r in enumerate(required)],
    )
    errors = reference_errors(playlists, files).groupBy("content_id").agg(F.count("*").alias("errors"))
    masters = playlists.where(F.col("path") == MASTER).select("content_id", F.lit(True).alias("master_exists"))
    joined = (
        files.select("content_id").distinct()
        .join(per_content, "content_id", "left")
        .join(errors, "content_id", "left")
        .join(masters, "content_id", "left")
    )
    live = F.col("content_id").startswith("live_") | F.coalesce("open", F.lit(False))
    missing = [F.when(~F.coalesce(F.col(f"_has_{i}"), F.lit(False)), F.lit(r)) for i, r in enumerate(required)]
    return joined.select(
        "content_id",
        F.when(live, "live").otherwise("vod").alias("content_type"),
        F.coalesce("master_exists", F.lit(False)).alias("master_exists"),
        F.coalesce("playlists", F.lit(0)).alias("playlists"),
        F.concat_ws(",", *missing).alias("missing_renditions"),
        F.coalesce("errors", F.lit(0)).alias("errors"),
    )


def inventory_summary(items: DataFrame, min_vod: int = 1, min_live: int = 1) -> DataFrame:
    """Totals over an inventory and whether it meets the media baseline."""
    totals = items.agg(
        F.count("*").alias("contents"),
        F.count_if(F.col("content_type") == "vod").alias("vod"),
        F.count_if(F.col("content_type") == "live").alias("live"),
        F.count_if(F.col("errors") > 0).alias("contents_with_errors"),
        F.count_if(F.col("missing_renditions") != "").alias("contents_missing_renditions"),
    )
    passed = (
        (F.col("vod") >= min_vod) & (F.col("live") >= min_live)
        & (F.col("contents_with_errors") == 0) & (F.col("contents_missing_renditions") == 0)
    )
    return totals.withColumn("passed", passed)


def live_advance(before: DataFrame, after: DataFrame) -> DataFrame:
    """Whether each live playlist moved between two snapshots (key, media_sequence, last_segment)."""
    later = after.select(
        "key", F.col("media_sequence").alias("after_sequence"), F.col("last_segment").alias("after_last_segment")
    )
    both = before.select(
        "key", F.col("media_sequence").alias("before_sequence"), F.col("last_segment").alias("before_last_segment")
    ).join(later, "key", "left")
    moved = F.coalesce(F.col("after_sequence") > F.col("before_sequence"), F.lit(False)) | F.coalesce(
        (F.col("before_last_segment") != F.col("after_last_segment"))
        & (F.col("before_last_segment") != "")
        & (F.col("after_last_segment") != ""),
        F.lit(False),
    )
    return both.withColumn("advanced", moved)


def live_playlists(media: DataFrame, items: DataFrame) -> DataFrame:
    """The media playlists of contents that the inventory counts as live, with the key that a snapshot goes by."""
    live = items.where("content_type = 'live'").select("content_id")
    return media.join(live, "content_id", "left_semi").withColumn("key", F.concat_ws("/", "content_id", "path"))


def live_advance_summary(checked: DataFrame, items: DataFrame, min_live: int = 1) -> DataFrame:
    """Whether all live playlists moved and the inventory has enough live contents."""
    playlists_ = checked.select(F.lit(0).alias("live"), F.lit(1).alias("playlist"), F.when(F.col("advanced"), 0).otherwise(1).alias("stuck"))
    contents = items.where("content_type = 'live'").select(F.lit(1).alias("live"), F.lit(0).alias("playlist"), F.lit(0).alias("stuck"))
    totals = playlists_.unionByName(contents).agg(
        *[F.count_if(F.col(c) == 1).alias(n) for c, n in (("live", "live_contents"), ("playlist", "playlists_checked"), ("stuck", "failed"))]
    )
    passed = (F.col("live_contents") >= min_live) & (F.col("playlists_checked") > 0) & (F.col("failed") == 0)
    return totals.withColumn("passed", passed)


def catalog_difference(contents: DataFrame, files: DataFrame) -> DataFrame:
    """Paths that only the catalog or only the media tree has."""
    catalog = contents.select(F.col("hls_path").alias("path")).distinct()
    tree = files.select(F.col("content_id").alias("path")).distinct()
    only_tree = tree.join(catalog, "path", "left_anti").withColumn("side", F.lit("media"))
    return only_tree.unionByName(catalog.join(tree, "path", "left_anti").withColumn("side", F.lit("catalog")))
