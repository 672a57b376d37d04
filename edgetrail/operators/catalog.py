"""Content catalog: order, slices, search, upsert and delete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import split_list
from ..functions.values import filled
from .joins import broadcast_if_small

# Defaults of catalog fields and the names of the two home-page sections.
DEFAULT_RATING = "전체"
DEFAULT_CATEGORY = "콘텐츠"
DEFAULT_RESOLUTIONS = ["1080p", "720p"]
LIVE_SECTION = "라이브"
OTHER_SECTION = "콘텐츠"


def catalog_order() -> list[Column]:
    """Featured first, newest year first (unknown years lead), then title; id breaks ties."""
    return [
        F.desc_nulls_first("featured"),
        F.desc_nulls_first("year"),
        F.asc_nulls_last("title"),
        F.asc("content_id"),
    ]


def list_contents(contents: DataFrame, type_: str | None = None) -> DataFrame:
    if type_:
        contents = contents.where(F.col("content_type") == type_.lower())
    return contents.orderBy(*catalog_order())


def recommended(contents: DataFrame, n: int = 4) -> DataFrame:
    return list_contents(contents, "vod").limit(n)


def trending(contents: DataFrame, n: int = 10) -> DataFrame:
    return list_contents(contents).limit(n)


def by_genre(contents: DataFrame, genre: str) -> DataFrame:
    wanted = genre.strip().lower()
    return contents.where(F.exists("genre", lambda g: F.lower(g) == wanted)).orderBy(*catalog_order())


def search_contents(contents: DataFrame, text: str) -> DataFrame:
    """Case-insensitive match in five fields; ``%`` and ``_`` are wildcards, blank lists all."""
    wanted = text.strip()
    if not wanted:
        return list_contents(contents)
    pattern = f"%{wanted}%"
    hit = F.col("content_id").ilike(pattern)
    for field in ("title", "description", "category"):
        hit = hit | F.coalesce(F.col(field).ilike(pattern), F.lit(False))
    hit = hit | F.coalesce(F.array_join("genre", " ").ilike(pattern), F.lit(False))
    return contents.where(hit).orderBy(*catalog_order())


def catalog_sections(contents: DataFrame) -> DataFrame:
    """Contents per home-page section, with the first content of each in catalog order."""
    section = F.when(F.col("content_type") == "live", LIVE_SECTION).otherwise(OTHER_SECTION)
    # As a minimum: not featured, descending year with unknown first, title, id.
    rank = F.struct(
        F.coalesce(~F.col("featured"), F.lit(False)).alias("a"),
        F.coalesce(-F.col("year"), F.lit(-2147483648)).alias("b"),
        F.col("title").isNull().alias("c"),
        F.col("title").alias("d"),
        F.col("content_id").alias("id"),
    )
    return contents.groupBy(section.alias("section")).agg(
        F.count("*").alias("contents"), F.min(rank).getField("id").alias("first_content_id")
    )


def featured_content(contents: DataFrame) -> DataFrame:
    """The first featured content in catalog order, else the first content."""
    first = F.coalesce(F.col("featured"), F.lit(False))
    return contents.orderBy(first.desc(), *catalog_order()).limit(1)


def normalize_payload(writes: DataFrame) -> DataFrame:
    """Catalog writes as entered (text fields) with trimmed values and defaults.

    Writes without id, path or title are rejected.
    """
    def text(name: str, default: str = "") -> Column:
        return F.trim(F.coalesce(filled(F.col(name)), F.lit(default)))

    rows = writes.select(
        "seq",
        text("content_id").alias("content_id"),
        F.trim(F.coalesce(filled(F.col("hls_path")), filled(F.col("content_id")), F.lit(""))).alias("hls_path"),
        text("title").alias("title"),
        text("description").alias("description"),
        F.col("year").try_cast("int").alias("year"),
        text("rating", DEFAULT_RATING).alias("rating"),
        split_list(F.col("genre")).alias("genre"),
        text("category", DEFAULT_CATEGORY).alias("category"),
        F.lower(F.coalesce(filled(F.col("content_type")), F.lit("vod"))).alias("content_type"),
        F.coalesce("featured", F.lit(False)).alias("featured"),
        split_list(F.col("available_resolutions"), DEFAULT_RESOLUTIONS).alias("available_resolutions"),
        filled(F.col("source_path")).alias("source_path"),
        "ts",
    )
    return rows.where("content_id <> '' AND hls_path <> '' AND title <> ''")


def upsert_contents(contents: DataFrame, writes: DataFrame) -> DataFrame:
    """Catalog after writes in order of ``seq``; both frames share their columns.

    The last write of a content wins; only the source path keeps its last known value, and
    the creation time is that of the first row.
    """
    keep = {"content_id", "source_path", "created_at", "updated_at", "seq", "ts"}
    values = [c for c in contents.columns if c not in keep]
    old = contents.select(
        F.lit(-1).cast("bigint").alias("seq"), "content_id", *values, "source_path", "created_at", "updated_at"
    )
    new = writes.select(
        "seq", "content_id", *values, "source_path", F.col("ts").alias("created_at"), F.col("ts").alias("updated_at")
    )
    return (
        old.unionByName(new)
        .groupBy("content_id")
        .agg(
            F.max(F.struct("seq", *values, "updated_at")).alias("l"),
            F.max(F.when(F.col("source_path").isNotNull(), F.struct("seq", "source_path"))).alias("s"),
            F.min(F.struct("seq", "created_at")).alias("f"),
        )
        .select("content_id", *[f"l.{v}" for v in values], "s.source_path", "f.created_at", "l.updated_at")
    )


def delete_contents(
    contents: DataFrame, favorites: DataFrame, history: DataFrame, deleted: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the deleted contents; ids that are not in the catalog do nothing."""
    known = contents.select("content_id").join(deleted.select("content_id").distinct(), "content_id", "left_semi")
    known = broadcast_if_small(known)
    return tuple(t.join(known, "content_id", "left_anti") for t in (contents, favorites, history))
