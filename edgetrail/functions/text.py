"""Tag cleaning, lists and catalog text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Encoder renditions in their fixed order.
PROFILE_ORDER = ["1080p", "720p"]


def sanitize_tag(value: Column, max_length: int = 48, case: str | None = None) -> Column:
    """Keep ``[A-Za-z0-9_-]``, cut to length, optionally change case; missing gives ``""``."""
    clean = F.left(F.regexp_replace(F.trim(value), "[^a-zA-Z0-9_-]", ""), F.lit(max_length))
    clean = F.coalesce(clean, F.lit(""))
    return {"upper": F.upper, "lower": F.lower, None: lambda c: c}[case](clean)


def first_tag(
    body: Column, query: Column, names: list[str], max_length: int = 48, case: str | None = None
) -> Column:
    """First non-blank of a name and its aliases, body before query at each name, then cleaned.

    ``body`` and ``query`` are ``map<string,string>`` columns.
    """
    candidates = []
    for name in names:
        for source in (body, query):
            value = source[name]
            candidates.append(F.when(F.trim(value) != "", value))
    return sanitize_tag(F.coalesce(*candidates), max_length, case)


def split_list(text: Column, fallback: list[str] | None = None) -> Column:
    """Comma list to an array of trimmed, non-empty items; blank text gives the fallback."""
    items = F.filter(F.transform(F.split(text, ","), lambda i: F.trim(i)), lambda i: i != "")
    default = F.array(*[F.lit(v) for v in (fallback or [])]).cast("array<string>")
    return F.when(F.trim(text) != "", items).otherwise(default)


def slugify(text: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    slug = F.regexp_replace(low, "[^a-z0-9가-힣]+", "_")
    return F.left(F.btrim(slug, F.lit("_")), F.lit(60))


def duration_label(seconds: Column) -> Column:
    """Hours, minutes and seconds as the Korean label text; at least one second."""
    total = F.greatest(F.lit(1).cast("bigint"), F.coalesce(seconds.cast("bigint"), F.lit(0)))
    hours = F.floor(total / 3600)
    minutes = F.floor(total % 3600 / 60)
    return F.concat_ws(
        " ",
        F.when(hours > 0, F.concat(hours.cast("string"), F.lit("시간"))),
        F.when((minutes > 0) | (hours > 0), F.concat(minutes.cast("string"), F.lit("분"))),
        F.concat((total % 60).cast("string"), F.lit("초")),
    )


def resolutions(requested: Column) -> Column:
    """Known renditions of an array in the fixed order, all of them if none is named."""
    order = F.array(*[F.lit(p) for p in PROFILE_ORDER])
    chosen = F.array_intersect(order, F.coalesce(requested, F.array().cast("array<string>")))
    return F.when(F.size(chosen) > 0, chosen).otherwise(order)
