"""Reading fields out of HLS playlist bodies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def playlist_lines(body: Column) -> Column:
    """Trimmed, non-empty lines."""
    return F.filter(F.transform(F.split(body, r"\r\n|\r|\n"), lambda s: F.trim(s)), lambda s: s != "")


def _first_tag_value(lines: Column, tag: str) -> Column:
    line = F.get(F.filter(lines, lambda s: s.startswith(tag)), 0)
    value = F.regexp_extract(line, "^[^:]*:(.*)$", 1)
    return F.when(value.rlike("^[0-9]+$"), value.try_cast("bigint"))


def playlist_fields(body: Column) -> Column:
    """Segment count, first and last segment, target duration, media sequence, end mark."""
    lines = playlist_lines(body)
    uris = F.filter(lines, lambda s: ~s.startswith("#"))
    return F.struct(
        F.size(uris).cast("bigint").alias("segment_count"),
        F.get(uris, 0).alias("first_segment"),
        F.try_element_at(uris, F.lit(-1)).alias("last_segment"),
        _first_tag_value(lines, "#EXT-X-TARGETDURATION").alias("target_duration_sec"),
        _first_tag_value(lines, "#EXT-X-MEDIA-SEQUENCE").alias("media_sequence"),
        F.array_contains(lines, "#EXT-X-ENDLIST").alias("has_endlist"),
    )


def stream_attributes(line: Column) -> Column:
    """``map<string,string>`` of a STREAM-INF line; commas inside quotes do not split."""
    raw = F.regexp_extract(line, "^[^:]*:(.*)$", 1)
    pairs = F.regexp_extract_all(raw, F.lit('([A-Z0-9-]+=(?:"[^"]*"|[^,]*))'), F.lit(1))
    names = F.transform(pairs, lambda p: F.substring_index(p, "=", 1))
    values = F.transform(pairs, lambda p: F.btrim(F.regexp_replace(p, "^[^=]*=", ""), F.lit('"')))
    unique = F.array_distinct(names)
    return F.map_from_arrays(
        unique,
        F.transform(unique, lambda n: F.element_at(F.filter(F.arrays_zip(names.alias("n"), values.alias("v")), lambda z: z["n"] == n), -1)["v"]),
    )


def master_variants(body: Column) -> Column:
    """``array<struct<uri, attributes>>``: each STREAM-INF line with the URI line after it."""
    lines = playlist_lines(body)
    follows = F.concat(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), F.array(F.lit("")))
    pairs = F.zip_with(lines, follows, lambda a, b: F.struct(a.alias("line"), b.alias("uri")))
    heads = F.filter(
        pairs,
        lambda p: p["line"].startswith("#EXT-X-STREAM-INF") & (p["uri"] != "") & ~p["uri"].startswith("#"),
    )
    return F.transform(
        heads,
        lambda p: F.struct(p["uri"].alias("uri"), stream_attributes(p["line"]).alias("attributes")),
    )
