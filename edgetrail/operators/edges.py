"""Edge tables: distinct (source, destination) pairs per relationship type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .folds import ORDER
from .joins import apart

# Relationship type, source label and key, destination label and key, as in the graph rows.
SESSION = "if(viewing_session_id = '', NULL, viewing_session_id)"
_IP = "if(client_ip IN ('', '-'), NULL, client_ip)"
_ACCOUNT = "if(account_id IN ('', '-'), NULL, account_id)"
_CONTENT = "if(content_id = '', NULL, content_id)"

RELATIONSHIPS: list[tuple[str, str, str, str, str]] = [
    ("MAKES_REQUEST", "ViewingSession", SESSION, "Request", "request_id"),
    ("HAS_VIEWING_SESSION", "Account", _ACCOUNT, "ViewingSession", SESSION),
    ("USES_CDN_TOKEN", "ViewingSession", SESSION, "CdnToken", "if(cdn_token_id = '', NULL, cdn_token_id)"),
    ("TARGETS_CONTENT", "ViewingSession", SESSION, "Content", _CONTENT),
    ("TARGETS_CONTENT", "Request", "request_id", "Content", _CONTENT),
    ("FROM_IP", "ViewingSession", SESSION, "ClientIP", _IP),
    ("ON_DEVICE", "ViewingSession", SESSION, "Device", "device_id"),
    ("SERVED_BY", "ViewingSession", SESSION, "Edge", "edge_id"),
    ("REFERRED_BY", "ViewingSession", SESSION, "Referrer", "referrer_domain"),
    ("FOR_SEGMENT", "Request", "request_id", "Segment", "segment.segment_id"),
]

EDGE_COLUMNS = ["src_type", "src", "type", "dst_type", "dst"]
EDGE_INPUTS = (
    "viewing_session_id", "request_id", "account_id", "cdn_token_id", "content_id", "client_ip",
    "device_id", "edge_id", "referrer_domain", "segment",
)

# Node label and the key that must be known for the node to exist.
NODE_KEYS: list[tuple[str, str]] = [
    ("Request", "request_id"),
    ("Content", _CONTENT),
    ("ViewingSession", SESSION),
    ("Account", _ACCOUNT),
    ("CdnToken", "if(cdn_token_id = '', NULL, cdn_token_id)"),
    ("ClientIP", _IP),
    ("Device", "device_id"),
    ("Edge", "edge_id"),
    ("Referrer", "referrer_domain"),
    ("Segment", "segment.segment_id"),
]


def edges(rows: DataFrame, type_: str, src_type: str | None = None) -> DataFrame:
    """Distinct (src, dst) pairs of one type; ``src_type`` picks one source label."""
    if type_ == "BELONGS_TO":
        return belongs_to(rows)
    ends = [
        F.struct(F.expr(src).alias("src"), F.expr(dst).alias("dst"))
        for name, src_label, src, _, dst in RELATIONSHIPS
        if name == type_ and src_type in (None, src_label)
    ]
    if not ends:
        raise ValueError(f"no relationship {type_!r} from {src_type!r}")
    return rows.select(F.inline(F.array(*ends))).where("src IS NOT NULL AND dst IS NOT NULL").distinct()


def belongs_partial(rows: DataFrame) -> DataFrame:
    """What ``belongs_result`` needs of these rows, in a form that merges.

    One record per segment and content (first and last order, and whether some row's own
    target is the content in its path) and one per content, with an empty segment.
    """
    seq = F.struct(*ORDER).alias("seq")
    own = F.expr("segment.content_id = content_id").alias("own")
    segment = F.when(
        F.expr("segment.content_id <> ''"),
        F.struct(F.expr("segment.segment_id").alias("src"), F.expr("segment.content_id").alias("dst"), seq, own),
    )
    content = F.when(
        F.expr("content_id <> ''"),
        F.struct(F.lit("").alias("src"), F.col("content_id").alias("dst"), seq, F.lit(False).alias("own")),
    )
    return (
        rows.select(F.inline(F.array(segment, content)))
        .where("dst IS NOT NULL")
        .groupBy("src", "dst")
        .agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.max("own").alias("own"))
    )


def belongs_merge(partials: DataFrame) -> DataFrame:
    return partials.groupBy("src", "dst").agg(
        F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"), F.max("own").alias("own")
    )


def belongs_result(seen: DataFrame) -> DataFrame:
    """Segment to content, only if the content node exists when the segment is seen.

    A segment row whose own target is the content in its path creates that node itself.  Only
    segments without such a row need the node's first time from other rows.
    """
    direct, other, contents = apart(seen, "src <> '' AND own", "src <> '' AND NOT own", "src = ''")
    late = (
        other.select("src", "dst", "last_seq")
        .join(contents.select("dst", "first_seq"), "dst")
        .where("last_seq >= first_seq")
    )
    return direct.select("src", "dst").unionByName(late.select("src", "dst"))


def belongs_to(rows: DataFrame) -> DataFrame:
    return belongs_result(belongs_partial(rows))


def _exploded(rows: DataFrame, structs: list[Column]) -> DataFrame:
    # Not F.filter: Spark would infer a filter from it that repeats all the expressions below.
    items = rows.select(F.inline(F.array(*structs)))
    return items.where(F.col(items.columns[1]).isNotNull()).distinct()


def pair_edges(rows: DataFrame) -> DataFrame:
    """Every relationship that one row alone decides, from one pass over the rows.

    Pairs travel with the place of their relationship in RELATIONSHIPS, which has no pair of names twice.
    """
    ends = []
    for place, (_, _, src, _, dst) in enumerate(RELATIONSHIPS):
        both = F.expr(f"({src}) IS NOT NULL AND ({dst}) IS NOT NULL")
        ends.append(F.when(both, F.struct(F.lit(place).alias("place"), F.expr(src).alias("src"), F.expr(dst).alias("dst"))))
    named = {
        column: F.element_at(F.array(*[F.lit(r[at]) for r in RELATIONSHIPS]), F.col("place") + 1).alias(column)
        for column, at in (("src_type", 1), ("type", 0), ("dst_type", 3))
    }
    return _exploded(rows, ends).select(*[named.get(column, column) for column in EDGE_COLUMNS])


def belongs_edges(pairs: DataFrame) -> DataFrame:
    return pairs.select(
        F.lit("Segment").alias("src_type"),
        "src",
        F.lit("BELONGS_TO").alias("type"),
        F.lit("Content").alias("dst_type"),
        "dst",
    )


def _belongs_structs(named: list[str]) -> list[Column]:
    """What a row says about segments and contents, in the columns of an edge with (seq, own)."""
    seq = F.struct(*ORDER).alias("seq")
    own = F.expr("segment.content_id = content_id").alias("own")

    def item(src: Column, dst: Column, own: Column) -> Column:
        ends = [F.lit("Segment").alias(named[0]), src.alias(named[1]), F.lit("BELONGS_TO").alias(named[2])]
        return F.struct(*ends, F.lit("Content").alias(named[3]), dst.alias(named[4]), seq, own.alias("own"))

    return [
        F.when(F.expr("segment.content_id <> ''"), item(F.expr("segment.segment_id"), F.expr("segment.content_id"), own)),
        F.when(F.expr("content_id <> ''"), item(F.lit(""), F.col("content_id"), F.lit(False))),
    ]


def _edges_and_segments(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges that one row decides, and the merged records of ``belongs_partial``: one parse, one shuffle."""
    order = rows.select(F.struct(*ORDER).alias("seq")).schema["seq"].dataType
    open_ = [F.lit(None).cast(order).alias("seq"), F.lit(None).cast("boolean").alias("own")]
    pairs = []
    for type_, src_type, src, dst_type, dst in RELATIONSHIPS:
        both = F.expr(f"({src}) IS NOT NULL AND ({dst}) IS NOT NULL")
        values = [F.lit(src_type), F.expr(src), F.lit(type_), F.lit(dst_type), F.expr(dst)]
        pairs.append(F.when(both, F.struct(*[v.alias(n) for v, n in zip(values, EDGE_COLUMNS, strict=True)], *open_)))
    items = rows.select(F.inline(F.array(*pairs, *_belongs_structs(list(EDGE_COLUMNS)))))
    items = items.where(F.col("type").isNotNull() & F.col("src").isNotNull() & F.col("dst").isNotNull())
    merged = items.groupBy(*EDGE_COLUMNS).agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.max("own").alias("own"))
    decided, segments = apart(merged, "type <> 'BELONGS_TO'", "type = 'BELONGS_TO'")
    return decided.select(*EDGE_COLUMNS), segments.select("src", "dst", "first_seq", "last_seq", "own")


def edges_unified(rows: DataFrame) -> DataFrame:
    """Every relationship as (src_type, src, type, dst_type, dst), from one pass over the rows."""
    decided, segments = _edges_and_segments(rows)
    return decided.unionByName(belongs_edges(belongs_result(segments)))


def graph_statistics(rows: DataFrame) -> DataFrame:
    """Node count per label and the number of relationships.

    The rows are written once, so that the log is parsed once for what a row decides and for the segments.
    """
    rows = materialize(rows.select("fold_ts", "arrival", *EDGE_INPUTS), "statistics-rows")
    nodes = [
        F.when(F.expr(key).isNotNull(), F.struct(
            F.lit(label).alias("name"), F.expr(key).alias("a"), F.lit(None).cast("string").alias("b")
        ))
        for label, key in NODE_KEYS
    ]
    relations = [
        F.when(F.expr(f"({src}) IS NOT NULL AND ({dst}) IS NOT NULL"), F.struct(
            F.concat(F.lit(f"{src_type}-{type_}")).alias("name"), F.expr(src).alias("a"), F.expr(dst).alias("b")
        ))
        for type_, src_type, src, _, dst in RELATIONSHIPS
    ]
    segment = belongs_to(rows).select(F.lit("Segment-BELONGS_TO").alias("name"), F.col("src").alias("a"), F.col("dst").alias("b"))
    items = _exploded(rows, nodes + relations).unionByName(segment)
    labels = [label for label, _ in NODE_KEYS]
    name = F.when(F.col("name").isin(labels), F.col("name")).otherwise("Relationships")
    return items.groupBy(name.alias("name")).agg(F.count("*").alias("count"))
