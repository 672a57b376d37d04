"""Reading raw access logs, API events and origin logs, in batch or as a stream.

The raw readers return ``raw`` (one JSON text per row) and ``arrival``, which orders records
with equal timestamps the way they lie in the input.
"""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

CORRUPT = "_corrupt"


def _arrival() -> Column:
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def read_access_log(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """JSON lines; blank lines are dropped, malformed ones leave through ``quarantine``."""
    paths = [path] if isinstance(path, str) else list(path)
    lines = spark.read.text(paths)
    return lines.select(F.col("value").alias("raw"), _arrival().alias("arrival")).where(F.trim("raw") != "")


def stream_access_log(spark: SparkSession, path: str, max_files_per_batch: int = 1000) -> DataFrame:
    """New files of a folder as a stream; the query's checkpoint keeps the position.

    A stream has no row position inside a file, so ties are ordered by file and text.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", max_files_per_batch).text(path)
    arrival = F.struct(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    return lines.select(F.col("value").alias("raw"), arrival.alias("arrival")).where(F.trim("raw") != "")


def read_index(
    spark: SparkSession,
    patterns: Sequence[str],
    from_ts: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Records of several path patterns, each file once, from a time on, oldest first.

    ``limit`` is the page size of a poll; leave it out to read everything.
    """
    files = spark.read.text(list(patterns)).inputFiles()  # distinct, however many patterns name a file
    logs = read_access_log(spark, sorted(unquote(f) for f in files))
    stamp = F.get_json_object("raw", "$['@timestamp']")
    logs = logs.withColumn("index_ts", F.try_to_timestamp(F.coalesce(stamp, F.get_json_object("raw", "$.timestamp"))))
    return index_page(logs, from_ts, limit)


def index_page(logs: DataFrame, from_ts: str | None, limit: int | None, order: str = "arrival") -> DataFrame:
    """Rows at or after a time in (time, arrival) order, optionally one page of them."""
    if from_ts is not None:
        logs = logs.where(F.col("index_ts") >= F.lit(from_ts).cast("timestamp"))
    if limit is not None:
        logs = logs.orderBy(F.col("index_ts").asc_nulls_last(), order).limit(limit)
    return logs


def read_api_events(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """API events with typed values."""
    fields = schemas.API_EVENT_FIELDS + schemas.EDGE_LOG_FIELDS
    return spark.read.schema(schemas.text_struct(fields, schemas.API_EVENT_TYPES)).json(path)


def read_origin_log(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return spark.read.schema(schemas.text_struct(schemas.ORIGIN_LOG_FIELDS)).json(path)


def parse_ship_timestamp(col: Column) -> Column:
    """ISO-8601 with offset, with or without a fraction, as an instant; else NULL."""
    shape = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
    return F.when(col.rlike(shape), F.try_to_timestamp(col))


def input_name(key: str) -> str:
    return "in_" + key.replace("@", "at_").replace(".", "_")


def _body(text: Column) -> Column:
    """Text of a JSON object without its braces, NULL if nothing is in it."""
    inside = F.btrim(F.regexp_extract(text, r"(?s)^\s*\{(.*)\}\s*$", 1))
    return F.when(inside != "", inside)


def merge_envelope(logs: DataFrame, raw: str) -> DataFrame:
    """Records with what is nested under ``json`` or written as text in ``message`` merged in.

    Only an object under ``json`` counts, and blanks around the text in ``message`` do not matter.
    The outer record goes last: for a repeated key the JSON reader keeps the last value.  The
    nested parts are looked for only in texts that name them, so plain records cost two
    substring searches.
    """
    text, nested, message = F.col(raw), F.col("_nested"), F.col("_message")
    step = logs.withColumns(
        {
            "_nested": F.when(text.rlike(r'"json"\s*:\s*\{'), F.get_json_object(text, "$.json")),
            "_message": F.when(text.contains('"message"'), F.trim(F.get_json_object(text, "$.message"))),
        }
    )
    has_path = F.coalesce(
        F.get_json_object(text, "$.request_uri"), F.get_json_object(nested, "$.request_uri")
    ).isNotNull()
    usable = message.startswith("{") & ~has_path & F.try_parse_json(message).isNotNull()
    step = step.withColumns(
        {"_nested": _body(F.when(nested.startswith("{"), nested)), "_message": _body(F.when(usable, message))}
    )
    merged = F.concat(F.lit("{"), F.concat_ws(",", message, nested, _body(text)), F.lit("}"))
    enveloped = F.coalesce(nested, message).isNotNull() & _body(text).isNotNull()
    return step.withColumn(raw, F.when(enveloped, merged).otherwise(text)).drop("_nested", "_message")


def parse_records(logs: DataFrame, keys: Sequence[str], raw: str = "raw") -> DataFrame:
    """Parse ``raw`` and return the wanted keys as text columns named by ``input_name``.

    A record may lie at top level, under a nested object ``json`` or as JSON text in
    ``message``; on a clash the outer record wins.  Only the wanted keys are kept.  The other
    input columns stay, and ``_corrupt`` holds the text of malformed records.

    The parse is an ``inline``: a filter above it is not rewritten into a second parse.
    """
    keys = list(dict.fromkeys(keys))
    rest = [c for c in logs.columns if c != raw]
    schema = schemas.text_struct([*keys, CORRUPT])
    record = F.from_json(F.col(raw), schema, {"columnNameOfCorruptRecord": CORRUPT})
    return merge_envelope(logs, raw).select(*rest, F.inline(F.array(record)).alias(*[input_name(k) for k in keys], CORRUPT))
