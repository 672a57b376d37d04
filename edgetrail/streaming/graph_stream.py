"""The log as a stream: graph folds, session totals, metrics, duplicates and late rows.

Every batch writes its own partial records under its batch number, and readers merge them.
A batch costs what it brings, and a batch that is repeated after a failure replaces its own
folder, so totals do not count it twice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.edges import EDGE_COLUMNS, belongs_edges, belongs_merge, belongs_partial, belongs_result, pair_edges
from ..operators.folds import Fold
from ..operators.graph_rows import graph_rows, request_columns, rows_of_requests
from ..operators.joins import BROADCAST_ROWS
from ..operators.nodes import NODE_FOLDS, NODE_INPUTS
from ..operators.normalize import classify_records, normalize_requests, quarantine
from ..sources.sinks import sink_partitioned
from .batch_store import BatchStore, store_table

Sink = Callable[[DataFrame, int], None]


def _start(stream: DataFrame, sink: Sink, checkpoint: str, every: str | None) -> StreamingQuery:
    """Run ``sink`` per batch; the position is committed only after the sink has returned.

    ``every`` is the pause between batches; without it all available input is processed once.
    """
    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def _write_batch(df: DataFrame, path: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch}")


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """Records of all batches: of a batch store's newest snapshot, or of plain folders by batch."""
    stored = store_table(spark, path)
    return spark.read.parquet(path) if stored is None else stored


def stream_unique(logs: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Raw records once per request id, and the records that cannot be read.

    Each batch writes its records, one per id, and its quarantine; ``read_unique`` removes the
    repeats of other batches.  Without a watermark no late or untimed record is lost, and no
    state grows.  Records without an id are known by their own text.
    """

    def write(df: DataFrame, batch: int) -> None:
        requests = normalize_requests(df.withColumn("_text", F.col("raw")), ["request_log_id"])
        key = F.when(F.col("request_log_id").isin("", "-"), F.col("_text")).otherwise(F.col("request_log_id"))
        first = F.min(F.struct("arrival", F.col("_text").alias("raw")))
        _write_batch(requests.groupBy(key.alias("key")).agg(first.alias("kept")), f"{path}/rows", batch)
        _write_batch(quarantine(df), f"{path}/quarantine", batch)

    return _start(logs, write, checkpoint, every)


def read_unique(spark: SparkSession, path: str) -> DataFrame:
    """``raw`` and ``arrival`` of the first record of each id, over all batches."""
    first = F.min(F.struct("batch_id", "kept")).alias("first")
    kept = read_batches(spark, f"{path}/rows").groupBy("key").agg(first)
    return kept.select("first.kept.raw", "first.kept.arrival")


def read_quarantine(spark: SparkSession, path: str) -> DataFrame:
    return read_batches(spark, f"{path}/quarantine")


# Records are combined if at most this share of them is left.
FEWER = 0.75


def _fewer(rows: DataFrame, keys: dict[str, Column]) -> set[str]:
    """Which of these keys have clearly fewer values than the rows that have them, by one estimate over all rows."""
    counts = [F.struct(F.count(k).alias("rows"), F.approx_count_distinct(k).alias("values")).alias(n) for n, k in keys.items()]
    found = rows.agg(*counts).first()
    return {n for n in keys if found[n]["values"] <= FEWER * found[n]["rows"]}


def _where_fewer(key: Column, merge: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """``merge`` for records whose keys repeat; others stay side by side, as readers merge anyway."""
    return lambda records: merge(records) if _fewer(records, {"key": key}) else records


def stream_graph(logs: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """All node tables, the edges and the quarantine of a stream, from one parse per batch.

    The graph rows of a batch, and the texts of the records that give none, are written once, read by every fold, and
    replaced by those of the next.  All tables are committed together as one snapshot of a batch store, which also merges
    older batches as it goes; ``read_fold``, ``read_edges`` and ``read_quarantine`` read the newest one and merge what is left.

    Records are only shuffled to be combined where that leaves clearly fewer (``_fewer``): a request's node
    is that of one row, so it is stored as it is and meets its repeats when the table is read.
    """

    def write(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        store = BatchStore(spark, path)
        if store.has(batch):
            return
        broken = F.col("reason").isNotNull()
        records = classify_records(df, request_columns()).withColumn("raw", F.when(broken, F.col("raw")))
        found = rows_of_requests(records, ["arrival", "raw", "reason"], also=broken)
        found.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/rows")
        found = spark.read.parquet(f"{path}/rows")
        rows = found.where(~broken).drop("raw", "reason")
        fewer = _fewer(rows, {label: fold.key_of() for label, fold in NODE_FOLDS.items()})
        tables = {f"nodes/{label}": (fold.partial if label in fewer else fold.single)(rows) for label, fold in NODE_FOLDS.items()}
        merges = {f"nodes/{label}": _where_fewer(F.col(fold.key), fold.merge) for label, fold in NODE_FOLDS.items()}
        tables |= {"edges/pairs": pair_edges(rows), "edges/segments": belongs_partial(rows)}
        merges |= {"edges/pairs": _where_fewer(F.xxhash64(*EDGE_COLUMNS), DataFrame.distinct), "edges/segments": belongs_merge}
        store.commit(batch, tables | {"quarantine": found.where(broken).select("raw", "reason")}, merges, ["edges/pairs"])

    return _start(logs, write, checkpoint, every)


def _newest_by_source(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source").agg(F.max("newest").alias("newest"))


def split_batch(df: DataFrame, batch: int, path: str, delay: str = "10 minutes", source: str = "edge_server") -> bool:
    """Sort one batch of raw records into rows, late rows and quarantine; False if that was done before.

    A row is late if it is older than the newest time its source had sent in earlier batches by
    more than ``delay``.  Each source has its own mark, so a slow edge is not late because others
    are ahead; the marks are one record per source.  Every record lands in exactly one table.
    """
    spark = df.sparkSession
    store = BatchStore(spark, path)
    if store.has(batch):
        return False
    records = classify_records(df, list(dict.fromkeys([source, "request_log_id"])))
    records.withColumn("source", F.col(source)).write.mode("overwrite").parquet(f"{path}/records")
    records = spark.read.parquet(f"{path}/records")
    readable = records.where("reason IS NULL").drop("reason")
    marks = store.read("marks")
    if marks is None:
        rows, late = readable, readable.where("false")
    else:
        known = _newest_by_source(marks).select("source", F.col("newest").alias("_newest"))
        marked = readable.join(known, "source", "left")
        is_late = F.coalesce(F.col("fold_ts") < F.col("_newest") - F.expr(f"INTERVAL {delay}"), F.lit(False))
        rows, late = (marked.where(w).select(*readable.columns) for w in (~is_late, is_late))
    tables = {
        "rows": rows,
        "late": late,
        "quarantine": records.where("reason IS NOT NULL").select("raw", "reason"),
        "marks": readable.groupBy("source").agg(F.max("fold_ts").alias("newest")),
    }
    return store.commit(batch, tables, {"marks": _newest_by_source})


def stream_split(
    logs: DataFrame, path: str, checkpoint: str, delay: str = "10 minutes", source: str = "edge_server", every: str | None = None
) -> StreamingQuery:
    """``split_batch`` on every batch: tables ``rows``, ``late`` and ``quarantine`` in one store.

    The store's snapshots are the ledger of processed batches: a batch that is delivered again after
    a failure changes nothing, and readers see the three tables as of the same batch.
    """
    return _start(logs, lambda df, batch: split_batch(df, batch, path, delay, source), checkpoint, every)


def stream_partitioned(logs: DataFrame, path: str, checkpoint: str, columns: Sequence[str] | None = None, every: str | None = None) -> StreamingQuery:
    """Normalized requests of a stream in folders by service and day, each batch once."""
    requests = normalize_requests(logs, list(dict.fromkeys([*columns, "service"])) if columns else None)
    return _start(requests, lambda df, batch: sink_partitioned(df, path, batch=batch), checkpoint, every)


VISIT = NODE_FOLDS["ViewingSession"]


def visits(logs: DataFrame, idle: str = "30 minutes") -> DataFrame:
    """Viewing sessions cut where nothing was requested for ``idle``: one record per visit.

    For a batch of logs, or for a stream whose rows carry a watermark (``closed_visits``).
    """
    return _visits(graph_rows(logs, NODE_INPUTS["ViewingSession"]), idle)


def _visits(rows: DataFrame, idle: str) -> DataFrame:
    cut = VISIT.partial(rows, F.session_window("fold_ts", idle).alias("visit"))
    return VISIT.result(cut.withColumn("closes_at", F.col("visit.end")), "closes_at")


def closed_visits(logs: DataFrame, idle: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Each visit of a stream once, when it is over (append mode).

    The state holds the open visits as merged aggregates, not their rows.  A visit is over when the
    stream's newest time lies ``delay`` behind its end.  Rows later than that are not in any visit;
    ``stream_split`` keeps such rows in a table of their own.
    """
    return _visits(graph_rows(logs, NODE_INPUTS["ViewingSession"]).withWatermark("fold_ts", delay), idle)


def stream_closed_visits(
    logs: DataFrame, path: str, checkpoint: str, idle: str = "30 minutes", delay: str = "10 minutes", every: str | None = None
) -> StreamingQuery:
    """``closed_visits`` into the table ``visits`` of a batch store, so a repeated batch adds nothing."""

    def write(df: DataFrame, batch: int) -> None:
        BatchStore(df.sparkSession, path).commit(batch, {"visits": df})

    return _start(closed_visits(logs, idle, delay), write, checkpoint, every)


def stream_fold(
    logs: DataFrame, label: str, path: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Fold a stream into one node table, kept as partial records per batch."""
    fold = NODE_FOLDS[label]
    rows = graph_rows(logs, NODE_INPUTS[label])
    return _start(rows, lambda df, batch: _write_batch(fold.partial(df), path, batch), checkpoint, every)


def read_fold(spark: SparkSession, label: str, path: str) -> DataFrame:
    """Finished records of a streamed node table: the batches' partial records merged."""
    fold: Fold = NODE_FOLDS[label]
    partials = read_batches(spark, path).drop("batch_id")
    return fold.result(_merged(fold, partials)).drop("_username", "_user_id")


def _merged(fold: Fold, partials: DataFrame) -> DataFrame:
    """``fold.merge``; where few keys come several times, only their records are shuffled, and of the others the keys."""
    if _fewer(partials, {"key": F.col(fold.key)}):
        return fold.merge(partials)
    often = F.col("_often")
    repeated = partials.groupBy(F.col(fold.key).alias("_key")).agg(F.count("*").alias("_n")).where("_n > 1")
    repeated = repeated.select("_key", F.lit(True).alias("_often"))
    if repeated.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return fold.merge(partials)
    marked = partials.join(F.broadcast(repeated), F.col(fold.key).eqNullSafe(F.col("_key")), "left")
    alone, again = marked.where(often.isNull()), marked.where(often)
    return alone.select(partials.columns).unionByName(fold.merge(again.select(partials.columns)))


def compact_fold(spark: SparkSession, label: str, path: str, target: str) -> None:
    """Merge all batches of a node table into one partial table at another place.

    ``read_fold`` and later merges read it like any batch; run it while the stream is stopped.
    """
    merged = NODE_FOLDS[label].merge(read_batches(spark, path).drop("batch_id"))
    merged.write.mode("errorifexists").parquet(f"{target}/batch_id=0")


def stream_edges(logs: DataFrame, columns: Sequence[str], path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Edges of each batch, and what the segment-content edges need to be decided later.

    The rows of a batch are written once, so that the log is parsed once, and replaced by those of the next.
    """
    rows = graph_rows(logs, columns)

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/rows")
        kept = df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows")
        _write_batch(pair_edges(kept), f"{path}/pairs", batch)
        _write_batch(belongs_partial(kept), f"{path}/segments", batch)

    return _start(rows, write, checkpoint, every)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """All edges so far: repeats across batches removed, segments joined with their contents."""
    pairs = read_batches(spark, f"{path}/pairs").drop("batch_id").distinct()
    segments = belongs_merge(read_batches(spark, f"{path}/segments").drop("batch_id"))
    return pairs.unionByName(belongs_edges(belongs_result(segments)))


def stream_metrics(
    logs: DataFrame, path: str, checkpoint: str, bucket: str = "1 hour", delay: str = "10 minutes",
    every: str | None = None,
) -> StreamingQuery:
    """Requests, bytes, errors and cache hits per window, of each batch.

    Also notes, per batch, its newest time and how many rows were older than the newest time
    of earlier batches by more than ``delay``.  Such late rows are counted, not dropped.
    """
    spark = logs.sparkSession
    requests = normalize_requests(logs, ["event_ts", "size", "status", "cache_status"])

    def write(df: DataFrame, batch: int) -> None:
        window = F.window("event_ts", bucket)
        counts = df.groupBy(window.alias("w")).agg(
            F.count("*").alias("requests"),
            F.sum("size").alias("bytes"),
            F.count_if(F.col("status") >= 400).alias("errors"),
            F.count_if(F.col("cache_status") == "HIT").alias("hits"),
        )
        # No rows, no windows: an empty batch leaves an empty folder of the same schema.
        _write_batch(counts.select(F.col("w.start").alias("window_start"), "requests", "bytes", "errors", "hits"), f"{path}/windows", batch)
        newest = _newest_before(spark, f"{path}/progress", batch)
        late = F.count_if(F.col("event_ts") < F.lit(newest) - F.expr(f"INTERVAL {delay}")) if newest else F.lit(0)
        so_far = F.greatest(F.max("event_ts"), F.lit(newest).cast("timestamp")).alias("newest_so_far")
        progress = df.agg(F.max("event_ts").alias("newest"), F.count("*").alias("rows"), late.cast("bigint").alias("late_rows"), so_far)
        _write_batch(progress, f"{path}/progress", batch)

    return _start(requests, write, checkpoint, every)


def _newest_before(spark: SparkSession, path: str, batch: int):
    """Newest time of all earlier batches, which the batch before noted; NULL for the first batch."""
    return spark.read.parquet(f"{path}/batch_id={batch - 1}").first()["newest_so_far"] if batch else None


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    parts = read_batches(spark, f"{path}/windows")
    return parts.groupBy("window_start").agg(*[F.sum(c).alias(c) for c in ("requests", "bytes", "errors", "hits")])


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    return read_batches(spark, f"{path}/progress")


def windowed_counts(logs: DataFrame, bucket: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Requests per window as a streaming aggregate with a watermark, for append or update mode."""
    requests = normalize_requests(logs, ["event_ts", "size"])
    counted = requests.withWatermark("event_ts", delay).groupBy(F.window("event_ts", bucket).alias("w"))
    return counted.agg(F.count("*").alias("requests"), F.sum("size").alias("bytes")).select(
        F.col("w.start").alias("window_start"), "requests", "bytes"
    )


def session_totals(logs: DataFrame) -> DataFrame:
    """Running totals per session as a streaming aggregate, for update or complete mode."""
    rows = graph_rows(logs, ["viewing_session_id", "bytes_sent", "request_kind"])
    return rows.groupBy("viewing_session_id").agg(
        F.count("*").alias("requests"),
        F.sum("bytes_sent").alias("bytes"),
        F.count_if(F.col("request_kind") == "hls_segment").alias("segments"),
    )
