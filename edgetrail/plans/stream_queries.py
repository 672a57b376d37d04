"""Streaming forms of the folds and metrics, run over all available input."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.edges import EDGE_INPUTS
from ..operators.nodes import NODE_FOLDS
from ..operators.normalize import normalize_requests
from ..session import dealt, materialize, scratch_path
from ..sources import tail
from ..sources.sinks import read_partitioned, sink_partitioned
from ..streaming import graph_stream as gs
from ..streaming.batch_store import BatchStore
from . import inputs
from .graph_queries import NODE_CHECKS
from .oracle import NODES_AND_EDGES, over_norm, over_rows
from .registry import query


def _events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream, whether it is one file or a folder of files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    reader = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema)
    if folder:
        return reader.parquet(f"{sf_dir}/events.parquet")
    return reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def access_log_stream(spark: SparkSession, sf_dir: str, name: str = "access_log") -> DataFrame:
    dealt(_events_stream(spark, sf_dir)).createOrReplaceTempView("events")
    return spark.sql(inputs.SQL[name])


def _in_batches(spark: SparkSession, sf_dir: str, name: str, path: str) -> DataFrame:
    """A derived log, written as files of which a stream reads a quarter per batch."""
    cores = spark.sparkContext.defaultParallelism
    logs = inputs.load(spark, sf_dir, name, 4 * cores)
    if name == "delivered_log":  # not a partition for each one of the events
        logs = logs.repartition(4 * cores)
    logs.write.option("compression", "zstd").parquet(f"{path}/input")
    return spark.readStream.schema(logs.schema).option("maxFilesPerTrigger", cores).parquet(f"{path}/input")


def _finish(handle) -> None:
    handle.awaitTermination()


@query("stream_sessions", over_rows(NODE_CHECKS["ViewingSession"]))
def stream_sessions(spark, sf_dir):
    path = scratch_path(spark, "stream-sessions")
    logs = access_log_stream(spark, sf_dir)
    _finish(gs.stream_fold(logs, "ViewingSession", f"{path}/table", f"{path}/checkpoint"))
    return gs.read_fold(spark, "ViewingSession", f"{path}/table")


@query("stream_edges", over_rows("").rstrip() + "," + NODES_AND_EDGES + " SELECT * FROM pairs")
def stream_edges(spark, sf_dir):
    path = scratch_path(spark, "stream-edges")
    logs = access_log_stream(spark, sf_dir)
    _finish(gs.stream_edges(logs, EDGE_INPUTS, f"{path}/table", f"{path}/checkpoint"))
    return gs.read_edges(spark, f"{path}/table")


@query(
    "stream_metrics",
    over_norm("""SELECT date_trunc('hour', event_ts) AS window_start, count(*) AS requests, CAST(sum(size) AS BIGINT) AS bytes,
    count(*) FILTER (WHERE status >= 400) AS errors, count(*) FILTER (WHERE cache_status = 'HIT') AS hits FROM norm GROUP BY 1"""),
)
def stream_metrics(spark, sf_dir):
    path = scratch_path(spark, "stream-metrics")
    _finish(gs.stream_metrics(access_log_stream(spark, sf_dir), path, f"{path}/checkpoint"))
    return gs.read_metrics(spark, path)


@query("stream_dedup", over_norm("SELECT DISTINCT request_log_id FROM norm"))
def stream_dedup(spark, sf_dir):
    path = scratch_path(spark, "stream-dedup")
    _finish(gs.stream_unique(_in_batches(spark, sf_dir, "delivered_log", path), path, f"{path}/checkpoint"))
    return normalize_requests(gs.read_unique(spark, path), ["request_log_id"]).select("request_log_id")


def _digest(columns) -> str:
    """One text of all values, for Spark and DuckDB; a missing value is a tilde."""
    return "md5(concat_ws('|', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR(4000)), '~')" for c in columns) + "))"


def _columns(label: str) -> list[str]:
    fold = NODE_FOLDS[label]
    named = {*fold.first, *fold.last, *fold.last_known, *fold.sums, *fold.maxes, *fold.finish}
    return sorted(n for n in named if not n.startswith("_"))


_EDGE = _digest(["src_type", "dst_type", "dst"])
_CONTENT = " UNION ALL ".join(
    f"SELECT '{label}' AS name, {fold.key} AS id, {_digest(_columns(label))} AS content FROM ({NODE_CHECKS[label]}) t_{label}"
    for label, fold in NODE_FOLDS.items()
)


@query("stream_graph", over_rows("").rstrip() + "," + NODES_AND_EDGES + f" {_CONTENT} UNION ALL SELECT type, src, {_EDGE} FROM pairs")
def stream_graph(spark, sf_dir):
    """Every node and edge, with all its values, of the graph that a stream of several batches builds."""
    path = scratch_path(spark, "stream-graph")
    _finish(gs.stream_graph(_in_batches(spark, sf_dir, "access_log", path), path, f"{path}/checkpoint"))
    parts = [gs.read_edges(spark, f"{path}/edges").select(F.col("type").alias("name"), F.col("src").alias("id"), F.expr(_EDGE).alias("content"))]
    for label, fold in NODE_FOLDS.items():
        table = gs.read_fold(spark, label, f"{path}/nodes/{label}")
        parts.append(table.select(F.lit(label).alias("name"), F.col(fold.key).alias("id"), F.expr(_digest(_columns(label))).alias("content")))
    return reduce(DataFrame.unionByName, parts)


# --- batches that arrive one after the other -----------------------------------------------


def _thirds(logs: DataFrame, late: str) -> DataFrame:
    """The log with the batch (0 to 2) that delivers each record: by arrival, late ones a batch later."""
    last = logs.agg(F.max("arrival")).first()[0] or 0
    return logs.withColumn("batch", F.expr(f"CAST(least(2, floor(arrival * 3 / {last + 1}) + if({late}, 1, 0)) AS INT)"))


def _delivered(spark: SparkSession, logs: DataFrame, path: str, run, late: str = "false") -> None:
    """Add the records of each batch to a folder and run the stream over what is new in it."""
    dealt = materialize(_thirds(logs, late), "dealt")
    for batch in range(3):
        dealt.where(F.col("batch") == batch).drop("batch").write.mode("append").parquet(f"{path}/input")
        _finish(run(spark.readStream.schema(logs.schema).parquet(f"{path}/input")))


_BROKEN = "arrival % 50 = 7"


@query(
    "stream_late_rows",
    over_norm("").rstrip() + f""",
    d AS (SELECT *, CAST(least(2, floor(arrival * 3 / (SELECT max(arrival) + 1 FROM norm)) + CASE WHEN arrival % 10 = 3 THEN 1 ELSE 0 END) AS INT) AS batch FROM norm),
    m AS (SELECT edge_server, batch, max(fold_ts) AS newest FROM d WHERE NOT ({_BROKEN}) GROUP BY ALL)
    SELECT CASE WHEN {_BROKEN} THEN 'quarantine' WHEN fold_ts < (SELECT max(newest) FROM m WHERE m.edge_server = d.edge_server AND m.batch < d.batch) - INTERVAL 10 MINUTE
      THEN 'late' ELSE 'rows' END AS kept_in, request_log_id FROM d""",
)
def stream_late_rows(spark, sf_dir):
    """Which table each record of a log with broken and late records lands in; the last batch comes twice."""
    path = scratch_path(spark, "stream-late")
    logs = inputs.load(spark, sf_dir, "access_log")
    logs = logs.withColumn("raw", F.expr(f"if({_BROKEN}, '{{broken ' || arrival, raw)"))
    _delivered(spark, logs, path, lambda stream: gs.stream_split(stream, f"{path}/split", f"{path}/checkpoint"), "arrival % 10 = 3")
    store = BatchStore(spark, f"{path}/split")
    gs.split_batch(logs, store.snapshot()["batch"], f"{path}/split")
    parts = [store.read(t).select(F.lit(t).alias("kept_in"), "request_log_id") for t in ("rows", "late")]
    lost = store.read("quarantine").select(F.lit("quarantine").alias("kept_in"), F.regexp_extract("raw", "[0-9]+", 0).alias("request_log_id"))
    return parts[0].unionByName(parts[1]).unionByName(lost)


@query(
    "stream_sessions_closed",
    over_rows("""SELECT viewing_session_id, min(fold_ts) AS start_time, max(fold_ts) AS last_time, count(*) AS request_count,
      CAST(sum(bytes_sent) AS BIGINT) AS total_bytes FROM (
        SELECT *, sum(begins) OVER (PARTITION BY viewing_session_id ORDER BY fold_ts, arrival) AS visit FROM (
          SELECT *, CASE WHEN fold_ts - lag(fold_ts) OVER (PARTITION BY viewing_session_id ORDER BY fold_ts, arrival) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS begins FROM grows) b) v
    GROUP BY viewing_session_id, visit HAVING max(fold_ts) + INTERVAL 6 HOUR <= (SELECT max(fold_ts) FROM grows) - INTERVAL 12 HOUR"""),
)
def stream_sessions_closed(spark, sf_dir):
    """Visits that are over, each once, from a stream in several batches."""
    path = scratch_path(spark, "stream-visits")
    logs = inputs.load(spark, sf_dir, "access_log")
    _delivered(spark, logs, path, lambda stream: gs.stream_closed_visits(stream, f"{path}/visits", f"{path}/checkpoint", "6 hours", "12 hours"))
    found = BatchStore(spark, f"{path}/visits").read("visits")
    return found.select("viewing_session_id", "start_time", "last_time", "request_count", "total_bytes")


@query(
    "stream_partitioned",
    over_norm("SELECT service, CAST(fold_ts AS DATE) AS date, count(*) AS requests, CAST(sum(size) AS BIGINT) AS bytes FROM norm GROUP BY 1, 2", "shipped_log"),
)
def stream_partitioned(spark, sf_dir):
    """Requests by service and day, written by a stream whose last batch is delivered twice."""
    path = scratch_path(spark, "stream-partitioned")
    logs = _in_batches(spark, sf_dir, "shipped_log", path)
    _finish(gs.stream_partitioned(logs, f"{path}/table", f"{path}/checkpoint", ["size"]))
    again = read_partitioned(spark, f"{path}/table").where("batch = 0")
    sink_partitioned(again.drop("batch", "date"), f"{path}/table", batch=0)
    return read_partitioned(spark, f"{path}/table").groupBy("service", "date").agg(F.count("*").alias("requests"), F.sum("size").alias("bytes"))


# --- a log that grows ----------------------------------------------------------------------

_ROUNDS = 3


def _grow(dealt: DataFrame, folder: str, now: int) -> None:
    """Write each task's file with the lines of all rounds so far; in the last round one file is replaced.

    A retried task writes the same bytes again.
    """

    def write(parts):
        import pyarrow as pa
        from pyspark import TaskContext

        n = TaskContext.get().partitionId()
        system, base = tail.open_folder(folder)
        system.create_dir(base, recursive=True)
        only = n == 0 and now == _ROUNDS - 1
        with system.open_output_stream(f"{base}/edge-{n}.log") as out:
            for part in parts:
                for raw, turn in zip(part.column("raw").to_pylist(), part.column("turn").to_pylist(), strict=True):
                    if turn == now or turn < now and not only:
                        out.write(raw.encode() + b"\n")
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    dealt.select("raw", "turn").mapInArrow(write, "n bigint").count()


@query("stream_tail", over_norm("SELECT request_log_id, fold_ts, content_path, status FROM norm"))
def stream_tail(spark, sf_dir):
    """Requests of files that grow between batches, one of which is replaced by a shorter one at the end."""
    path = scratch_path(spark, "stream-tail")
    logs = inputs.load(spark, sf_dir, "access_log").withColumn("turn", F.expr(f"arrival % {_ROUNDS}"))
    dealt = logs.repartition(spark.sparkContext.defaultParallelism, "arrival").sortWithinPartitions("turn", "arrival")
    wanted = ["request_log_id", "content_path", "status"]
    for now in range(_ROUNDS):
        _grow(dealt, f"{path}/logs", now)
        stream = normalize_requests(tail.stream_growing_log(spark, f"{path}/logs"), wanted)
        writer = stream.writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/rows/b{n}"))
        _finish(writer.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start())
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/rows").select("fold_ts", *wanted)
