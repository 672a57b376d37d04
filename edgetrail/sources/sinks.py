"""Writing logs, graphs and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import edges, nodes
from ..session import materialize


COMMITTED = "_committed"


def sink_partitioned(requests: DataFrame, path: str, time: str = "fold_ts", batch: int | str | None = None) -> None:
    """Add requests to folders by service and day, the layout reports prune by.

    ``rebalance`` deals rows to files of even size by what the shuffle measured, so a service with
    most of the traffic is written by as many tasks as it needs.  With ``batch`` (letters, digits,
    ``-`` or ``_``) a repeated batch leaves its rows once: its folder is replaced until its marker
    exists, and afterwards nothing is written.  ``read_partitioned`` reads marked batches only.
    """
    rows = requests.withColumn("date", F.to_date(time)).hint("rebalance", "service", "date")
    if batch is None:
        rows.write.mode("append").partitionBy("service", "date").parquet(path)
        return
    jvm = requests.sparkSession._jvm
    marker = jvm.org.apache.hadoop.fs.Path(f"{path}/{COMMITTED}/{batch}")
    fs = marker.getFileSystem(requests.sparkSession._jsc.hadoopConfiguration())
    if not fs.exists(marker):
        rows.write.mode("overwrite").partitionBy("service", "date").parquet(f"{path}/batch={batch}")
        fs.mkdirs(marker.getParent())
        fs.create(marker, True).close()


def read_partitioned(spark: SparkSession, path: str) -> DataFrame | None:
    """Rows of all committed batches, with ``batch``, ``service`` and ``date``; None if there are none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{COMMITTED}")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(f.getPath().getName() for f in fs.listStatus(folder)) if fs.exists(folder) else []
    return spark.read.option("basePath", path).parquet(*[f"{path}/batch={n}" for n in names]) if names else None


def sink_graph(rows: DataFrame, path: str) -> dict[str, int]:
    """Write every node and edge table of a graph; a rerun replaces the tables.

    The graph rows are written once as columns, so the ten folds read only the columns they
    fold and the log is parsed once.
    """
    stored = materialize(rows, "graph-rows")
    for label in nodes.NODE_FOLDS:
        nodes.nodes(stored, label).write.mode("overwrite").parquet(f"{path}/nodes/{label}")
    edges.edges_unified(stored).write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")
    written = stored.sparkSession.read.parquet(f"{path}/edges")
    counts = {r["type"]: r["count"] for r in written.groupBy("type").count().collect()}
    for label in nodes.NODE_FOLDS:
        counts[label] = stored.sparkSession.read.parquet(f"{path}/nodes/{label}").count()
    return counts


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def export_csv(df: DataFrame, path: str) -> None:
    """Nested values are written as JSON text: CSV has no place for them."""
    nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")]
    df.withColumns({n: F.to_json(n) for n in nested}).write.mode("overwrite").csv(path, header=True)
