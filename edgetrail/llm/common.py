"""Helpers that several operators share: the shared folder, written tables and Arrow batches."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from edgetrail.llm.shingles import forget

ROWS_PER_BATCH = 512
ROW_GROUP_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master, whose executors
    live in the driver's process, may do without that setting; it gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="edgetrail-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/edgetrail-llm/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: it survives lost executors and is computed once."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors' Python workers, once for each application."""
    sc = spark.sparkContext
    package = Path(__file__).resolve().parents[1]
    if not getattr(sc, "_edgetrail_shipped", False):
        archive = Path(tempfile.mkdtemp(prefix="edgetrail-")) / "edgetrail_shipped.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        sc.addPyFile(str(archive))
        sc._edgetrail_shipped = True
    return spark


def release(spark: SparkSession) -> None:
    """Remove everything this application wrote to the shared folder. Call it once results are read."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def trim() -> None:
    """Give freed memory back to the system: a Python worker lives on, and the next stage's tasks run beside others."""
    pa.default_memory_pool().release_unused()
    returned = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only
    if returned:
        returned(0)


def tidied(run: Callable) -> Callable:
    """run, a function for mapInArrow, whose worker keeps neither words nor freed memory after a task."""

    @functools.wraps(run)
    def whole(parts):
        try:
            yield from run(parts)
        finally:
            forget()
            trim()

    return whole


def batches(rows: Iterator[tuple], schema: pa.Schema, size: int = ROWS_PER_BATCH) -> Iterator[pa.RecordBatch]:
    """Row tuples as Arrow batches of a bounded number of rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def slices(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of a few hundred rows at most, so that few texts are Python objects at once."""
    for batch in parts:
        for at in range(0, batch.num_rows, ROWS_PER_BATCH):
            yield batch.slice(at, ROWS_PER_BATCH)


def rows_of(parts: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """The named columns of each row, a few hundred rows at a time."""
    for batch in parts:
        for at in range(0, batch.num_rows, ROWS_PER_BATCH):
            piece = batch.slice(at, ROWS_PER_BATCH)
            yield from zip(*(piece.column(n).to_pylist() for n in names), strict=True)
