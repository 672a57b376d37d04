"""Tables of a running stream: immutable folders of records and snapshots that list them.

A batch writes its records into new folders and becomes visible by one small file, the snapshot,
which appears whole or not at all.  A batch whose snapshot exists is not written again, so the
snapshots are also the ledger of what was processed.  Readers take one snapshot and see all tables
as of the same batch, whatever the stream writes meanwhile.

Folders are merged by the batches themselves, like the digits of a binary counter: a new batch takes
up as many of the newest folders as cover the same number of batches each.  After n batches a table
has at most log2(n) + 1 folders, and each record is rewritten at most log2(n) times.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Collection
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

Merge = Callable[[DataFrame], DataFrame]
SNAPSHOTS = "_snapshots"
# Snapshots that stay readable after newer ones; folders only older ones list are removed.
KEPT = 8
WRITERS = 4


class BatchStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- files -----------------------------------------------------------------------------

    def _names(self, folder: str) -> list[str]:
        place = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(place)) if self._fs.exists(place) else []

    def _text(self, file: str) -> str:
        stream = self._fs.open(self._path(file))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _publish(self, file: str, text: str) -> bool:
        """Write a file whole under its name; False if the name is taken."""
        hidden = f"{self.path}/{SNAPSHOTS}/.{uuid.uuid4().hex}"
        stream = self._fs.create(self._path(hidden))
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        done = not self._fs.exists(self._path(file)) and self._fs.rename(self._path(hidden), self._path(file))
        if not done:
            self._fs.delete(self._path(hidden), False)
        return done

    # --- snapshots -------------------------------------------------------------------------

    def batches(self) -> list[int]:
        """Batches whose snapshots are kept, oldest first."""
        return [int(n.removesuffix(".json")) for n in self._names(f"{self.path}/{SNAPSHOTS}") if n.endswith(".json") and not n.startswith(".")]

    def snapshot(self, batch: int | None = None) -> dict | None:
        """A kept snapshot, the newest by default."""
        if batch is None:
            kept = self.batches()
            if not kept:
                return None
            batch = kept[-1]
        return json.loads(self._text(f"{self.path}/{SNAPSHOTS}/{batch:012d}.json"))

    def has(self, batch: int) -> bool:
        """Whether this batch, or a later one, is already part of the tables."""
        newest = self.snapshot()
        return newest is not None and newest["batch"] >= batch

    def folders(self, table: str, batch: int | None = None) -> list[str]:
        newest = self.snapshot(batch)
        return [f"{self.path}/{table}/{f}" for _, f in newest["tables"][table]["folders"]] if newest and table in newest["tables"] else []

    def read(self, table: str, batch: int | None = None) -> DataFrame | None:
        """The table's records as of a snapshot, None before it has any; partial records are not merged."""
        newest = self.snapshot(batch)
        if newest is None or table not in newest["tables"]:
            return None
        return self._open(table, newest["tables"][table])

    def _open(self, table: str, entry: dict, last: int | None = None) -> DataFrame:
        folders = entry["folders"] if last is None else entry["folders"][-last:]
        schema = T.StructType.fromJson(entry["schema"])
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{table}/{f}" for _, f in folders])

    # --- writing ---------------------------------------------------------------------------

    def commit(
        self, batch: int, tables: dict[str, DataFrame], merges: dict[str, Merge] | None = None, staged: Collection[str] = ()
    ) -> bool:
        """Add one batch to the tables, all or none; False if it is there already.

        ``merges`` names the function that combines records of several batches; without one they
        are kept side by side.  The new records of ``staged`` tables are written before they meet older ones, for
        merges that read their input twice.
        """
        old = self.snapshot()
        if old is not None and old["batch"] >= batch:
            return False
        entries = dict(old["tables"]) if old else {}

        def add(item: tuple[str, DataFrame]) -> tuple[str, dict]:
            table, new = item
            entry = entries.get(table, {"folders": [], "schema": json.loads(new.schema.json())})
            taken, size = 0, 1
            for n, _ in reversed(entry["folders"]):
                if n != size:
                    break
                taken, size = taken + 1, size + n
            if taken and table in staged:
                # No snapshot lists this folder, so it is removed with the others.
                path = f"{self.path}/{table}/{batch:012d}-{uuid.uuid4().hex[:8]}"
                new.write.mode("errorifexists").option("compression", "zstd").parquet(path)
                new = self.spark.read.schema(T.StructType.fromJson(entry["schema"])).parquet(path)
            if taken:
                new = self._open(table, entry, taken).unionByName(new)
                new = merges[table](new) if merges and table in merges else new
            folder = f"{batch:012d}-{uuid.uuid4().hex[:8]}"
            new.write.mode("errorifexists").option("compression", "zstd").parquet(f"{self.path}/{table}/{folder}")
            kept = entry["folders"][: len(entry["folders"]) - taken]
            return table, {"folders": [*kept, [size, folder]], "schema": entry["schema"]}

        with ThreadPoolExecutor(WRITERS) as writers:
            entries.update(writers.map(add, tables.items()))
        text = json.dumps({"batch": batch, "tables": entries})
        done = self._publish(f"{self.path}/{SNAPSHOTS}/{batch:012d}.json", text)
        if done:
            self._clean()
        return done

    def _clean(self) -> None:
        """Remove old snapshots, and folders that no kept snapshot lists (those of failed tries too)."""
        known = self.batches()
        for batch in known[:-KEPT]:
            self._fs.delete(self._path(f"{self.path}/{SNAPSHOTS}/{batch:012d}.json"), False)
        listed: dict[str, set[str]] = {}
        for batch in known[-KEPT:]:
            for table, entry in self.snapshot(batch)["tables"].items():
                listed.setdefault(table, set()).update(f for _, f in entry["folders"])
        for table, names in listed.items():
            for name in self._names(f"{self.path}/{table}"):
                if name not in names:
                    self._fs.delete(self._path(f"{self.path}/{table}/{name}"), True)


def store_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path`` if it belongs to a batch store above it, else None."""
    parts = path.rstrip("/").split("/")
    for up in (1, 2):
        root, table = "/".join(parts[:-up]), "/".join(parts[-up:])
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{SNAPSHOTS}")
        if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            return BatchStore(spark, root).read(table)
    return None
