"""Following log files that grow: a streaming source whose position is a number of bytes per file.

Spark's own file source reads a file once and never sees lines appended to it.  Here each file's
position is the end of its last complete line, and a mark of its first line.  A file that became
shorter, or whose first line changed, was cut or replaced and is read from its start.  A last line
without its end waits for the next batch.  A batch is read in splits of bounded size, so one large
file is read by many tasks, and a repeated batch reads the same bytes.

Files are listed and read through pyarrow's file systems (a mounted folder, hdfs, s3 or gs).
"""

from __future__ import annotations

import fnmatch
import sys
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

BLOCK = 1 << 20
MARK_BYTES = 4096
SPLIT_BYTES = 64 << 20
_LINES = pa.schema([("raw", pa.string()), ("file", pa.string()), ("at", pa.int64())])


class Split(InputPartition):
    """Lines of a file that start in [start, end)."""

    def __init__(self, file: str, start: int, end: int):
        self.file, self.start, self.end = file, start, end


def open_folder(folder: str):
    """The file system of a path and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def last_line_end(file, size: int) -> int:
    """The byte after the last line end before ``size``, 0 if there is none; read backwards in blocks."""
    at = size
    while at > 0:
        start = max(0, at - BLOCK)
        file.seek(start)
        found = file.read(at - start).rfind(b"\n")
        if found >= 0:
            return start + found + 1
        at = start
    return 0


def first_line_mark(file) -> str:
    """A mark of the first line, or of its first bytes; it stays the same while a file only grows."""
    file.seek(0)
    return f"{zlib.crc32(file.read(MARK_BYTES).split(b'\n', 1)[0]):08x}"


def changed_ranges(start: dict, end: dict) -> Iterator[tuple[str, int, int]]:
    """What is new between two positions: a file's added bytes, or all of a file that was cut or replaced."""
    for file, now in sorted(end.items()):
        before = start.get(file)
        kept = before is not None and before["mark"] == now["mark"] and before["at"] <= now["at"]
        begin = before["at"] if kept else 0
        if begin < now["at"]:
            yield file, begin, now["at"]


def lines_of(file, split_start: int, split_end: int) -> Iterator[tuple[bytes, int]]:
    """Lines that start in [split_start, split_end), each with its position, without its end."""
    at = split_start
    file.seek(max(0, split_start - 1))
    rest = b""
    if split_start > 0 and file.read(1) != b"\n":
        # The split begins inside a line, which belongs to the split before it.
        while True:
            block = file.read(BLOCK)
            if not block:
                return
            found = block.find(b"\n")
            if found >= 0:
                rest = block[found + 1 :]
                at += found + 1
                break
            at += len(block)
    while at < split_end:
        block = file.read(BLOCK)
        pieces = (rest + block).split(b"\n")
        rest = pieces.pop()
        for piece in pieces:
            if at >= split_end:
                return
            yield piece, at
            at += len(piece) + 1
        if not block:
            return


class TailReader(DataSourceStreamReader):
    def __init__(self, folder: str, pattern: str, split_bytes: int):
        self.folder, self.pattern, self.split_bytes = folder, pattern, split_bytes

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        system, base = open_folder(self.folder)
        found = {}
        for info in system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)):
            if info.type == fs.FileType.File and fnmatch.fnmatch(info.base_name, self.pattern) and info.size:
                with system.open_input_file(info.path) as file:
                    at = last_line_end(file, info.size)
                    if at:
                        found[info.path] = {"at": at, "mark": first_line_mark(file)}
        return found

    def partitions(self, start: dict, end: dict) -> list[Split]:
        return [
            Split(file, at, min(at + self.split_bytes, to))
            for file, begin, to in changed_ranges(start, end)
            for at in range(begin, to, self.split_bytes)
        ]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        system, _ = open_folder(self.folder)
        texts, places, size = [], [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array([partition.file] * len(texts)), pa.array(places)], schema=_LINES)

        with system.open_input_file(partition.file) as file:
            for line, at in lines_of(file, partition.start, partition.end):
                texts.append(line.rstrip(b"\r").decode("utf-8", "replace"))
                places.append(at)
                size += len(line)
                if size >= BLOCK:
                    yield batch()
                    texts, places, size = [], [], 0
        if texts:
            yield batch()


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "raw string, file string, at bigint"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"], self.options.get("pattern", "*"), int(self.options.get("splitBytes", SPLIT_BYTES)))


def stream_growing_log(spark: SparkSession, folder: str, pattern: str = "*.log", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Lines as they are appended to the files of a folder, each once; blank ones are dropped.

    ``arrival`` is the file and the line's place in it, so rows with equal times keep their order.
    A replaced file with the same first line and at least the old length counts as one that grew.
    """
    # The executors need no copy of this package: the source travels with the plan.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(TailSource)
    lines = spark.readStream.format("tail").option("path", folder).option("pattern", pattern).option("splitBytes", split_bytes).load()
    return lines.select("raw", F.struct("file", "at").alias("arrival")).where(F.trim("raw") != "")
