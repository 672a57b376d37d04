"""A deterministic, sharded WARC writer, and its reader.

Records are range-sorted by page_id: ids are counted in cells of equal width, cells are dealt to shards of about equal
numbers of records, and each shard is sorted, so the same rows always give the same files. A shard rolls to a new file
once its compressed size passes a limit. Headers and digests are made anew from the payload. Each file is written
under a temporary name and renamed when it is whole; a manifest lists what counts, and readers read only that. A task
that runs again writes the same bytes under the same names.

Of records with equal payloads that of the largest page_id holds the payload, the others are revisits. That decision
travels to the writer as small rows through the same shuffle as the pages, so the html is shuffled once.

Files are opened through pyarrow's file systems (local or mounted paths, hdfs://, s3://, gs://).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgetrail.llm.common import batches, new_path, rows_of

ROLL_BYTES = 64 << 20
RECORDS_PER_SHARD = 4096
MAX_CELLS = 1 << 16
LEVEL = 6
DATE = "2024-01-01T00:00:00Z"
URN = "urn:edgetrail:page:"
_MANIFEST = pa.schema([("shard", pa.int64()), ("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])
_RECORDS = pa.schema(
    [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("file", pa.string())]
)


def decisions(pages: DataFrame) -> DataFrame:
    """page_id, digest (hexadecimal) and holder: the largest page_id with the same payload, for pages that are not it."""
    digests = pages.select("page_id", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"))
    holders = digests.groupBy("digest").agg(F.max("page_id").alias("holder"), F.count("*").alias("n")).where("n > 1").drop("n")
    return digests.join(holders, "digest").where("page_id < holder").select("page_id", "digest", "holder").distinct()


def _cells(pages: DataFrame, per_shard: int):
    """The number of shards, a column expression for a page_id's cell, and the shard of each cell."""
    low, high = pages.agg(F.min("page_id"), F.max("page_id")).first()
    low, high = low or 0, high or 0
    width = (high - low) // MAX_CELLS + 1
    # In decimals: ids may lie further apart than 64 bits reach.
    cell = F.expr(f"(CAST(page_id AS DECIMAL(20, 0)) - CAST('{low}' AS DECIMAL(20, 0))) DIV CAST('{width}' AS DECIMAL(20, 0))")
    counted = pages.where("page_id IS NOT NULL").groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).toArrow()  # at most MAX_CELLS rows
    sizes = np.zeros((high - low) // width + 1, np.int64)
    sizes[counted["cell"].to_numpy()] = counted["n"].to_numpy()
    shard = np.maximum(np.cumsum(sizes) - 1, 0) // per_shard
    shards = pages.sparkSession.createDataFrame(pa.table({"cell": np.arange(len(shard)), "shard": shard.astype(np.int32)}))
    return int(shard[-1] + 1), cell, F.broadcast(shards)  # bounded by MAX_CELLS


def write_warc(pages: DataFrame, path: str, roll_bytes: int = ROLL_BYTES, per_shard: int = RECORDS_PER_SHARD) -> DataFrame:
    """Write a record for every row of pages (page_id, url, html) below path and return the manifest, which is also
    written there as Parquet: shard, file, records, bytes, sha256.

    A null html is an empty payload, a null url is empty, and control characters and blanks in a url are escaped.
    Rows that repeat the page_id that holds a payload hold it too. A null page_id is written to the first shard and
    never refers or is referred to. Other columns are ignored. An empty table gives an empty manifest.
    """
    rows = pages.select("page_id", "url", "html")
    n, cell, shards = _cells(rows, per_shard)
    told = decisions(rows).withColumns({"kind": F.lit(0), "url": F.lit(None).cast("string"), "html": F.lit(None).cast("string")})
    content = rows.withColumns({"digest": F.lit(None).cast("string"), "holder": F.lit(None).cast("long"), "kind": F.lit(1)})
    dealt = told.unionByName(content).withColumn("cell", cell).join(shards, "cell", "left").withColumn("shard", F.coalesce("shard", F.lit(0)))
    placed = dealt.repartitionById(n, F.col("shard")).sortWithinPartitions("page_id", "kind", "url", "html")

    def write(parts):
        fs, base = pa.fs.FileSystem.from_uri(path)
        fs.create_dir(base, recursive=True)

        def rolled():
            out = None
            holders: dict[str, int] = {}
            last = object()
            for shard_id, page_id, kind, digest, holder, url, html in rows_of(parts, "shard", "page_id", "kind", "digest", "holder", "url", "html"):
                if page_id != last:
                    holders, last = {}, page_id
                if kind == 0:
                    holders[digest] = holder
                    continue
                if out and (out.shard != shard_id or out.size >= roll_bytes):
                    yield out.commit()
                    out = _File(fs, base, shard_id, out.part + 1 if out.shard == shard_id else 0)
                out = out or _File(fs, base, shard_id, 0)
                payload = (html or "").encode("utf-8")
                sha1 = hashlib.sha1(payload).digest()
                out.add(record(page_id, url, payload, sha1, holders.get(sha1.hex())))
            if out:
                yield out.commit()

        yield from batches(rolled(), _MANIFEST)

    manifest = placed.mapInArrow(write, "shard long, file string, records long, bytes long, sha256 string")
    manifest.write.mode("overwrite").parquet(f"{path}/manifest")
    return pages.sparkSession.read.schema(manifest.schema).parquet(f"{path}/manifest")


class _File:
    """One archive file: written under a temporary name, renamed when it is whole."""

    def __init__(self, fs, base: str, shard: int, part: int):
        self.fs, self.base, self.shard, self.part = fs, base, shard, part
        self.name = f"shard-{shard:06d}-{part:05d}.warc.gz"
        self.temporary = f"{base}/_temporary-{uuid.uuid4().hex}-{TaskContext.get().taskAttemptId()}"
        self.stream = fs.open_output_stream(self.temporary, compression=None)
        self.digest, self.size, self.records = hashlib.sha256(), 0, 0

    def add(self, block: bytes) -> None:
        packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)  # a gzip member of its own, without a time stamp
        member = packer.compress(block) + packer.flush()
        self.stream.write(member)
        self.digest.update(member)
        self.size += len(member)
        self.records += 1

    def commit(self) -> tuple:
        self.stream.close()
        self.fs.move(self.temporary, f"{self.base}/{self.name}")
        return self.shard, self.name, self.records, self.size, self.digest.hexdigest()


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record(page_id: int | None, url: str | None, payload: bytes, sha1: bytes, holder: int | None) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit with the response's headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if holder is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if holder is None else 'revisit'}",
        f"WARC-Record-ID: <{URN}{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f\x85\u2028\u2029]", lambda m: quote(m[0]), url or ""),
        f"WARC-Payload-Digest: sha1:{base32(sha1)}",
        f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).digest())}",
        "Content-Type: application/http; msgtype=response",
    ]
    if holder is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <{URN}{holder}>",
        ]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(stream):
    """(headers, block) of each record of an open archive, without reading the whole file at once."""
    while (line := stream.readline()) != b"":
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline().rstrip(b"\r\n")) != b"":
            name, _, value = line.decode("utf-8").partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, stream.read(int(headers["content-length"]))


def read_warc(manifest: DataFrame, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url and file of every record in the manifest's
    files. Block and payload digests are checked; a file that differs from them raises an error."""
    tasks = max(1, manifest.sparkSession.sparkContext.defaultParallelism)

    def read(parts):
        fs, base = pa.fs.FileSystem.from_uri(path)

        def rows():
            for (name,) in rows_of(parts, "file"):
                with fs.open_input_stream(f"{base}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for headers, block in parsed(stream):
                        if headers["warc-block-digest"] != f"sha1:{base32(hashlib.sha1(block).digest())}":
                            raise ValueError(f"{name}: a block differs from its digest")
                        http, _, payload = block.partition(b"\r\n\r\n")
                        kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response" and digest != base32(hashlib.sha1(payload).digest()):
                            raise ValueError(f"{name}: a payload differs from its digest")
                        size = int(re.search(rb"(?im)^content-length:\s*(\d+)", http)[1])
                        yield _page(headers["warc-record-id"]), size, digest, kind, _page(headers.get("warc-refers-to", "")), headers["warc-target-uri"], name

        yield from batches(rows(), _RECORDS, 4096)

    return manifest.select("file").repartition(tasks, "file").mapInArrow(
        read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, file string"
    )


def _page(urn: str) -> int | None:
    text = urn.strip("<>").removeprefix(URN)
    return int(text) if text else None


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages as archives in the shared folder and read them back."""
    path = new_path(pages.sparkSession, "warc")
    return read_warc(write_warc(pages, path), path)
