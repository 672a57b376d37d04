"""The tailing source, the batch store, late rows, closed visits and the partitioned sink."""

from __future__ import annotations

import io
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from edgetrail.operators.graph_rows import graph_rows, request_columns, rows_of_requests
from edgetrail.operators.normalize import classify_records, normalize_requests, quarantine
from edgetrail.sources import sinks, tail
from edgetrail.sources.logs import read_access_log, stream_access_log
from edgetrail.streaming import graph_stream as gs
from edgetrail.streaming.batch_store import BatchStore
from test_folds import records
from test_streaming import same, write


# --- tailing source ------------------------------------------------------------------------


def test_lines_of_any_split():
    rnd = random.Random(1)
    for _ in range(200):
        text = b"".join(rnd.choice([b"", b"a", b"xyz" * rnd.randint(1, 9)]) + b"\n" for _ in range(rnd.randint(0, 12))) + rnd.choice([b"", b"rest"])
        end = tail.last_line_end(io.BytesIO(text), len(text))
        assert end == text.rfind(b"\n") + 1
        step = rnd.randint(1, 9)
        got = [x for at in range(0, end, step) for x in tail.lines_of(io.BytesIO(text), at, min(at + step, end))]
        want, at = [], 0
        for line in text[:end].split(b"\n")[:-1]:
            want.append((line, at))
            at += len(line) + 1
        assert got == want


def test_changed_ranges():
    old = {"a": {"at": 10, "mark": "1"}, "b": {"at": 10, "mark": "1"}, "c": {"at": 10, "mark": "1"}, "gone": {"at": 5, "mark": "1"}}
    new = {"a": {"at": 15, "mark": "1"}, "b": {"at": 4, "mark": "1"}, "c": {"at": 20, "mark": "2"}, "d": {"at": 7, "mark": "1"}}
    assert list(tail.changed_ranges(old, new)) == [("a", 10, 15), ("b", 0, 4), ("c", 0, 20), ("d", 0, 7)]
    assert list(tail.changed_ranges(new, new)) == []


def test_growing_and_replaced_files(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()

    def run():
        logs = tail.stream_growing_log(spark, str(folder), split_bytes=50)
        logs.writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/b={n}")).option(
            "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r["raw"] for r in spark.read.parquet(out).collect())

    (folder / "a.log").write_text("one\ntwo\nunfini")
    (folder / "skipped.txt").write_text("no\n")
    assert run() == ["one", "two"]
    with open(folder / "a.log", "a") as f:
        f.write("shed\n\nfour\r\n")
    (folder / "b.log").write_text("".join(f"line {i} of a longer file\n" for i in range(40)))
    want = ["four", *sorted(f"line {i} of a longer file" for i in range(40)), "one", "two", "unfinished"]
    assert run() == want
    assert run() == want
    (folder / "a.log").write_text("new\n")  # shorter
    (folder / "b.log").write_text("x" * 5000 + "\n")  # another first line
    assert run() == sorted([*want, "new", "x" * 5000])
    places = spark.read.parquet(out).where("arrival.file LIKE '%a.log' AND raw = 'four'").select("arrival.at").first()[0]
    assert places == len("one\ntwo\nunfinished\n\n")


# --- batch store ---------------------------------------------------------------------------


def test_store_merges_and_repeats_nothing(spark, tmp_path):
    store = BatchStore(spark, str(tmp_path / "s"))
    assert store.snapshot() is None and store.read("t") is None and not store.has(0)
    total = lambda df: df.groupBy("k").agg(F.sum("n").alias("n"))
    for batch in range(12):
        new = spark.createDataFrame([(batch % 3, 1), (9, batch)], "k int, n bigint")
        assert store.commit(batch, {"sums/t": new.groupBy("k").agg(F.sum("n").alias("n")), "rows": new}, {"sums/t": total})
        assert not store.commit(batch, {"sums/t": new, "rows": new}, {"sums/t": total})
        for table in ("sums/t", "rows"):
            assert len(store.folders(table)) <= math.log2(batch + 1) + 1
        assert store.read("rows").count() == 2 * (batch + 1)
        assert dict(total(store.read("sums/t")).collect())[9] == sum(range(batch + 1))
    pinned = store.batches()[0]
    assert store.read("rows", pinned).count() == 2 * (pinned + 1)
    assert len(store.batches()) == 8 and len(list((tmp_path / "s" / "rows").iterdir())) <= 16


# --- late rows and the ledger --------------------------------------------------------------


def test_one_parse_tells_rows_from_quarantine(logs):
    df = logs(*records(20, 3), "{broken", {"timestamp": "2024-13-45T00:00:00Z"})
    found = classify_records(df, ["request_log_id"])
    assert found.count() == 22
    assert same(found.where("reason IS NULL").drop("reason", "raw"), normalize_requests(df, ["request_log_id"]))
    assert same(found.where("reason IS NOT NULL").select("raw", "reason"), quarantine(df))
    rows = rows_of_requests(found_all(df).where("reason IS NULL"), ["arrival"], ["content_id"])
    assert same(rows, graph_rows(df, ["content_id"]))
    assert sorted(r["reason"] for r in found.where("reason IS NOT NULL").collect()) == ["bad_timestamp", "malformed"]


def found_all(df):
    return classify_records(df, request_columns(["content_id"]))


def test_late_rows_and_a_repeated_batch(spark, logs, tmp_path):
    def record(i, edge, minute):
        return {"timestamp": f"2024-01-01T{minute // 60:02d}:{minute % 60:02d}:00Z", "edge_server": edge, "request_id": str(i), "status": "200"}

    batches = [
        [record(1, "a", 100), record(2, "b", 10), "{broken"],
        [record(3, "a", 80), record(4, "a", 95), record(5, "b", 11), record(6, "c", 1)],
        [],
        [record(7, "b", 12), record(8, "a", 200), record(9, "b", 0)],
    ]
    path = str(tmp_path / "split")
    for n, rows in enumerate(batches):
        df = logs(*rows) if rows else logs("{}").limit(0)
        assert gs.split_batch(df, n, path)
        assert not gs.split_batch(df, n, path)
    store = BatchStore(spark, path)
    ids = {t: sorted(r["request_log_id"] for r in store.read(t).collect()) for t in ("rows", "late")}
    assert ids == {"rows": ["1", "2", "4", "5", "6", "7", "8"], "late": ["3", "9"]}
    assert store.read("quarantine").count() == 1


# --- visits --------------------------------------------------------------------------------


def test_closed_visits_equal_the_batch(spark, tmp_path):
    rnd = random.Random(4)
    minutes = sorted(rnd.sample(range(1200), 160))
    data = [
        {"timestamp": f"2024-01-01T{m // 60:02d}:{m % 60:02d}:00Z", "request_uri": f"/hls/v{i % 3}/1.ts", "status": "200", "request_id": str(i),
         "bytes_sent": str(i), "token_run_id": f"run{rnd.randint(0, 3)}"}
        for i, m in enumerate(minutes)
    ]
    out = str(tmp_path / "out")
    for i in range(4):
        write(tmp_path / "in", f"{i}.log", data[i * 40 : i * 40 + 40])
        logs = stream_access_log(spark, str(tmp_path / "in"), 1)
        gs.stream_closed_visits(logs, out, f"{out}/c").awaitTermination()
    got = BatchStore(spark, out).read("visits")
    every = gs.visits(read_access_log(spark, str(tmp_path / "in"))).drop("arrival")
    end = minutes[-1] - 10
    over = every.where(F.col("closes_at") <= F.lit(f"2024-01-01T{end // 60:02d}:{end % 60:02d}:00Z").cast("timestamp"))
    assert same(over, got) and got.count() > 20 and every.count() > got.count()


# --- partitioned sink ----------------------------------------------------------------------


def test_partitioned_sink_once_per_batch(spark, logs, tmp_path):
    path = str(tmp_path / "p")
    assert sinks.read_partitioned(spark, path) is None
    requests = normalize_requests(logs(*records(30, 2)), ["service", "request_log_id"])
    for batch in (0, 1, 0, 1):
        sinks.sink_partitioned(requests, path, batch=batch)
    sinks.sink_partitioned(requests, f"{path}x", batch="day-1")
    assert sinks.read_partitioned(spark, path).groupBy("batch").count().count() == 2
    assert sinks.read_partitioned(spark, path).count() == 60 and sinks.read_partitioned(spark, f"{path}x").count() == 30
    requests.limit(3).withColumn("date", F.to_date("fold_ts")).write.partitionBy("service", "date").parquet(f"{path}/batch=7")  # never committed
    assert sinks.read_partitioned(spark, path).count() == 60
