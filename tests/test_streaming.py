"""Streamed tables equal the batch tables over the same files."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from edgetrail.operators.edges import EDGE_INPUTS, edges_unified
from edgetrail.operators.graph_rows import graph_rows
from edgetrail.operators.nodes import NODE_FOLDS, nodes
from edgetrail.operators.normalize import normalize_requests
from edgetrail.sources.logs import read_access_log, read_index, stream_access_log
from edgetrail.streaming import graph_stream as gs
from edgetrail.streaming.batch_store import BatchStore
from test_folds import records


def write(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows) + "\n")


def same(a, b):
    b = b.select(a.columns)
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_fold_and_edges_over_several_batches(spark, tmp_path):
    data = [{**r, "request_id": f"{i}"} for i, r in enumerate(records(120, 11))]
    for r in data:  # ties are ordered by file and text in a stream, so keep times apart
        r["timestamp"] = f"2024-01-01T00:{int(r['request_id']) * 7 % 120 // 60:02d}:{int(r['request_id']) * 7 % 60:02d}Z"
    for i in range(4):
        write(tmp_path / "in", f"{i}.log", data[i::4])
    (tmp_path / "in" / "4.log").write_text("{broken\n\n")
    path = str(tmp_path / "in")
    batch = graph_rows(read_access_log(spark, path))
    for label in ("ViewingSession", "CdnToken"):
        out = str(tmp_path / label)
        gs.stream_fold(stream_access_log(spark, path, 1), label, f"{out}/t", f"{out}/c").awaitTermination()
        assert spark.read.parquet(f"{out}/t").select("batch_id").distinct().count() > 2
        assert same(nodes(batch, label), gs.read_fold(spark, label, f"{out}/t"))
        # A second run finds nothing new; compaction keeps the result.
        gs.stream_fold(stream_access_log(spark, path, 1), label, f"{out}/t", f"{out}/c").awaitTermination()
        gs.compact_fold(spark, label, f"{out}/t", f"{out}/small")
        assert same(nodes(batch, label), gs.read_fold(spark, label, f"{out}/small"))
    out = str(tmp_path / "edges")
    gs.stream_edges(stream_access_log(spark, path, 1), EDGE_INPUTS, f"{out}/t", f"{out}/c").awaitTermination()
    assert same(edges_unified(batch), gs.read_edges(spark, f"{out}/t"))


def test_new_files_resume_from_the_checkpoint(spark, tmp_path):
    first, later = records(20, 1), records(30, 2)
    write(tmp_path / "in", "a.log", first)
    args = ("Edge", str(tmp_path / "t"), str(tmp_path / "c"))
    gs.stream_fold(stream_access_log(spark, str(tmp_path / "in")), *args).awaitTermination()
    write(tmp_path / "in", "b.log", later)
    gs.stream_fold(stream_access_log(spark, str(tmp_path / "in")), *args).awaitTermination()
    assert spark.read.parquet(args[1]).select("batch_id").distinct().count() == 2


def test_duplicates_and_late_rows(spark, tmp_path):
    rows = [
        {"timestamp": f"2024-01-01T{h:02d}:00:00Z", "request_uri": "/hls/v/1.ts", "status": "200", "request_id": str(h), "bytes_sent": "1", "cache_status": "HIT"}
        for h in (1, 2, 3)
    ]
    late = {**rows[0], "timestamp": "2024-01-01T00:10:00Z", "request_id": "late"}
    write(tmp_path / "in", "a.log", rows + [rows[0], rows[2]])
    path = str(tmp_path / "in")
    out = str(tmp_path / "m")
    gs.stream_metrics(stream_access_log(spark, path, 1), out, f"{out}/c").awaitTermination()
    write(tmp_path / "in", "b.log", [late, rows[1]])
    gs.stream_metrics(stream_access_log(spark, path, 1), out, f"{out}/c").awaitTermination()
    progress = {r["batch_id"]: (r["rows"], r["late_rows"]) for r in gs.read_progress(spark, out).collect()}
    assert progress == {0: (5, 0), 1: (2, 2)}
    assert gs.read_metrics(spark, out).agg(F.sum("requests")).first()[0] == 7

    write(tmp_path / "in", "c.log", [{"request_id": "untimed", "request_uri": "/x"}, rows[0]])
    (tmp_path / "in" / "d.log").write_text("{broken\n")
    out = str(tmp_path / "u")
    gs.stream_unique(stream_access_log(spark, path, 1), out, f"{out}/c").awaitTermination()
    ids = normalize_requests(gs.read_unique(spark, out), ["request_log_id"]).collect()
    assert sorted(r["request_log_id"] for r in ids) == ["1", "2", "3", "late", "untimed"]
    assert [r["raw"] for r in gs.read_quarantine(spark, out).collect()] == ["{broken"]


def test_whole_graph_in_one_stream(spark, tmp_path):
    data = [{**r, "timestamp": f"2024-01-01T00:{i // 60:02d}:{i % 60:02d}Z"} for i, r in enumerate(records(60, 5))]
    for i in range(3):
        write(tmp_path / "in", f"{i}.log", data[i::3])
    (tmp_path / "in" / "3.log").write_text("{broken\n")
    path, out = str(tmp_path / "in"), str(tmp_path / "graph")
    gs.stream_graph(stream_access_log(spark, path, 1), out, f"{out}/c").awaitTermination()
    batch = graph_rows(read_access_log(spark, path))
    assert same(edges_unified(batch), gs.read_edges(spark, f"{out}/edges"))
    for label in NODE_FOLDS:
        assert same(nodes(batch, label), gs.read_fold(spark, label, f"{out}/nodes/{label}")), label
    assert gs.read_quarantine(spark, out).count() == 1
    store = BatchStore(spark, out)
    assert store.snapshot()["batch"] >= 3 and all(len(store.folders(f"nodes/{label}")) <= 3 for label in NODE_FOLDS)


def test_watermarked_windows_and_session_totals(spark, tmp_path):
    write(tmp_path / "in", "a.log", records(50, 3))
    logs = lambda: stream_access_log(spark, str(tmp_path / "in"))
    for name, frame, mode in (("w", gs.windowed_counts(logs()), "update"), ("s", gs.session_totals(logs()), "complete")):
        query = frame.writeStream.format("memory").queryName(name).outputMode(mode).option(
            "checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination()
    assert spark.table("w").agg(F.sum("requests")).first()[0] == 50
    batch = nodes(graph_rows(read_access_log(spark, str(tmp_path / "in"))), "ViewingSession")
    want = {(r["viewing_session_id"], r["request_count"]) for r in batch.collect()}
    assert {(r["viewing_session_id"], r["requests"]) for r in spark.table("s").collect()} == want


def test_read_index_pages(spark, tmp_path):
    write(tmp_path / "a", "x.log", records(10, 4))
    write(tmp_path / "b", "x.log", [{"@timestamp": "2024-05-01T00:00:00Z"}, {"@timestamp": "2023-05-01T00:00:00Z"}])
    patterns = [str(tmp_path / "*"), str(tmp_path / "*")]
    page = read_index(spark, patterns, "2024-01-01T00:00:00Z", 11).collect()
    assert len(page) == 11 and page[-1]["index_ts"].year == 2024
    assert [r["index_ts"] for r in page] == sorted(r["index_ts"] for r in page)
