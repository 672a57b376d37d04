"""Inputs of few row groups, records of a row alone, and one parse for several outputs."""

from __future__ import annotations

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from edgetrail.operators.edges import EDGE_COLUMNS, RELATIONSHIPS, edges_unified, graph_statistics, pair_edges
from edgetrail.operators.graph_rows import graph_rows, request_columns, rows_of_requests
from edgetrail.operators.nodes import NODE_FOLDS
from edgetrail.operators.normalize import classify_records
from edgetrail.plans import inputs, stream_queries
from edgetrail.streaming import graph_stream as gs
from edgetrail.streaming.batch_store import BatchStore
from test_folds import records
from test_streaming import same, write

SF_DIR = "/root/testdata/sf0.001"


def rows_per_task(df):
    return [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]


@pytest.mark.parametrize("name", ["access_log", "shipped_log", "blacklist_actions"])
def test_one_row_group_is_read_by_all_cores(spark, tmp_path, name):
    table = pq.read_table(f"{SF_DIR}/events.parquet")
    pq.write_table(table, tmp_path / "events.parquet", row_group_size=1 << 20)
    cores = spark.sparkContext.defaultParallelism
    counts = rows_per_task(inputs.load(spark, str(tmp_path), name))
    assert sum(counts) == table.num_rows and len(counts) == cores and max(counts) <= 2 * table.num_rows / cores


def test_one_row_group_of_a_stream(spark, tmp_path):
    pq.write_table(pq.read_table(f"{SF_DIR}/events.parquet"), tmp_path / "events.parquet")
    counts = []
    stream = stream_queries.access_log_stream(spark, str(tmp_path))
    gs._start(stream, lambda df, _: counts.extend(rows_per_task(df)), str(tmp_path / "c"), None).awaitTermination()
    assert len(counts) == spark.sparkContext.defaultParallelism


def test_stream_files_hold_a_batch_each(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    for name, times in (("access_log", 1), ("delivered_log", 2)):
        stream_queries._in_batches(spark, SF_DIR, name, str(tmp_path / name))
        read = spark.read.parquet(str(tmp_path / name / "input"))
        assert len(read.inputFiles()) <= 4 * cores and same(read, inputs.load(spark, SF_DIR, name)), times


def test_records_of_a_row_alone(spark, logs):
    rows = graph_rows(logs(*records(80, 4), *records(20, 4)))
    for label, fold in NODE_FOLDS.items():
        alone = fold.single(rows)
        assert [(f.name, f.dataType.simpleString()) for f in alone.schema] == [(f.name, f.dataType.simpleString()) for f in fold.partial(rows).schema], label
        assert same(fold.result(fold.merge(alone)), fold.apply(rows)), label


@pytest.mark.parametrize("few", [0, 200_000])
def test_repeated_keys_are_merged_however_few(spark, logs, monkeypatch, few):
    monkeypatch.setattr(gs, "BROADCAST_ROWS", few)
    data = [{**r, "request_id": f"r{i}"} for i, r in enumerate(records(60, 6))]
    fold = NODE_FOLDS["Request"]
    rows = graph_rows(logs(*data, *data[:3])).withColumn("request_id", F.expr("if(request_id IN ('r7', 'r8'), NULL, request_id)"))
    assert not gs._fewer(rows, {"k": fold.key_of()})
    assert same(fold.result(gs._merged(fold, fold.single(rows))), fold.apply(rows))


def test_broken_records_stay_beside_rows(logs):
    df = logs(*records(20, 3), "{broken", {"timestamp": "2024-13-45T00:00:00Z"})
    broken = F.col("reason").isNotNull()
    found = rows_of_requests(classify_records(df, request_columns()), ["arrival", "reason"], also=broken)
    assert found.where(broken).count() == 2 and same(found.where(~broken).drop("reason"), graph_rows(df))


def test_pairs_keep_their_names(logs):
    rows = graph_rows(logs(*records(50, 2)))
    pairs = pair_edges(rows)
    assert pairs.columns == EDGE_COLUMNS and same(pairs, edges_unified(rows).where("type <> 'BELONGS_TO'"))
    assert len({(t, s, d) for t, s, _, d, _ in RELATIONSHIPS}) == len(RELATIONSHIPS)


def test_statistics_parse_the_log_once(logs):
    found = graph_statistics(graph_rows(logs(*records(50, 2))))
    assert "from_json" not in found._jdf.queryExecution().analyzed().toString()


def test_stream_edges_parses_a_batch_once(spark, tmp_path, monkeypatch):
    seen = []
    pairs, partial = gs.pair_edges, gs.belongs_partial
    monkeypatch.setattr(gs, "pair_edges", lambda df: seen.append(df) or pairs(df))
    monkeypatch.setattr(gs, "belongs_partial", lambda df: seen.append(df) or partial(df))
    write(tmp_path / "in", "a.log", records(30, 2))
    from edgetrail.operators.edges import EDGE_INPUTS
    from edgetrail.sources.logs import read_access_log, stream_access_log

    gs.stream_edges(stream_access_log(spark, str(tmp_path / "in")), EDGE_INPUTS, str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    assert len(seen) == 2 and all("from_json" not in df._jdf.queryExecution().analyzed().toString() for df in seen)
    assert same(gs.read_edges(spark, str(tmp_path / "t")), edges_unified(graph_rows(read_access_log(spark, str(tmp_path / "in")), EDGE_INPUTS)))


def test_staged_records_are_merged_and_removed(spark, tmp_path):
    store = BatchStore(spark, str(tmp_path / "s"))
    for batch in range(4):
        assert store.commit(batch, {"t": spark.createDataFrame([(1,), (batch,)], "k int")}, {"t": lambda df: df.distinct()}, ["t"])
    assert sorted(r["k"] for r in store.read("t").collect()) == [0, 1, 2, 3]
    listed = {f for b in store.batches() for f in store.folders("t", b)}
    assert len(list((tmp_path / "s" / "t").iterdir())) == len(listed)
