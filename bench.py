"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from edgetrail.plans import QUERIES
from edgetrail.session import build_session

HEADLINE = [
    "normalize_requests", "classify_requests", "viewing_sessions", "graph_nodes_request", "graph_nodes_content",
    "graph_nodes_token", "graph_nodes_segment", "graph_edges", "graph_statistics", "token_fanout",
    "token_fanout_members", "suspicious_sessions", "ip_correlation", "ip_paths", "traffic_totals", "top_addresses",
    "request_counts", "window_metrics", "rate_limit_report", "token_features", "live_edge_lag", "blocked_flag",
    "sessions_with_users", "account_dashboard", "watch_history", "favorites", "catalog_upsert", "catalog_search",
    "manifest_reconcile", "playlist_inventory", "token_audit", "stream_sessions", "stream_metrics",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.edgetrail.spreadSmallInputs": "true",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["traffic_totals"](spark, sf_dir).collect()  # start the executors and load classes
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")),
        "log_records": rows,
        "records_per_sec": {q: round(rows / seconds[q]) for q in ("normalize_requests", "viewing_sessions", "graph_edges")},
    }))


if __name__ == "__main__":
    main()
