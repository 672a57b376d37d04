"""Run registered queries and their check SQL side by side and compare values."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, bool) or value is None:
        return str(value)
    if hasattr(value, "normalize") and not isinstance(value, str):
        return f"{float(value):.9g}"
    if isinstance(value, int):
        return f"{float(value):.9g}" if abs(value) < 2**53 else str(value)
    return str(value)


def table(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def difference(spark, con, query, sql: str, sf_dir: str) -> str | None:
    """NULL if both sides agree, else a short text about the first difference."""
    frame = query(spark, sf_dir)
    ours = [tuple(r) for r in frame.collect()]
    relation = con.execute(sql)
    names = [d[0] for d in relation.description]
    theirs = relation.fetchall()
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(set(names) ^ set(frame.columns))}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} against {len(theirs)}"
    a, b = table(frame.columns, ours), table(names, theirs)
    for x, y in zip(a, b, strict=True):
        if x != y:
            cols = sorted(names)
            wrong = [(c, p, q) for c, p, q in zip(cols, x, y, strict=True) if p != q]
            return f"values {wrong[:6]}"
    return None if ours else "both sides are empty"


def main() -> int:
    from edgetrail.plans import CHECKS, QUERIES
    from edgetrail.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(QUERIES)
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    for name in wanted:
        start = time.time()
        try:
            if name in CHECKS:
                result = difference(spark, con, QUERIES[name], CHECKS[name], sf_dir)
            else:
                n = QUERIES[name](spark, sf_dir).count()
                result = None if n else "no rows"
        except Exception as error:  # noqa: BLE001 - the report goes on
            result = f"error {str(error)[:500]}"
        bad += result is not None
        print(f"{'ok ' if result is None else 'BAD'} {name} {time.time() - start:.2f}s {result or ''}", flush=True)
    print(f"{len(wanted) - bad} of {len(wanted)} agree")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
