"""Run queries against their SQL twins: ``python tests/compare.py [sf_dir] [names...]``."""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    return con


def _plain(value):
    if value is None or value is pd.NA or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if hasattr(value, "item"):
        return _plain(value.item())
    return value


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    values = [tuple(_plain(v) for v in row) for row in frame.astype(object).itertuples(index=False)]
    return sorted(values, key=repr)


def kinds(frame: pd.DataFrame) -> dict[str, str]:
    return {c: str(frame[c].dtype) for c in sorted(frame.columns)}


def compare(spark, con, sf, fn, sql) -> str | None:
    """None when both sides agree, else what differs."""
    mine, theirs = fn(spark, sf).toPandas(), con.execute(sql).df()
    if sorted(mine.columns) != sorted(theirs.columns):
        return f"columns {sorted(mine.columns)} != {sorted(theirs.columns)}"
    a, b = rows(mine), rows(theirs)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}; only mine {list(set(a) - set(b))[:3]} only theirs {list(set(b) - set(a))[:3]}"
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        return f"{len(wrong)} rows differ, first {wrong[0]}"
    if kinds(mine) != kinds(theirs):
        print("   types:", {c: (kinds(mine)[c], kinds(theirs)[c]) for c in kinds(mine) if kinds(mine)[c] != kinds(theirs)[c]})
    return None


def main() -> None:
    import __spark_entry__ as entry
    from titlelab.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark = build_session(
        "compare", "local[8]", {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf), 0
    for name in names:
        fn, sql = entry.queries()[name], entry.oracle_sql().get(name)
        start = time.time()
        try:
            if sql is None:
                problem, note = None, f"rows only: {len(fn(spark, sf).toPandas())}"
            else:
                problem, note = compare(spark, con, sf, fn, sql), "ok"
        except Exception:
            problem, note = traceback.format_exc()[-1500:], ""
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name:28s} {time.time() - start:6.1f}s {problem or note}", flush=True)
    print("failed:", bad, "of", len(names))


if __name__ == "__main__":
    main()
