"""Run registered queries and their SQL side by side: python tools/check.py SF_DIR [name-prefix ...]"""

from __future__ import annotations

import math
import os
import sys
import threading
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
LIMIT = float(os.environ.get("LIMIT", "45"))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(r[i] for i in order) for r in rows),
        key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r),
    )


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b and type(a) is type(b)


def compare(spark, con, name, sf_dir, queries, oracles):
    """(status, detail) of one query."""
    start = time.time()
    df = queries[name](spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spent = f"{time.time() - start:.1f}s on Spark, "
    if name not in oracles:
        return "rows", f"{len(mine)} rows"
    cur = con.execute(oracles[name])
    names = [d[0] for d in cur.description]
    theirs = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return "FAIL", f"columns {sorted(df.columns)} vs {sorted(names)}"
    if len(mine) != len(theirs):
        return "FAIL", f"rows {len(mine)} vs {len(theirs)}: {mine[:2]} / {theirs[:2]}"
    for a, b in zip(mine, theirs):
        if not all(same(x, y) for x, y in zip(a, b)):
            bad = sum(not all(same(x, y) for x, y in zip(p, q)) for p, q in zip(mine, theirs))
            return "FAIL", f"{bad} of {len(mine)} differ, first {a} vs {b} ({sorted(names)})"
    return "ok", spent + f"{len(mine)} rows"


def main() -> int:
    from rankmill.plans import ORACLES, QUERIES
    from rankmill.session import build_session

    sf_dir, prefixes = sys.argv[1], sys.argv[2:]
    spark = build_session(
        "check", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
           "spark.ui.showConsoleProgress": "false",
           "spark.sql.streaming.stateStore.providerClass":
           "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(sf_dir), []
    for name in QUERIES:
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        timer = threading.Timer(LIMIT, lambda: (spark.sparkContext.cancelAllJobs(), con.interrupt()))
        timer.start()
        try:
            status, detail = compare(spark, con, name, sf_dir, QUERIES, ORACLES)
        except Exception as error:  # noqa: BLE001
            status, detail = "ERROR", str(error)[:1500]
            if "-v" in os.environ.get("CHECK", ""):
                traceback.print_exc()
        timer.cancel()
        if status not in ("ok", "rows"):
            failed.append(name)
        print(f"{status:5} {time.time() - start:6.2f}s {name}: {detail}", flush=True)
    print("failed:", " ".join(failed) or "none")
    return bool(failed)


if __name__ == "__main__":
    sys.exit(main())
