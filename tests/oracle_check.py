"""Run registered queries against their SQL in DuckDB.

    python tests/oracle_check.py [--sf DIR] [names...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def make_session(cpus: int = 8):
    from pyspark.sql import SparkSession

    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("rastertable")
             .config("spark.sql.shuffle.partitions", str(cpus)).config("spark.driver.memory", "12g")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.bindAddress", "127.0.0.1").config("spark.driver.host", "127.0.0.1").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or isinstance(v, (str, bool, int)):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return str(v)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=lambda t: [(x is None, str(type(x)), x if x is not None else 0) for x in t])


def compare(spark, con, fn, sql: str, sf_dir: str):
    df = fn(spark, sf_dir)
    mine = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    theirs = _rows([c[0] for c in cur.description], cur.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} vs {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"row count {len(mine[1])} vs {len(theirs[1])}; first {mine[1][:2]} vs {theirs[1][:2]}"
    bad = [(a, b) for a, b in zip(mine[1], theirs[1]) if a != b]
    if bad:
        return f"{len(bad)} of {len(mine[1])} rows differ, first {bad[0]} in {mine[0]}"
    return f"ok {len(mine[1])} rows"


def main():
    import __spark_entry__ as entry

    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    spark, con = make_session(), connect(args.sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in args.names or queries:
        t = time.time()
        try:
            if name in oracles:
                result = compare(spark, con, queries[name], oracles[name], args.sf)
            else:
                rows = queries[name](spark, args.sf).collect()
                result = f"ok {len(rows)} rows (no SQL)"
        except Exception as exc:  # report and go on
            result = "ERROR " + " ".join(str(exc).split())[:600]
        failed += not result.startswith("ok")
        print(f"{name:28s} {time.time() - t:6.1f}s {result}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(bool(main()))
