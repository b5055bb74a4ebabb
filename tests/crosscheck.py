"""Run registered queries on Spark and their reference SQL on DuckDB, and compare values.

usage: python tests/crosscheck.py [--sf DIR] [key-prefix ...]
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
from pyspark.sql import SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def session(cpus: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "10g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "~nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, dt.date) and not isinstance(v, dt.datetime):
        return v.isoformat()
    return str(v)


def compare(spark_df, con, sql: str):
    names = sorted(spark_df.columns)
    mine = sorted(tuple(canon(r[n]) for n in names) for r in spark_df.collect())
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    if sorted(cols) != names:
        return f"columns {names} vs {sorted(cols)}", len(mine)
    at = [cols.index(n) for n in names]
    theirs = sorted(tuple(canon(r[i]) for i in at) for r in cur.fetchall())
    if len(mine) != len(theirs):
        return f"rows {len(mine)} vs {len(theirs)}", len(mine)
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if bad:
        return f"{len(bad)} rows differ, columns {names}, e.g. {bad[0]}", len(mine)
    return None, len(mine)


def main(argv: list[str]) -> int:
    import __spark_entry__ as e

    sf = "/root/testdata/sf0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        argv = argv[:i] + argv[i + 2:]
    spark, con = session(), duck(sf)
    oracles, failed = e.oracle_sql(), []
    for key, fn in e.queries().items():
        if argv and not any(key.startswith(p) for p in argv):
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            if key in oracles:
                problem, n = compare(df, con, oracles[key])
            else:
                problem, n = None, df.count()
        except Exception as ex:  # report and go on with the next key
            problem, n = f"{type(ex).__name__}: {str(ex)[:1500]}", -1
        mark = "FAIL" if problem else ("ok  " if key in oracles else "rows")
        print(f"{mark} {key:28s} {n:8d} rows {time.time() - t:6.2f}s {problem or ''}", flush=True)
        if problem:
            failed.append(key)
    print(f"{len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
