"""Runs registered queries beside their SQL: python tests/oracle.py [DIR [NAME...]] prints those that differ."""

import datetime as dt
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(v) if v % 1 else int(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (bytes, bytearray, memoryview)):
        return bytes(v).hex()
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def difference(df, con, sql: str) -> str:
    """Empty where the rows and column names are the same."""
    names = sorted(df.columns)
    ours = sorted(repr(tuple(plain(r[c]) for c in names)) for r in df.collect())
    got = con.execute(sql)
    heads = [c[0] for c in got.description]
    if sorted(heads) != names:
        return f"columns {names} against {sorted(heads)}"
    at = [heads.index(c) for c in names]
    theirs = sorted(repr(tuple(plain(r[i]) for i in at)) for r in got.fetchall())
    if ours == theirs:
        return ""
    return f"{len(ours)} rows against {len(theirs)}; only ours {sorted(set(ours) - set(theirs))[:2]}; only theirs {sorted(set(theirs) - set(ours))[:2]}"


def main() -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir, *names = sys.argv[1:] or ["/root/testdata/sf0.01"]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in names or sql:
        began = time.time()
        try:
            said = difference(queries[name](spark, sf_dir), con, sql[name])
        except Exception as e:  # a failing query is reported beside the others
            said = f"{type(e).__name__}: {str(e)[:400]}"
        bad += bool(said)
        print(f"{name} {time.time() - began:.1f} s {said or 'same'}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
