"""Side-by-side check of a Spark query and its DuckDB oracle (what the driver does).

Row count, column names and types, and an order-insensitive hash of values.
Run directly to check every registered query:

    python tests/oracle_compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import hashlib
import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

_SPARK_TO_DUCK = {
    "bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "tinyint": "TINYINT",
    "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp": "TIMESTAMP", "date": "DATE",
}


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return str(v)


def value_hash(cols: list[str], rows: list[tuple]) -> str:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def compare(spark, con, name: str, fn, sql: str, sf_dir: str) -> dict:
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_rows = [tuple(r) for r in sdf.collect()]
    s_cols = sdf.columns
    s_types = [_SPARK_TO_DUCK.get(t, t) for _, t in sdf.dtypes]
    t1 = time.time()
    rel = con.sql(sql)
    d_cols = rel.columns
    d_types = [str(t) for t in rel.types]
    d_rows = rel.fetchall()
    res = {
        "name": name,
        "rows": (len(s_rows), len(d_rows)),
        "cols_ok": sorted(s_cols) == sorted(d_cols),
        "types_ok": sorted(zip(s_cols, s_types)) == sorted(zip(d_cols, d_types)),
        "hash_ok": value_hash(s_cols, s_rows) == value_hash(d_cols, d_rows),
        "spark_sec": round(t1 - t0, 2),
    }
    res["ok"] = res["rows"][0] == res["rows"][1] and res["cols_ok"] and res["types_ok"] and res["hash_ok"]
    if not res["types_ok"]:
        res["spark_types"] = sorted(zip(s_cols, s_types))
        res["duck_types"] = sorted(zip(d_cols, d_types))
    return res


def main(argv: list[str]) -> int:
    import os
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as E
    from fedsearch.session import get_spark

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    spark = get_spark("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for n, fn in qs.items():
        if names and n not in names:
            continue
        if n not in sqls:
            df = fn(spark, sf_dir)
            print(f"ROWS-ONLY {n}: {df.count()} rows")
            continue
        try:
            r = compare(spark, con, n, fn, sqls[n], sf_dir)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERROR {n}: {type(e).__name__}: {str(e)[:400]}")
            continue
        bad += 0 if r["ok"] else 1
        print(("OK   " if r["ok"] else "FAIL ") + str(r))
    print(f"failures: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
