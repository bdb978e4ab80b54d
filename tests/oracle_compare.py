"""Spark-vs-DuckDB comparison used by the tests and by ``python -m tests.oracle_compare``.

Both sides are reduced to sorted lists of row tuples (columns ordered by
name); values are normalised only where the two engines' Python types differ
for the same SQL value (numpy scalars, NaN).
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys

import duckdb

BASE_TABLES = ("region nation customer supplier part orders lineitem events documents "
               "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, decimal.Decimal):
        return v
    if isinstance(v, (dt.datetime, dt.date, str, int, bool, bytes)):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def _key(row):
    return tuple((x is None, str(type(x)), str(x)) for x in row)


def spark_rows(df):
    cols = sorted(df.columns)
    rows = [tuple(_norm(r[c]) for c in cols) for r in df.select(*cols).collect()]
    return cols, sorted(rows, key=_key)


def duck_rows(con, sql):
    rel = con.sql(sql)
    names = rel.columns
    cols = sorted(names)
    idx = [names.index(c) for c in cols]
    rows = [tuple(_norm(r[i]) for i in idx) for r in rel.fetchall()]
    return cols, sorted(rows, key=_key)


def compare(spark, con, name, fn, sql, sf_dir):
    s_cols, s_rows = spark_rows(fn(spark, sf_dir))
    d_cols, d_rows = duck_rows(con, sql)
    problems = []
    if s_cols != d_cols:
        problems.append(f"columns differ: spark={s_cols} duck={d_cols}")
    if len(s_rows) != len(d_rows):
        problems.append(f"row count spark={len(s_rows)} duck={len(d_rows)}")
    if not problems:
        for a, b in zip(s_rows, d_rows):
            if a != b:
                problems.append(f"first differing row:\n  spark={a}\n  duck ={b}")
                break
    return len(s_rows), problems


def main(argv):
    sys.path.insert(0, ".")
    from quire.plans.oracle import oracle_sql
    from quire.plans.registry import queries
    from quire.session import build_session

    sf_dir = "/root/testdata/sf0.01"
    args = [a for a in argv[1:] if not a.startswith("--")]
    names = args or sorted(oracle_sql())
    if "--plain" in argv:
        # a session as a caller would build it: defaults, no checkpoint folder
        from pyspark.sql import SparkSession

        spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
                 .config("spark.ui.showConsoleProgress", "false").getOrCreate())
        spark.sparkContext.setLogLevel("ERROR")
    else:
        spark = build_session()
    con = duck(sf_dir)
    qs, sqls = queries(), oracle_sql()
    bad = 0
    for n in names:
        if n not in sqls:
            print(f"{n}: no oracle (rows-only)")
            continue
        try:
            rows, problems = compare(spark, con, n, qs[n], sqls[n], sf_dir)
        except Exception as e:  # report and continue with the other keys
            rows, problems = -1, [f"error: {type(e).__name__}: {str(e)[:800]}"]
        status = "OK " if not problems else "BAD"
        bad += bool(problems)
        print(f"{status} {n}: {rows} rows" + "".join("\n    " + p for p in problems), flush=True)
    print(f"{len(names) - bad}/{len(names)} match")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv))
