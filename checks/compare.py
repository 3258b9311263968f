"""Run queries against their DuckDB statements: ``python -m checks.compare [sf] [names...]``."""

import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

ROOT = Path("/root/testdata")
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def session(cores="8"):
    return (
        SparkSession.builder.master(f"local[{cores}]").appName("listforge")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def duck(sf_dir):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, query, sql, sf_dir):
    """Returns problems found (empty if equal), row count and both times."""
    start = time.time()
    df = query(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    spark_s = time.time() - start
    if sql is None:
        return [], len(got), spark_s, 0.0
    start = time.time()
    cur = con.execute(sql)
    types = {d[0]: str(d[1]) for d in cur.description}
    want = cur.fetchall()
    duck_s = time.time() - start
    problems = []
    expected = {c: TYPES.get(t, t) for c, t in df.dtypes}
    if sorted(expected) != sorted(types):
        problems.append(f"columns {sorted(expected)} / {sorted(types)}")
    else:
        odd = {c: (expected[c], types[c]) for c in expected if expected[c] != types[c] and expected[c] in TYPES.values()}
        if odd:
            problems.append(f"types {odd}")
        a, b = rows_of(df.columns, got), rows_of(list(types), want)
        if a != b:
            left, right = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
            problems.append(f"rows {len(a)} / {len(b)}; only Spark {left}; only DuckDB {right}")
    return problems, len(got), spark_s, duck_s


def main(argv):
    from checks.oracle import all_sql
    from checks.queries import all_queries

    sf = argv[0] if argv else "0.01"
    sf_dir = str(ROOT / f"sf{sf}")
    spark, con, sqls = session(), duck(sf_dir), all_sql()
    spark.sparkContext.setLogLevel("ERROR")
    failed = 0
    for name, query in all_queries().items():
        if argv[1:] and name not in argv[1:]:
            continue
        try:
            problems, n, s, d = compare(spark, con, name, query, sqls.get(name), sf_dir)
        except Exception as e:  # show and go on with the next query
            problems, n, s, d = [f"{type(e).__name__}: {str(e)[:1500]}"], -1, 0, 0
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  ' if name in sqls else 'rows'} {name:26s} {n:8d} rows  spark {s:6.2f}s  duckdb {d:6.2f}s", *problems, sep="\n     ", flush=True)
    missing = set(sqls) - set(all_queries())
    print(f"{failed} failed; oracle without query: {sorted(missing)}")
    return failed


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1:])))
