"""Run registered queries against DuckDB: python tests/compare.py [sf_dir] [name ...]."""

import datetime
import math
import os
import sys
import time
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else value + 0.0
    if isinstance(value, (datetime.date, datetime.datetime)):
        return str(value)
    return value


def as_rows(columns, rows):
    """Column names sorted, rows sorted as text; types must match too (1 is not 1.0)."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        repr(tuple(_cell(row[i]) for i in order)) for row in rows
    )


def compare(spark, con, sf_dir, name, query, text):
    df = query(spark, sf_dir)
    got = as_rows(df.columns, [tuple(r) for r in df.collect()])
    if text is None:
        return None, len(got[1]), ""
    rel = con.execute(text)
    want = as_rows([d[0] for d in rel.description], rel.fetchall())
    if got == want:
        return True, len(got[1]), ""
    if got[0] != want[0]:
        return False, len(got[1]), f"columns {got[0]} / {want[0]}"
    only = [r for r in got[1] if r not in set(want[1])][:2], [r for r in want[1] if r not in set(got[1])][:2]
    return False, len(got[1]), f"rows {len(got[1])}/{len(want[1])} spark-only {only[0]} oracle-only {only[1]}"


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as E

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = connect(sf_dir), E.oracle_sql(), []
    for name, query in E.queries().items():
        if chosen and name not in chosen:
            continue
        start = time.time()
        try:
            ok, n, why = compare(spark, con, sf_dir, name, query, oracles.get(name))
        except Exception as error:  # report and go on with the next query
            ok, n, why = False, -1, str(error)[:600]
        mark = {True: "ok", None: "rows", False: "BAD"}[ok]
        print(f"{mark:5}{name:36}{n:8}{time.time() - start:8.2f}s {why}", flush=True)
        if ok is False:
            bad.append(name)
    print("bad:", bad, "without oracle:", [q for q in E.queries() if q not in oracles])
    return len(bad)


if __name__ == "__main__":
    sys.exit(main())
