"""Run registered queries next to their SQL twins and compare all rows: `python tests/compare.py [sf] [name …]`."""

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _value(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.10g}"
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    return "" if v is None else str(v) if not isinstance(v, bool) else str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    out = []
    for r in rows:
        out.append(tuple("∅" if r[i] is None else _value(r[i]) for i in order))
    return names, sorted(out)


def check(spark, con, name, run, sql, sf_dir):
    begun = time.time()
    df = run(spark, sf_dir)
    got_names, got = rows_of(df.columns, df.collect())
    seconds = time.time() - begun
    cur = con.execute(sql)
    want_names, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    problems = []
    if got_names != want_names:
        problems.append(f"columns {got_names} != {want_names}")
    elif got != want:
        extra = [r for r in got if r not in set(want)][:3]
        missing = [r for r in want if r not in set(got)][:3]
        problems.append(f"{len(got)} rows against {len(want)}; only ours {extra}; only SQL {missing}")
    return problems, len(got), seconds


def main():
    import __spark_entry__ as entry
    from presslake.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:]
    spark = build_session("local[8]", "compare", 8, **{"spark.ui.enabled": "false", "spark.driver.memory": "8g",
                                                           "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con = connect(sf_dir)
    oracle = entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if names and name not in names:
            continue
        try:
            problems, n, seconds = check(spark, con, name, run, oracle[name], sf_dir)
        except Exception as e:  # noqa: BLE001
            problems, n, seconds = [f"{type(e).__name__}: {str(e)[:600]}"], -1, 0
        bad += bool(problems)
        print(f"{'FAIL' if problems else 'ok':4} {name:26} rows={n:6} {seconds:6.2f}s {' '.join(problems)[:1500]}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
