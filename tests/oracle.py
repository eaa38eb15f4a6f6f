"""Compare a query with its SQL in DuckDB: names, rows and values."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

from tallyframe.plans.views import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0) if v != int(v) or abs(v) > 1e15 else f"{int(v)}.0"
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(cell(x) for x in v) + "]"
    return f"{type(v).__name__}:{v}"


def compare(spark_df, con, sql: str) -> tuple[bool, str]:
    names = sorted(spark_df.columns)
    got = spark_df.select(*[f"`{n}`" for n in names]).collect()
    cur = con.execute(sql)
    their = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(their) != names:
        return False, f"columns {names} != {sorted(their)}"
    order = [their.index(n) for n in names]
    a = sorted(tuple(cell(v) for v in r) for r in got)
    b = sorted(tuple(cell(r[i]) for i in order) for r in want)
    if a == b:
        return True, f"{len(a)} rows"
    only_a = sorted(set(a) - set(b))[:3]
    only_b = sorted(set(b) - set(a))[:3]
    return False, f"rows {len(a)}/{len(b)} cols {names}\n   spark only {only_a}\n   sql only   {only_b}"


if __name__ == "__main__":
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from tallyframe.session import local_session

    sf = sys.argv[1]
    wanted = sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    sqls, qs = entry.oracle_sql(), entry.queries()
    bad = 0
    for name, fn in qs.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf)
            if name in sqls:
                ok, why = compare(df, con, sqls[name])
            else:
                ok, why = True, f"{df.count()} rows, no SQL"
        except Exception as e:  # noqa: BLE001
            ok, why = False, f"{type(e).__name__}: {str(e)[:900]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:40s} {time.time() - t0:6.1f}s {why}", flush=True)
    print(f"{bad} failed")
