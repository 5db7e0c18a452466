"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Usage: python tools/check_oracles.py [sf_dir] [name-prefix ...]
Mirrors the driver's check: row count, column names, order-insensitive values
(doubles compared after rounding), and reports column type differences.
"""

from __future__ import annotations

import math
import sys
import time

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

import duckdb  # noqa: E402

from titlelake import fixtures as fx  # noqa: E402
from titlelake.catalog import ORACLES, QUERIES, load_all  # noqa: E402
from titlelake.session import local_session  # noqa: E402


TYPE_NAMES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
              "boolean": "BOOLEAN", "float": "FLOAT", "date": "DATE", "timestamp": "TIMESTAMP"}


def norm(v):
    if v is None:
        return ("~null",)
    if isinstance(v, float):
        if math.isnan(v):
            return ("~nan",)
        return round(v, 5)
    if hasattr(v, "item"):
        return norm(v.item())
    return v


def rows_of(pdf):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False):
        out.append(tuple(repr(norm(None if (isinstance(x, float) and False) else x)) for x in rec))
    return cols, sorted(out)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = sys.argv[2:]
    load_all()
    spark = local_session()
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in fx.BASE_TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    ok = bad = 0
    for name, fn in QUERIES.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t0 = time.time()
        try:
            sdf = fn(spark, sf)
            stypes = {f.name: TYPE_NAMES.get(f.dataType.simpleString(), f.dataType.simpleString())
                      for f in sdf.schema.fields}
            sp = sdf.toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        t1 = time.time()
        if name not in ORACLES:
            print(f"ROWS {name}: {len(sp)} rows (no oracle) {t1-t0:.1f}s")
            continue
        try:
            dk = con.execute(ORACLES[name]).df()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        c1, r1 = rows_of(sp)
        c2, r2 = rows_of(dk)
        dtypes = dict(zip(con.sql(ORACLES[name]).columns, map(str, con.sql(ORACLES[name]).types)))
        tdiff = [(c, t, dtypes.get(c)) for c, t in stypes.items() if t != dtypes.get(c)]
        if tdiff:
            print(f"TYPE {name}: {tdiff}")
        if c1 != c2:
            print(f"FAIL {name}: columns {c1} vs {c2}")
            bad += 1
        elif r1 != r2:
            diff1 = [r for r in r1 if r not in set(r2)][:3]
            diff2 = [r for r in r2 if r not in set(r1)][:3]
            print(f"FAIL {name}: rows {len(r1)} vs {len(r2)}; spark-only {diff1}; duck-only {diff2}")
            bad += 1
        else:
            print(f"OK   {name}: {len(r1)} rows {t1-t0:.1f}s")
            ok += 1
    print(f"ok={ok} bad={bad}")


if __name__ == "__main__":
    main()
