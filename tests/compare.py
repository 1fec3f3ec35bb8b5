"""Query results against DuckDB's answer to the stated SQL: `python tests/compare.py [SF_DIR] [NAME...]`."""

from __future__ import annotations

import glob
import math
import sys
import time
from pathlib import Path

import duckdb


def database(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM '{f}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str(v)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(_plain(r[k]) for k in order) for r in rows)


def differences(df, con, sql: str) -> list[str]:
    """What differs: columns, types or rows; empty if nothing does."""
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    kinds = {d[0]: str(d[1]) for d in want.description}
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} instead of {sorted(names)}"]
    same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    out = [f"{c}: {t} against {kinds[c]}" for c, t in df.dtypes if same.get(t, kinds[c]) != kinds[c]]
    got, want = rows_of(df.columns, df.collect()), rows_of(names, want.fetchall())
    if got != want:
        a, b = set(got), set(want)
        out.append(f"{len(got)} rows against {len(want)}; only here {sorted(a - b)[:3]}, only there {sorted(b - a)[:3]}")
    return out


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.warehouse.dir", "/tmp/compare-warehouse").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = database(sf), e.oracle_sql()
    for name, f in e.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        t = time.time()
        try:
            df = f(spark, sf)
            said = differences(df, con, sqls[name]) if name in sqls else [f"no SQL, {df.count()} rows"]
        except Exception as x:
            said = [str(x)[:1500]]
        print(f"{time.time() - t:6.1f} {name}: {'; '.join(said) or 'same'}"[:2000], flush=True)
