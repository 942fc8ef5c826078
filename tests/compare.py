"""Run registered queries against their SQL in DuckDB.

``python tests/compare.py [folder of the tables] [query ...]`` prints one line per query.
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def local_spark() -> SparkSession:
    from sentloom.session import get_spark

    spark = get_spark(
        "sentloom-tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df = df.assign(**{c: df[c].map(lambda x: "null" if pd.isna(x) else repr(float(x)))})
        else:
            df = df.assign(**{c: df[c].map(lambda x: "null" if x is None or x is pd.NA or x is pd.NaT or x != x else str(x))})
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def difference(spark_rows: pd.DataFrame, sql_rows: pd.DataFrame) -> str | None:
    """None when equal, else what differs first."""
    a, b = _canonical(spark_rows), _canonical(sql_rows)
    if list(a.columns) != list(b.columns):
        return f"columns {list(a.columns)} vs {list(b.columns)}"
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    if a.equals(b):
        return None
    for c in a.columns:
        bad = a.index[a[c] != b[c]]
        if len(bad):
            i = bad[0]
            return f"{c}: {len(bad)} rows, first {a.loc[i].to_dict()!r:.400} vs {b.loc[i].to_dict()!r:.400}"
    return "order"


def main() -> None:
    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark, con = local_spark(), duck(folder)
    for name in names:
        start = time.time()
        try:
            frame = entry.queries()[name](spark, folder)
            types = {f.name: f.dataType.simpleString() for f in frame.schema}
            rows = frame.toPandas()
            took = time.time() - start
            sql = entry.oracle_sql().get(name)
            if sql is None:
                print(f"{name}: rows only, {len(rows)} rows, {took:.1f}s", flush=True)
                continue
            start = time.time()
            result = con.execute(sql)
            sql_types = {d[0]: str(d[1]) for d in result.description}
            diff = difference(rows, result.df())
            sql_took = time.time() - start
            verdict = "ok" if diff is None else f"DIFFERENT {diff}"
            print(f"{name}: {verdict} {len(rows)} rows, {took:.1f}s, sql {sql_took:.1f}s", flush=True)
            same = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
            for c, t in types.items():
                if sql_types.get(c) not in (same.get(t), None) and diff is None:
                    print(f"   type of {c}: {t} vs {sql_types[c]}")
        except Exception as e:  # noqa: BLE001
            print(f"{name}: ERROR {type(e).__name__} {str(e)[:700]}", flush=True)


if __name__ == "__main__":
    main()
