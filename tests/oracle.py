"""Spark rows against DuckDB rows, in any order."""

import os

import duckdb
import pandas as pd


def _value(v):
    if v is None or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    v = v.item() if hasattr(v, "item") else v
    return float(v) if isinstance(v, int) and not isinstance(v, bool) else v


def rows(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)].astype(object)
    return sorted(repr([_value(v) for v in r]) for r in df.values.tolist())


def assert_same(spark_df, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        path = os.path.join(sf_dir, f)
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    expected, found = con.execute(sql).df(), spark_df.toPandas()
    assert sorted(expected.columns) == sorted(found.columns)
    assert rows(found) == rows(expected)
