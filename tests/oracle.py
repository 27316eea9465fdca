"""Compares a query with its SQL on the same tables."""

import math

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def rows(df, columns):
    def plain(v):
        if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return None
        return round(float(v), 9) if hasattr(v, "__float__") and not isinstance(v, (bool, str)) else str(v)

    return sorted((tuple(plain(v) for v in r) for r in df[columns].astype(object).itertuples(index=False)), key=repr)


def assert_same(found, sql, sf=SF):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    a, b = found.toPandas(), db.sql(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    columns = sorted(a.columns)
    assert rows(a, columns) == rows(b, columns)
