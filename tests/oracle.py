"""Comparison of a Spark result with DuckDB's."""

from decimal import Decimal

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def text(x):
    if x is None or x is pd.NaT or isinstance(x, float) and np.isnan(x):
        return ""
    return f"{float(x):.9g}" if isinstance(x, (float, Decimal)) else str(x)


def normal(df):
    df = df[sorted(df.columns)].map(text)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def duck(sf_dir, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con.execute(sql).fetchdf()


def assert_same(got, want):
    a, b = normal(got), normal(want)
    assert list(a.columns) == list(b.columns)
    assert len(a) == len(b)
    differing = (a != b).any(axis=1)
    assert not differing.any(), f"{a[differing].head()}\n{b[differing].head()}"
