"""Compares a query with its SQL, order apart."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, float, Decimal, np.integer, np.floating)):
        return None if math.isnan(v) else float(f"{float(v):.9g}")
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(map(plain, v))
    return v.isoformat() if isinstance(v, pd.Timestamp) else v


def rows(df: pd.DataFrame) -> list:
    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def same(spark, build, sql: str) -> None:
    got, want = build(spark, str(DATA)).toPandas(), duck().execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
