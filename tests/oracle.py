"""Compare a query with its DuckDB SQL, order aside."""

import os

import pandas as pd
import pytest

DATA = os.environ.get("SKEIN_TESTDATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip(f"no tables in {DATA}")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if value is None or value is pd.NA or value is pd.NaT or (isinstance(value, float) and value != value):
        return None
    kind = type(value).__name__
    if kind in ("bool", "bool_"):
        return str(bool(value))
    return f"{float(value):.9g}" if kind in ("float", "float32", "float64", "Decimal") else str(value)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(plain(v) for v in r) for r in frame.itertuples(index=False)), key=lambda r: tuple((v is None, v or "") for v in r))


def agree(spark, con, query, sql):
    ours, theirs = query(spark, DATA).toPandas(), con.sql(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
