"""Every query with SQL agrees with another engine on a small scale factor."""

import numbers
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from quillon.plans import catalogue

DATA = os.environ.get("ORACLE_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def _value(x):
    if not isinstance(x, (list, str)) and pd.isna(x):
        return None
    return round(float(x), 9) + 0.0 if isinstance(x, numbers.Number) else str(x)


def _rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(map(_value, r)) for r in frame.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA).toPandas()
    if name not in catalogue.ORACLES:
        assert len(got) > 0 and not [c for c in got if got[c].dtype.kind == "f" and not np.isfinite(got[c]).all()]
        return
    want = duck.execute(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)
