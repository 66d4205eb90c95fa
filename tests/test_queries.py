"""Every registered query of the library against its SQL in DuckDB."""

import datetime
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from quern import plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES.split():
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (list, np.ndarray)):
        return [plain(x) for x in v]
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, datetime.date):
        return datetime.datetime(v.year, v.month, v.day, getattr(v, "hour", 0), getattr(v, "minute", 0), getattr(v, "second", 0)).isoformat()
    if isinstance(v, np.generic):
        v = v.item()
    return int(v) if isinstance(v, float) and v.is_integer() else v


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted(repr([plain(v) for v in x]) for x in frame[cols].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query(spark, duck, name):
    assert rows(plans.queries()[name](spark, SF).toPandas()) == rows(duck.sql(plans.oracle_sql()[name]).df())


def test_all_have_sql():
    assert set(plans.queries()) == set(plans.oracle_sql())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(plans.queries()) <= set(__spark_entry__.queries())
