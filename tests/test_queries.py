"""Registered queries against their SQL on the small tables."""

import os
import sys

import duckdb
import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from selectra.plans import catalog, fixtures  # noqa: E402

DATA = "/root/testdata/sf0.001"
#: A query of each family; the driver compares all of them.
NAMES = ["flagship", "scalar_score", "screen_text", "diff_summary", "detect_regression", "sample_stats", "rank_percentiles", "operator_stats", "group_jaccard", "tipping_points", "evolution_report", "plateau_monitor", "nearest", "near_duplicates", "run_gates", "stream_event_counts", "retention_plan", "mention_counts"]


def plain(value):
    if isinstance(value, (list, tuple, np.ndarray)):
        return tuple(map(plain, value))
    if value is None or value is pd.NaT or isinstance(value, float) and np.isnan(value):
        return None
    return round(float(value), 6) if isinstance(value, (int, float, np.number)) and not isinstance(value, bool) else str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in fixtures.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not there")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    got, want = catalog.queries()[name](spark, DATA).toPandas(), duck.execute(catalog.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    table = lambda df: sorted(map(repr, (tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))))
    assert table(got) == table(want)


def test_every_sql_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
