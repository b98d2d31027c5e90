"""The registered queries: names, SQL twins, and agreement on the smallest tables for a spread of them."""

import duckdb
import pytest

import __spark_entry__ as entry
from checks.compare import rows_of

SPREAD = ["hourly_deviation", "prev_price_sliced", "asof_backward_sliced", "swap_metrics", "last_inside_band_sliced", "opening_classify", "hourly_panel_sliced", "connected_operators", "ols_fe_cluster", "stream_hourly_panel", "exact_quantiles_sliced"]


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_twins_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 180


@pytest.mark.parametrize("name", SPREAD)
def test_agrees_with_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("events", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    frame = entry.queries()[name](spark, sf)
    result = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(frame.columns) == sorted(names)
    assert rows_of(frame.columns, [tuple(r) for r in frame.collect()]) == rows_of(names, result.fetchall())
