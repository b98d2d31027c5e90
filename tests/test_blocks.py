"""Block tables: change points, timestamp reconstruction, sampling."""

import pytest

from tideline.operators import blocks as bk
from tideline.operators.episodes import half_life


def chain(n_slow=200, n_fast=200, missed=(50, 120, 260)):
    out, t = [], 1_000_000
    for n in range(1, n_slow + n_fast + 1):
        out.append((n, t))
        step = 1_500 if n < n_slow else 750
        t += step + (3_000 if n in missed else 0)
    return out


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(chain(), "number bigint, milli_ts bigint")


@pytest.mark.parametrize("bounded", [True, False])
def test_change_point_is_exact(table, bounded):
    got = bk.change_point(bk.with_intervals(table, bounded=bounded), 1.125).first()
    assert got.change_block == 200


def test_forward_means_cross_range_borders(spark, monkeypatch):
    monkeypatch.setattr(bk, "RANGE", 90)
    df = spark.createDataFrame(chain(), "number bigint, milli_ts bigint")
    assert bk.change_point(bk.with_intervals(df), 1.125).first().change_block == 200


def test_intervals_skip_missing_numbers(table):
    rows = {r.number: r.interval for r in bk.with_intervals(table.filter("number <> 10")).collect()}
    assert rows[1] is None and rows[11] is None and rows[12] == 1.5


def test_fill_timestamps_and_irregular_spans(spark):
    full = chain(missed=(150,))
    known = {n: t for n, t in full if n % 40 == 1 or n == 400}
    anchors = spark.createDataFrame(list(known.items()), "number bigint, milli_ts bigint")
    spans = bk.irregular_spans(anchors, 200, 1_500, 750).collect()
    assert [(r.start, r.stop, r.excess_ms, r.too_fast) for r in spans] == [(121, 161, 3_000, False)]
    wanted = {r.number for r in bk.refinement_requests(bk.irregular_spans(anchors, 200, 1_500, 750)).collect()}
    assert wanted == set(range(122, 161))
    refined = spark.createDataFrame([(n, t) for n, t in full if n in known or n in wanted], "number bigint, milli_ts bigint")
    filled = {r.number: (r.milli_ts, r.fetched) for r in bk.fill_timestamps(refined, 200, 1_500, 750).collect()}
    assert filled == {n: (t, n in known or n in wanted) for n, t in full}


def test_impossible_span_is_flagged(spark):
    anchors = spark.createDataFrame([(1, 0), (11, 14_000)], "number bigint, milli_ts bigint")
    assert bk.irregular_spans(anchors, 1_000, 1_500, 750).first().too_fast


def test_long_span_asks_for_its_midpoint(spark):
    anchors = spark.createDataFrame([(1, 0), (101, 160_000)], "number bigint, milli_ts bigint")
    assert [r.number for r in bk.refinement_requests(bk.irregular_spans(anchors, 1_000, 1_500, 750)).collect()] == [51]


def test_bracket(spark):
    runs = [(s, n, t) for n, t in chain() for s in [n - n % 50] if n % 50 < 30]
    df = spark.createDataFrame(runs, "run_start bigint, number bigint, milli_ts bigint")
    r = bk.bracket_change_point(df, 1.125).first()
    assert (r.slow_block, r.fast_block) == (150, 230)


def test_contiguity(table):
    assert bk.contiguity(table).first().contiguous
    assert not bk.contiguity(table.filter("number <> 7")).first().contiguous


def test_half_life_of_known_process(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = np.zeros(2_000)
    for i in range(1, len(x)):
        x[i] = 0.8 * x[i - 1] + rng.normal()
    df = spark.createDataFrame([("p", i * 60_000, float(v)) for i, v in enumerate(x)], "pool string, ts bigint, dev double")
    rho = np.cov(x[:-1], x[1:])[0, 1] / np.var(x[:-1])
    for bounded in (True, False):
        assert half_life(df, ["pool"], ["ts"], "dev", bounded=bounded).first().half_life == pytest.approx(np.log(0.5) / np.log(rho))


def test_spines_and_grids_are_spread(spark):
    from pyspark.sql import functions as F

    from tideline.operators.asof import time_grid

    spine = bk.number_spine(spark.createDataFrame([("p", 1, 5_000_000)], "k string, a bigint, b bigint"), ["k"], "a", "b")
    grid = time_grid(spark.createDataFrame([("p", 0, 20 * 86_400_000)], "k string, t0 bigint, t1 bigint"), ["k"], "t0", "t1", 10_000, "ts")
    for df, n in ((spine, 5_000_000), (grid, 20 * 8_640 + 1)):
        sizes = [r["n"] for r in df.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert sum(sizes) == n and len(sizes) > 1
