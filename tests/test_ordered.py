"""Sliced plans equal the one-window plans and brute force, hot buckets included."""

import random

import pytest
from pyspark.sql import functions as F

from tideline.operators import asof, episodes, ordered, quantiles
from tideline.operators.slices import BUCKET, hot_edges, with_slices

ROWS = 600


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = []
    for i in range(ROWS):
        key = "hot" if i % 3 else rng.choice(["a", "b"])
        ts = 1_000 + rng.randrange(2_000) if i % 2 else 5_000_000 + rng.randrange(900_000_000)
        data.append((key, ts, i, float(rng.randrange(50)), None if rng.random() < 0.6 else float(i)))
    return spark.createDataFrame(data, "k string, ts bigint, id bigint, v double, x double").cache()


def collected(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


@pytest.mark.parametrize(
    "operator,names",
    [
        (ordered.previous_row, {"p": "v", "pt": "ts"}),
        (ordered.next_row, {"n": "v"}),
        (ordered.carry_forward, {"f": "x"}),
        (ordered.carry_backward, {"f": "x"}),
        (ordered.running_total, {"s": "v"}),
    ],
)
@pytest.mark.parametrize("width,max_rows", [(3_600_000, 4_000_000), (10**10, 40), (1_000_000, 25)])
def test_sliced_equals_window(rows, operator, names, width, max_rows):
    args = (["k"], ["ts", "id"], names)
    whole = operator(rows, *args, bounded=True)
    cut = operator(rows, *args, width=width, max_rows=max_rows, bounded=False)
    assert collected(whole) == collected(cut)


def test_hot_bucket_is_split(rows):
    edges = hot_edges(rows, ["k"], "ts", 10**10, 40)
    sizes = with_slices(rows, ["k"], "ts", 10**10, edges).groupBy("k", BUCKET, "_part").count().agg(F.max("count")).first()[0]
    assert sizes < 120 < rows.filter("k = 'hot'").count()


def test_no_hot_bucket_means_no_edges(rows):
    assert hot_edges(rows, ["k"], "ts", 1_000, 10_000) is None


def test_running_maximum_sliced(rows):
    a = episodes.running_maximum(rows, ["k"], ["ts", "id"], {"m": "v"}, bounded=True)
    b = episodes.running_maximum(rows, ["k"], ["ts", "id"], {"m": "v"}, width=50_000, bounded=False)
    assert collected(a) == collected(b)


@pytest.mark.parametrize("bounded", [True, False])
def test_as_of_matches_brute_force(spark, bounded):
    rng = random.Random(3)
    marks = sorted(rng.sample(range(0, 20_000_000, 500), 150))
    ticks = [("s", t, float(i)) for i, t in enumerate(marks)]
    asks = [("s", i, rng.randrange(0, 21_000_000)) for i in range(200)] + [("s", 900 + i, t) for i, t in enumerate(marks[:20])]
    right = spark.createDataFrame(ticks, "sym string, ts bigint, price double")
    left = spark.createDataFrame(asks, "sym string, id bigint, q bigint")
    got = {r.id: r.p for r in asof.as_of(left, right, ["sym"], F.col("q"), "ts", {"p": "price"}, bounded=bounded).collect()}
    want = {i: next((p for _, t, p in reversed(ticks) if t <= q), None) for _, i, q in asks}
    assert got == want


@pytest.mark.parametrize("bounded", [True, False])
def test_as_of_many_equals_separate_passes(spark, bounded):
    right = spark.createDataFrame([("s", t, float(t)) for t in range(0, 10_000_000, 77_777)], "sym string, ts bigint, price double")
    left = spark.createDataFrame([("s", i, i * 41_113) for i in range(250)], "sym string, id bigint, q bigint")
    shifts = {"now": 0, "before": -60_000, "after": 90_000}
    queries = {n: (F.col("q") + s, "price") for n, s in shifts.items()}
    many = {r.id: r for r in asof.as_of_many(left, right, ["sym"], ["id"], queries, "ts", bounded=bounded).collect()}
    assert len(many) == 250
    for n, s in shifts.items():
        for r in asof.as_of(left, right, ["sym"], F.col("q") + s, "ts", {"p": "price"}, bounded=True).collect():
            assert many[r.id][n] == r.p


def test_quantiles_distributed_equal_builtin(rows):
    wanted = [quantiles.Quantile(f"q{i}", c, q) for i, (c, q) in enumerate([(F.col("v"), 0.1), (F.col("v"), 0.5), (-F.col("x"), 0.9), (F.col("v") - 25, 0.37)])]
    aggs = [F.count(F.lit(1)).alias("n")]
    a = quantiles.summarise(rows, ["k"], aggs, wanted, bounded=True).orderBy("k").collect()
    b = quantiles.summarise(rows, ["k"], aggs, wanted, bounded=False).orderBy("k").collect()
    for x, y in zip(a, b):
        assert x.k == y.k and x.n == y.n
        for i in range(4):
            assert x[f"q{i}"] == pytest.approx(y[f"q{i}"], abs=1e-9)


def test_quantiles_of_null_group_and_all_null_values(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", None)], "k string, v double")
    got = {r.k: r.m for r in quantiles.summarise(df, ["k"], [F.count(F.lit(1)).alias("n")], [quantiles.Quantile("m", F.col("v"), 0.5)], bounded=False).collect()}
    assert got == {None: 2.0, "a": None}


def test_coverage_gaps(spark):
    done = spark.createDataFrame([("p", 10, 20), ("p", 5, 12), ("p", 30, 31), ("p", 31, 40)], "pool string, start bigint, stop bigint")
    got = [(r.gap_start, r.gap_stop) for r in episodes.coverage_gaps(done, ["pool"], 1, 50).orderBy("gap_start").collect()]
    assert got == [(1, 4), (21, 29), (41, 50)]


def test_episode_lengths(spark):
    flags = [0, 1, 1, 0, 1, 0, 0, 1, 1, 1]
    df = spark.createDataFrame([("p", i * 3_000_000, bool(f)) for i, f in enumerate(flags)], "pool string, ts bigint, o boolean")
    for bounded in (True, False):
        runs = episodes.episodes(df, ["pool"], ["ts"], F.col("o"), bounded=bounded)
        assert sorted(r.length for r in runs.collect()) == [1, 2, 3]


def test_each_time_is_asked_once_and_no_swap_is_folded_away(spark):
    """Answers are found per symbol and time; repeated rows, rows without a symbol and rows before the first tick keep their places."""
    from tideline.plans.enrich import with_references

    rows = [("p", "s", 1, 7, 1_000, 1.0), ("p", "s", 1, 7, 1_000, 2.0), ("q", "s", 1, 7, 1_000, 3.0), ("q", "s", 0, 1, 10, 4.0), ("q", None, 2, 1, 1_000, 5.0)]
    swaps = spark.createDataFrame(rows, "pool string, symbol string, block long, log_index long, ts_ms long, p_post double")
    ticks = spark.createDataFrame([("s", 500, 10.0), ("s", 1_200, 20.0)], "symbol string, ts_ms long, price double")
    candles = spark.createDataFrame([("s", 0, 9.0)], "symbol string, ts_ms long, close double")
    out = with_references(swaps, ticks, candles, horizons_ms={"5": 500})
    got = {r.p_post: (r.p_cex, r.p_cex_h5, r.p_cex_1s) for r in out.collect()}
    assert got == {1.0: (10.0, 20.0, 9.0), 2.0: (10.0, 20.0, 9.0), 3.0: (10.0, 20.0, 9.0), 4.0: (None, 10.0, None), 5.0: (None, None, None)}
    assert out.count() == 5


def test_rows_are_dealt_once_and_counts_stay_where_they_lie(spark):
    """Whole rows are shuffled once per order, and the counts of a quantile aren't dealt again for its bins."""
    from tideline.operators.ordered import previous_row
    from tideline.operators.quantiles import Quantile, exact_quantiles

    df = spark.range(1_000).select((F.col("id") % 3).alias("k"), "id", F.rand(1).alias("v"))
    plan = lambda frame: frame._jdf.queryExecution().executedPlan().toString()
    stepped = plan(previous_row(df, ["k"], ["id"], {"before": "v"}, width=100))
    assert "Scan ExistingRDD" not in stepped and stepped.count("FileScan parquet") == 2
    bins = plan(exact_quantiles(df, ["k"], [Quantile("m", F.col("v"), 0.5)]))
    assert "SortMergeJoin" not in bins and "Scan ExistingRDD" not in bins
