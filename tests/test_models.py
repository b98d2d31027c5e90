"""Least squares, tails, latency estimators and coefficient-table statistics against plain numpy or printed values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.functions import tails
from tideline.operators.gram import Spec, fit, fitted_column
from tideline.plans import estimates as es, latency, price_discovery


def cluster_ols(x, y, g):
    beta = np.linalg.solve(x.T @ x, x.T @ y)
    e = y - x @ beta
    names = np.unique(g)
    meat = sum(np.outer(s, s) for s in (x[g == c].T @ e[g == c] for c in names))
    bread = np.linalg.inv(x.T @ x)
    n, k, c = len(y), x.shape[1], len(names)
    return beta, np.sqrt(np.diag(c / (c - 1) * (n - 1) / (n - k) * bread @ meat @ bread))


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(2)
    n = 240
    data = dict(a=rng.normal(size=n), b=rng.normal(size=n), h=rng.integers(0, 4, n), d=rng.integers(0, 6, n))
    data["y"] = 1 + 0.5 * data["a"] - 0.2 * data["b"] + 0.3 * data["h"] + rng.normal(size=n) * (1 + data["d"] / 3)
    rows = [tuple(float(data[c][i]) if c in "aby" else int(data[c][i]) for c in ("a", "b", "h", "d", "y")) for i in range(n)]
    return data, spark.createDataFrame(rows, "a double, b double, h int, d int, y double").repartition(5).cache()


SPEC = Spec("m", "y", {"a": "a", "b": "b"}, {"h": ("h", (0, 1, 2, 3))}, cluster="d")


def test_cluster_ols_matches_numpy(sample):
    data, df = sample
    x = np.column_stack([np.ones(240), data["a"], data["b"], *[(data["h"] == v) * 1.0 for v in (1, 2, 3)]])
    beta, se = cluster_ols(x, data["y"], data["d"])
    got = {r.term: r for r in fit(df, [SPEC]).collect()}
    for i, name in enumerate(["intercept", "a", "b", "h=1", "h=2", "h=3"]):
        assert got[name].b == pytest.approx(beta[i], abs=1e-10) and got[name].se == pytest.approx(se[i], abs=1e-10)
        assert got[name].p == pytest.approx(math.erfc(abs(beta[i] / se[i]) / math.sqrt(2)), abs=1e-10)
    assert got["a"].n == 240 and got["a"].clusters == 6


def test_many_models_in_one_pass(sample):
    data, df = sample
    specs = [SPEC.variant(name=f"w{i}", where=f"a > {-2 + i * 0.5}") for i in range(4)]
    got = {r.model_name: r for r in fit(df, specs).filter("term = 'a'").collect()}
    for i in range(4):
        k = data["a"] > -2 + i * 0.5
        x = np.column_stack([np.ones(k.sum()), data["a"][k], data["b"][k], *[(data["h"][k] == v) * 1.0 for v in (1, 2, 3)]])
        beta, se = cluster_ols(x, data["y"][k], data["d"][k])
        assert (got[f"w{i}"].b, got[f"w{i}"].se) == (pytest.approx(beta[1], abs=1e-9), pytest.approx(se[1], abs=1e-9))


def test_missing_values_and_constant_columns_drop_out(spark, sample):
    _, df = sample
    holes = df.withColumn("a", F.when(F.col("d") == 5, F.lit(float("nan"))).otherwise(F.col("a"))).withColumn("always", F.lit(1))
    got = {r.term: r for r in fit(holes, [SPEC.variant(terms={"a": "a", "always": "always"})]).collect()}
    assert "always" not in got and got["a"].clusters == 5


def test_too_few_rows_give_no_estimate(sample):
    _, df = sample
    assert fit(df, [SPEC.variant(where="a > 2.5")]).count() == 0


def test_residuals_sum_to_zero(sample):
    _, df = sample
    rows = fitted_column(df, SPEC, fit(df, [SPEC]))
    assert rows.agg(F.sum("residual")).first()[0] == pytest.approx(0, abs=1e-8)


def test_placebo_shifts_the_trend():
    spec = es.placebo(es.panel_spec("m", "volume", ["p", "q"], "rd", 30), -15)
    assert spec.terms["post"].startswith("(CASE WHEN t_days >= -15") and "post = 0" in spec.where and "+" not in spec.terms["t_days"]


def test_wald_of_equal_slopes(spark):
    rng = np.random.default_rng(4)
    rows = [(g, int(i % 20), float(x), float(0.4 * x + rng.normal(0, 0.1))) for g in ("u", "v") for i in range(200) for x in [rng.normal()]]
    df = spark.createDataFrame(rows, "g string, d int, x double, y double")
    terms = {f"x:{g}": f"CASE WHEN g = '{g}' THEN x ELSE 0.0 END" for g in ("u", "v")}
    spec = Spec("m", "y", terms, cluster="concat(g, d)", wald=(("x:u", "x:v"),))
    assert fit(df, [spec]).first().wald_p > 0.01
    bent = df.withColumn("y", F.when(F.col("g") == "u", F.col("y") + F.col("x")).otherwise(F.col("y")))
    assert fit(bent, [spec]).first().wald_p < 1e-6


@pytest.mark.parametrize("x,df,p", [(3.841459, 1, 0.05), (5.991465, 2, 0.05), (7.814728, 3, 0.05), (11.070498, 5, 0.05), (9.487729, 4, 0.05)])
def test_chi_square(x, df, p):
    assert tails.chi_square_upper(x, df) == pytest.approx(p, abs=1e-6)


@pytest.mark.parametrize("t,df,p", [(2.228139, 10, 0.05), (12.706205, 1, 0.05), (2.045230, 29, 0.05), (0.0, 5, 1.0)])
def test_student(t, df, p):
    assert tails.student_two_sided(t, df) == pytest.approx(p, abs=1e-6)


def test_pooling_and_latency_floor(spark):
    # intervals before and after three changes with a true latency of 0.9 s
    changes = [(3.0, 1.5, 0.04), (1.5, 0.75, 0.05), (0.75, 0.45, 0.06)]
    rows = [("s", 0.5 * math.log((b + 0.9) / (a + 0.9)), se, a, b) for a, b, se in changes]
    df = spark.createDataFrame(rows, "name string, b double, se double, dt_pre double, dt_post double")
    f = es.latency_floor(df, ["name"]).first()
    assert f.ell == pytest.approx(0.9, abs=0.0006) and f.chi2_min < 1e-4 and f.ell_low < 0.9 < f.ell_high and f.k == 3
    b, se = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    pooled = es.pool_estimates(df, ["name"]).first()
    assert pooled.b == pytest.approx((b / se**2).sum() / (1 / se**2).sum()) and pooled.se == pytest.approx((1 / se**2).sum() ** -0.5)
    assert pooled.q == pytest.approx((((b - pooled.b) / se) ** 2).sum()) and pooled.q_p == pytest.approx(math.exp(-pooled.q / 2))


def test_turnbull_of_separated_intervals(spark):
    # two thirds of the latencies lie in (100, 200], one third in (500, 600]
    df = spark.createDataFrame([("x", 100, 200)] * 40 + [("x", 500, 600)] * 20, "g string, lo_ms bigint, hi_ms bigint")
    counts = latency.counted_intervals(df, ["g"], "lo_ms", "hi_ms", 100, 1_000)
    mass = {r.grid_ms: r.mass for r in latency.turnbull(counts, ["g"], 100, 1_000).collect()}
    assert mass[200] == pytest.approx(2 / 3) and mass[600] == pytest.approx(1 / 3) and sum(mass.values()) == pytest.approx(1)


def test_lognormal_recovers_truth(spark):
    rng = np.random.default_rng(8)
    ell = np.exp(rng.normal(math.log(300), 0.4, 4_000))
    u = rng.uniform(0, 750, 4_000)
    df = spark.createDataFrame([("x", int(max(t - 750, 0)), int(t)) for t in ell + u], "g string, lo_ms bigint, hi_ms bigint")
    r = latency.lognormal_fit(df, ["g"], "lo_ms", "hi_ms").first()
    assert r.median_ms == pytest.approx(300, rel=0.08) and r.sigma == pytest.approx(0.4, rel=0.25)


def test_lognormal_keeps_rows_that_no_grid_point_represents(spark):
    pairs = [(101, 109), (12_000, 30_000), (50, 500), (0, 40), (300, 900), (305, 306), (20_000, 20_001)] * 30
    df = spark.createDataFrame([("x", a, b) for a, b in pairs], "g string, lo_ms bigint, hi_ms bigint")
    r = latency.lognormal_fit(df, ["g"], "lo_ms", "hi_ms").first()
    left, right = np.array(pairs, float).T

    def loss(mu, s):
        cdf = lambda x: 0.5 * (1 + math.erf((math.log(x) - mu) / s / math.sqrt(2))) if x > 0 else 0.0
        return -sum(math.log(max(cdf(b) - cdf(a), 1e-300)) for a, b in pairs)

    mu, s = math.log(r.median_ms), r.sigma
    assert r.n == len(pairs) and r.converged and all(loss(mu, s) <= loss(mu + d, s * e) + 1e-6 for d in (-0.01, 0, 0.01) for e in (0.99, 1, 1.01))
    lost = latency.grid_losses(df, ["g"], "lo_ms", "hi_ms").first()
    assert (lost.n, lost.within_one_step, lost.beyond_top) == (210, 60, 60)


def test_turnbull_meets_the_optimality_conditions(spark):
    rng = np.random.default_rng(4)
    rows = [("x", int(a), int(a + w)) for a, w in zip(rng.integers(0, 700, 300), rng.integers(5, 300, 300))]
    counts = latency.counted_intervals(spark.createDataFrame(rows, "g string, lo_ms bigint, hi_ms bigint"), ["g"], "lo_ms", "hi_ms", 10, 1_200)
    pdf = counts.toPandas()
    out = latency.turnbull(counts, ["g"], 10, 1_200).orderBy("grid_ms").toPandas()
    mass = out["mass"].to_numpy()
    covers = np.array([[l <= k < h for k in range(len(mass))] for l, h in zip(pdf["lo"], pdf["hi"])], float)
    gradient = (pdf["n"].to_numpy() / (covers @ mass)) @ covers
    assert out["converged"].all() and mass.sum() == pytest.approx(1) and gradient.max() <= pdf["n"].sum() * (1 + 1e-5)


def test_turnbull_converges_where_every_interval_is_as_wide_as_a_block(spark):
    # whole milliseconds, intervals a minute wide: plain expectation-maximisation leaves these open after all its rounds
    rng = np.random.default_rng(12)
    tau = np.maximum(rng.exponential(90_000, 400).astype(int), 1)
    rows = [("x", int(max(t - 60_000, 0)), int(t)) for t in tau]
    counts = latency.counted_intervals(spark.createDataFrame(rows, "g string, lo_ms bigint, hi_ms bigint"), ["g"], "lo_ms", "hi_ms", 1, 1_500_000)
    assert counts.agg(F.sum("n")).first()[0] == len(rows)
    sets = latency.turnbull_sets(counts, ["g"]).toPandas()
    chance = np.array([sets["mass"][(sets["lo"] > a) & (sets["hi"] <= b + 1)].sum() for _, a, b in rows])
    left, right = np.array([r[1:] for r in rows]).T
    gradient = [((left < p) & (p <= right)) @ (1 / chance) for p in range(1, 600_000, 97)]
    assert sets["converged"].all() and sets["mass"].sum() == pytest.approx(1) and max(gradient) <= len(rows) * (1 + 1e-5)


def test_points_of_sets_are_the_dense_estimate_without_empty_points(spark):
    rng = np.random.default_rng(13)
    rows = [(g, int(a), int(a + w)) for g in "xy" for a, w in zip(rng.integers(0, 700, 200), rng.integers(5, 300, 200))]
    counts = latency.counted_intervals(spark.createDataFrame(rows, "g string, lo_ms bigint, hi_ms bigint"), ["g"], "lo_ms", "hi_ms", 10, 1_200)
    dense = {(r.g, r.grid_ms): r.mass for r in latency.turnbull(counts, ["g"], 10, 1_200).collect() if r.mass > 0}
    points = latency.points_of_sets(latency.turnbull_sets(counts, ["g"]), ["g"], 10).collect()
    assert {(r.g, r.grid_ms): r.mass for r in points} == pytest.approx(dense)


def test_estimate_comparison_counts_openings_answered_within_a_minute(spark, tmp_path):
    # a market a hundred times as dense, where nearly all openings are answered within the minute
    import __spark_entry__ as entry
    from checks import market as m
    from tideline.plans import response as rs

    e = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    near = F.timestamp_micros((F.lit(m.CHANGE_MS * 1000) + (F.unix_micros(F.col("ts").cast("timestamp")) - m.CHANGE_MS * 1000) / 100).cast("bigint"))
    e.withColumn("ts", near.cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    found = {r.pool: r for r in entry.queries()["estimate_comparison"](spark, str(tmp_path)).collect()}
    openings = m.arbs(spark, str(tmp_path)).filter(rs.market_triggered(m.MAX_TAU_MS) & (F.col("regime") == "pre")).select("pool", "tau_lo_ms", "tau_ms").toPandas()
    assert (openings["tau_ms"] < 60_000).mean() > 0.5 and len(openings) > 100
    for pool, own in openings.groupby("pool"):
        left, right = np.maximum(own["tau_lo_ms"].to_numpy(), 0), np.maximum(own["tau_ms"].to_numpy(), 1)
        points = np.arange(1, right.max() + 1)
        mass = np.full(len(points), 1 / len(points))
        for _ in range(400):
            upto = np.concatenate([[0], np.cumsum(mass)])
            weight = 1 / (upto[right] - upto[left])
            mass *= np.cumsum(np.bincount(left, weight, len(points) + 1) - np.bincount(right, weight, len(points) + 1))[:-1] / len(own)
        first = (mass * np.maximum(0, 1 - points / m.DT_POST_MS)).sum()
        root = sum((mass * np.sqrt((points + (i + 0.5) / 200 * m.DT_POST_MS) / 1000)).sum() for i in range(200)) / 200
        before = np.sqrt(own["tau_ms"] / 1000).mean()
        assert found[pool].p_k1_counterfactual == pytest.approx(first, abs=0.01)
        if len(own) >= 30:
            assert found[pool].counterfactual == pytest.approx(math.log(root / before), abs=0.01)


def test_latency_band_takes_every_change(spark):
    changes = spark.createDataFrame([(1.5, 0.75)] * 1200 + [(3.0, 0.2)], "dt_pre double, dt_post double").coalesce(1)
    floors = spark.createDataFrame([("a", 0.9)], "name string, ell double")
    some, all_of_them = (latency.latency_band(floors, c, ["name"]).first() for c in (changes.filter("dt_pre < 2"), changes))
    last = latency.latency_band(floors, changes.filter("dt_pre > 2"), ["name"]).first()
    assert last["ell_mean"] != some["ell_mean"]
    assert abs(all_of_them["ell_mean"] - (1200 * some["ell_mean"] + last["ell_mean"]) / 1201) < 1e-9
    assert last["ell_mean"] in (all_of_them["ell_min"], all_of_them["ell_max"])


def test_latency_band_inverts_the_law(spark):
    changes = spark.createDataFrame([(1.5, 0.75)], "dt_pre double, dt_post double")
    mean = lambda x, dt: np.sqrt(x + np.linspace(0, dt, 200_001)).mean()
    r = (mean(0.4, 0.75) / mean(0.4, 1.5)) ** 2
    ell = float((r * 1.5 - 0.75) / (1 - r))
    rows = {x.name: x for x in latency.latency_band(spark.createDataFrame([("a", ell), ("b", 60.0)], "name string, ell double"), changes, ["name"]).collect()}
    assert rows["a"].ell_mean == pytest.approx(0.4, abs=1e-3) and not rows["a"].at_edge and rows["b"].at_edge


def test_fixed_latency_gives_no_latency_change(spark):
    # latency fixed at 300 ms, waiting uniform over the interval
    n, dt0, dt1 = 4_000, 750, 450
    rng = np.random.default_rng(9)
    tau = lambda dt: 300 + rng.uniform(0, dt, n)
    df = spark.createDataFrame([("x", int(max(t - dt0, 0)), int(t)) for t in tau(dt0)], "g string, lo_ms bigint, hi_ms bigint")
    masses = latency.turnbull(latency.counted_intervals(df, ["g"], "lo_ms", "hi_ms"), ["g"])
    cf = latency.fixed_latency_counterfactual(masses, ["g"], F.lit(float(dt1))).first().mean_sqrt_s
    actual = np.sqrt(tau(dt1) / 1000).mean()
    assert math.log(cf / actual) == pytest.approx(0, abs=0.02)
    summary = latency.mass_summary(masses, ["g"], F.lit(float(dt0))).first()
    assert abs(summary.median - 300) <= 40


def test_bootstrap_error_is_reasonable(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([("x", i, int(v)) for i, v in enumerate(rng.uniform(0, 1000, 900))], "g string, id bigint, tau_ms bigint")
    r = latency.bootstrap_intercept_se(df, ["g"], F.lit(100.0), 0.5, draws=150).first()
    assert r.draws == 150 and 8 < r.se < 30  # theory: 1000 * sqrt(0.25 / 900) = 16.7


@pytest.mark.parametrize("bounded", [True, False])
def test_information_share_of_a_leading_price(spark, bounded):
    rng = np.random.default_rng(6)
    n = 4_000
    lead = np.cumsum(rng.normal(0, 1e-3, n))
    follow = np.zeros(n)
    for i in range(1, n):
        follow[i] = follow[i - 1] + 0.3 * (lead[i - 1] - follow[i - 1]) + rng.normal(0, 2e-4)
    df = spark.createDataFrame([("p", i * 1_000, float(follow[i]), float(lead[i])) for i in range(n)], "pool string, ts_ms bigint, a double, b double")
    r = price_discovery.information_shares(df, ["pool"], "ts_ms", "a", "b", 1_000, lags=3, bounded=bounded).first()
    assert r.share_upper < 0.2 and r.alpha_first == pytest.approx(-0.3, abs=0.05) and r.beta_second == pytest.approx(-1, abs=0.05)


def _brute_lags(times, series, lags):
    """Differences, levels before and ``lags`` lags of two series, row by row."""
    change = [[None, *[b - a for a, b in zip(s, s[1:])]] for s in series]
    at = lambda s, i: s[i] if i >= 0 else None
    return {t: [change[0][i], change[1][i], at(series[0], i - 1), at(series[1], i - 1), *[at(d, i - k) for k in range(1, lags + 1) for d in change]] for i, t in enumerate(times)}


def test_lagged_changes_reach_over_the_edge_of_a_bucket(spark):
    rng = np.random.default_rng(14)
    step, n = 1_000, 40
    times = [99_980 * step + i * step for i in range(n)]  # buckets are 100,000 steps wide
    a, b = rng.normal(size=(2, n)).tolist()
    df = spark.createDataFrame([("p", t, x, y) for t, x, y in zip(times, a, b)], "pool string, ts_ms bigint, a double, b double")
    out = price_discovery.lagged_changes(df, ["pool"], "ts_ms", {"da": "a", "db": "b"}, 10, step)
    names = ["da", "db", "a_before", "b_before", *[f"{c}_{k}" for k in range(1, 11) for c in ("da", "db")]]
    assert {r.ts_ms: [r[c] for c in names] for r in out.collect()} == _brute_lags(times, [a, b], 10)


def test_lagged_differences_hold_ten_lags_of_both_prices(spark, sf):
    import __spark_entry__ as entry
    from checks.q_swaps import market_series

    series = market_series(spark, sf).orderBy("pool", "ts_ms").toPandas()
    names = ["dp", "dc", "x_before", "y_before", *[f"{c}_{k}" for k in range(1, 11) for c in ("dp", "dc")]]
    found = entry.queries()["lagged_differences"](spark, sf).toPandas()
    assert sorted(found.columns) == sorted(["pool", "ts_ms", *names]) and len(found) == len(series)
    for pool, own in series.groupby("pool"):
        brute = _brute_lags(own["ts_ms"].tolist(), [np.log(own[c].to_numpy()).tolist() for c in ("p_pool", "p_cex")], 10)
        rows = found[found["pool"] == pool].set_index("ts_ms")[names].loc[list(brute)].to_numpy(float)
        assert np.allclose(rows, np.array(list(brute.values()), float), atol=1.1e-8, equal_nan=True)


def test_lagged_differences_agree_with_sql(spark, sf):
    import duckdb

    import __spark_entry__ as entry
    from checks.compare import rows_of

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    result = con.execute(entry.oracle_sql()["lagged_differences"])
    names = [d[0] for d in result.description]
    frame = entry.queries()["lagged_differences"](spark, sf)
    assert sorted(frame.columns) == sorted(names) and "dc_10" in names
    assert rows_of(frame.columns, [tuple(r) for r in frame.collect()]) == rows_of(names, result.fetchall())


def test_published_estimates_reproduce_pooled_values(spark):
    # printed estimates, errors and intervals of three changes; results are known to the printed precision
    rows = [("s", -0.293, 0.036, 3.0, 1.5), ("s", -0.110, 0.041, 1.5, 0.75), ("s", -0.115, 0.037, 0.75, 0.45)]
    df = spark.createDataFrame(rows, "name string, b double, se double, dt_pre double, dt_post double")
    f = es.next_halving(es.latency_floor(df, ["name"]), 0.45).first()
    assert f.ell == pytest.approx(0.94, abs=0.02) and f.ell_low == pytest.approx(0.51, abs=0.02) and f.ell_high == pytest.approx(1.65, abs=0.02)
    assert f.chi2_min == pytest.approx(5.52, abs=0.2) and f.chi2_zero == pytest.approx(49.3, abs=1.0)
    assert f.next_halving == pytest.approx(-0.089, abs=0.002) and f.floor_relative == pytest.approx(0.82, abs=0.01)
    changes = spark.createDataFrame([("c1", 3.0, 1.5), ("c2", 1.5, 0.75), ("c3", 0.75, 0.45)], "change string, dt_pre double, dt_post double")
    named = spark.createDataFrame([("c1", -0.293, 0.036), ("c2", -0.110, 0.041), ("c3", -0.115, 0.037)], "change string, b double, se double")
    e = es.law_and_elasticity(named, changes).select(F.col("elasticity").alias("b"), F.col("elasticity_se").alias("se"), F.lit(1).alias("g"))
    p = es.pool_estimates(e, ["g"], against=0.5).first()
    assert p.b == pytest.approx(0.289, abs=0.002) and p.se == pytest.approx(0.035, abs=0.001) and p.t == pytest.approx(-6.1, abs=0.15)
