"""Tables across studies, on two studies whose effects are known."""

import dataclasses
import math
import random

import pytest
from pyspark.sql import functions as F

from tideline.plans import studies as st
from tideline.plans.jobs import Study

ELL, DAY = 0.3, 86_400_000
CHANGES = {"first": (3_000, 1_500, 1_700_006_400_000), "second": (1_500, 750, 1_710_006_400_000)}
POOLS = ("a", "b")


def effect(pre, post):
    return 0.5 * math.log((post / 1000 + ELL) / (pre / 1000 + ELL))


@pytest.fixture(scope="module")
def studies(spark, tmp_path_factory):
    rng, out = random.Random(4), {}
    for name, (pre, post, at) in CHANGES.items():
        root = str(tmp_path_factory.mktemp(name))
        b = effect(pre, post)
        coefficients = [(f"overshoot_strict_bps|30|sigma|{p}", "post", b, 0.01, 0.001, 900, 60) for p in POOLS] + [("overshoot_strict_bps|30|sigma|POOLED", "post", 9.0, 0.01, 0.0, 900, 60)]
        spark.createDataFrame(coefficients, "model_name string, term string, b double, se double, p double, n bigint, clusters bigint").write.parquet(f"{root}/tables/coefficients")
        hours = []
        for pool in POOLS:
            for h in range(-24 * 20, 24 * 20):
                dt, sigma, liq, volume = (pre if h < 0 else post) / 1000, math.exp(rng.gauss(-8, 0.4)), math.exp(rng.gauss(3, 0.2)), math.exp(rng.gauss(5, 0.5))
                y = math.exp(0.5 * math.log(dt) + 0.8 * math.log(sigma) + 0.1 * math.log(liq) + rng.gauss(0, 0.05))
                hours.append((pool, at + h * 3_600_000, y, sigma, liq, volume, int(h >= 0), h % 24, f"d{h // 24}", h / 24.0, dt, y * 2, y / 3, 5, 2.0))
        schema = "pool string, hour_ms bigint, overshoot_strict_bps double, sigma_ps double, liq_mean double, volume double, post int, hod int, day string, t_days double, dt double, overshoot_bps double, mean_abs_dev_pre double, n_arb int, arb_profit double"
        spark.createDataFrame(hours, schema).withColumn("ref_gap_bps", F.lit(1.5)).write.parquet(f"{root}/panel")
        write = lambda rows, schema, table: spark.createDataFrame(rows, schema).write.parquet(f"{root}/tables/{table}")
        write([(p, r, 1.2 if r == "pre" else 1.0) for p in POOLS for r in ("pre", "post")], "pool string, regime string, mean_sqrt_s double", "response_stats_all")
        write([(p, 0.9, 0.5) for p in POOLS], "pool string, mean_sqrt_s double, p_first double", "counterfactual_all")
        write([(p, -0.3, -0.2, 0.4) for p in POOLS], "pool string, law double, implied double, p_k1_post_actual double", "implied_effects_all")
        write([("cex_move", "post", -0.4), ("continuation", "post", -0.1), ("cex_jump", "post", 0.0)], "model_name string, term string, b double", "component_coefficients_all")
        write([(p, c, w) for p in POOLS for c, w in (("cex_jump", 0.3), ("cex_move", 0.5), ("continuation", 0.2))], "pool string, component string, weight double", "component_weights_all")
        write([(p, r, 7.0, 3) for p in POOLS for r in ("pre", "post")], "pool string, regime string, median_dev double, n_swaps bigint", "regime_table")
        out[name] = Study(root, 1, at, pre, post, POOLS)
    return out


def test_tables_across_studies(spark, studies, tmp_path):
    out = str(tmp_path / "across")
    tables = st.compare_studies(spark, studies, out, treated=("second",), other_reference={"first": studies["first"]})
    read = lambda name: spark.read.parquet(f"{out}/{name}")
    assert all(read(name).columns for name in tables)
    by_change = {r.change: r for r in read("pooled_by_change").collect()}
    for name, (pre, post, _) in CHANGES.items():
        assert by_change[name].b == pytest.approx(effect(pre, post)) and by_change[name].k == 2 and by_change[name].se == pytest.approx(0.01 / math.sqrt(2))
    floor = read("latency_floor").first()
    assert floor.ell == pytest.approx(ELL, abs=0.002) and floor.ell_low < ELL < floor.ell_high and floor.k == 4
    ahead = read("next_halving").first()
    assert ahead.next_halving == pytest.approx(0.5 * math.log((0.375 + ELL) / (0.75 + ELL)), abs=0.002)
    step = read("elasticity_steps").first()
    elasticity = [effect(*CHANGES[n][:2]) / math.log(0.5) for n in ("first", "second")]
    assert step.before == "first" and step.d == pytest.approx(elasticity[1] - elasticity[0]) and step.z == pytest.approx(step.d / step.d_se)
    levels = [r.level for r in read("chained_levels").orderBy("position").collect()]
    assert levels == pytest.approx([math.exp(effect(3_000, 1_500)), math.exp(effect(3_000, 1_500) + effect(1_500, 750))])
    assert read("latency_band").count() == 1


def test_stacked_models_recover_the_elasticity(spark, studies):
    tables = st.stacked_tables(spark, studies, "overshoot_strict_bps", list(POOLS), 30, treated=("second",))
    found = {(r.model_name.split("|")[1], r.term): r.b for r in tables["stacked_elasticity"].collect()}
    assert set(found) == {("one", "log_dt"), ("by_change", "log_dt:first"), ("by_change", "log_dt:second")}
    assert all(b == pytest.approx(0.5, abs=0.03) for b in found.values())
    did = {r.term: r for r in tables["difference_in_differences"].collect()}
    assert abs(did["post_treated"].b) < 0.05 and 0 <= did["post_treated"].p_t <= 1
    assert tables["means_by_change"].count() == 4


def test_tables_of_one_study(spark, studies):
    tables = st.study_tables(spark, studies["first"], "overshoot_strict_bps", 30, "sigma")
    compared = tables["estimate_comparison"].filter("pool = 'a'").first()
    assert compared.counterfactual == pytest.approx(math.log(0.9 / 1.2)) and compared.estimate == pytest.approx(effect(3_000, 1_500))
    rebuilt = tables["component_reconstruction"].filter("pool = 'a'").first()
    assert rebuilt.reconstructed == pytest.approx(0.5 * -0.4 + 0.2 * -0.1) and rebuilt.insensitive_share == pytest.approx(0.3) and rebuilt.under_law == pytest.approx(0.7 * 0.5 * math.log(0.5))
    wedge = st.reference_tables(spark, studies["first"], dataclasses.replace(studies["first"]), list(POOLS))
    assert {r.ratio for r in wedge["levels_two_references"].collect()} == {1.0}
