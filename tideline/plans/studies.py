"""Tables across studies: what several changes of the block interval say together.

Every study has been through ``jobs.report``; this job reads its panel and small result tables, never swaps or ticks."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, functions as F

from tideline.operators.gram import fit
from tideline.plans import estimates as es, latency, panel as pn
from tideline.plans.jobs import Study
from tideline.session import prepare
from tideline.sources.sinks import write_tables

INSENSITIVE = ("cex_jump", "same_block", "onchain")
WEDGES = ("arb_profit", "overshoot_bps", "mean_abs_dev_pre", "n_arb")


def _together(frames: dict[str, DataFrame]) -> DataFrame:
    """One frame after the other, each marked with its change."""
    marked = [df.withColumn("change", F.lit(name)) for name, df in frames.items()]
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked)


def changes_table(spark: SparkSession, studies: dict[str, Study]) -> DataFrame:
    """(change, position, dt_pre, dt_post): intervals in seconds, changes in the order they happened."""
    ordered = sorted(studies.items(), key=lambda item: item[1].change_ms)
    rows = [(name, i, s.dt_pre_ms / 1000.0, s.dt_post_ms / 1000.0) for i, (name, s) in enumerate(ordered)]
    return spark.createDataFrame(rows, "change string, position int, dt_pre double, dt_post double")


def estimates_by_change(spark: SparkSession, studies: dict[str, Study], outcome: str, days: int, controls: str) -> DataFrame:
    """(change, pool, b, se, n, clusters) of one specification, the pooled models left out."""
    read = {name: spark.read.parquet(study.path("tables/coefficients")) for name, study in studies.items()}
    named = es.split_names(_together(read).filter("term = 'post' AND se > 0"), ["outcome", "window", "controls", "pool"])
    mine = (F.col("outcome") == outcome) & (F.col("window") == str(days)) & (F.col("controls") == controls) & (F.col("pool") != "POOLED")
    return named.filter(mine).select("change", "pool", "b", "se", "n", "clusters")


def estimate_tables(spark: SparkSession, studies: dict[str, Study], outcome: str, days: int, controls: str) -> dict[str, DataFrame]:
    """Elasticities per change and pool, pooled per change and over all, tests between neighbouring changes, the fixed latency that
    explains them, the mechanical latencies it stands for, the next halving, and the level along the changes."""
    changes = changes_table(spark, studies)
    each = es.law_and_elasticity(estimates_by_change(spark, studies, outcome, days, controls), changes)
    by_change = es.pool_estimates(each.select("change", "b", "se"), ["change"]).join(changes, "change")
    elasticity = es.pool_estimates(each.select("change", F.col("elasticity").alias("b"), F.col("elasticity_se").alias("se")), ["change"], against=0.5).join(changes, "change")
    later = (F.col("position") + 1).alias("position")
    names = changes.select("position", F.col("change").alias("after")).join(changes.select(later, F.col("change").alias("before")), "position")
    steps = es.difference_test(es.merge_estimates(elasticity.select(later, "b", "se"), elasticity, ["position"])).join(names, "position")
    floors = es.latency_floor(each.select("b", "se", "dt_pre", "dt_post").withColumn("outcome", F.lit(outcome)), ["outcome"])
    last = sorted(studies.values(), key=lambda s: s.change_ms)[-1].dt_post_ms / 1000.0
    return {
        "estimates_by_change": each,
        "pooled_by_change": by_change,
        "elasticity_by_change": elasticity,
        "elasticity_all": es.pool_estimates(each.select(F.lit(outcome).alias("outcome"), F.col("elasticity").alias("b"), F.col("elasticity_se").alias("se")), ["outcome"], against=0.5),
        "elasticity_steps": steps,
        "latency_floor": floors,
        "latency_band": latency.latency_band(floors.filter("ell > 0").select("outcome", "ell"), changes.select("dt_pre", "dt_post"), ["outcome"]),
        "next_halving": es.next_halving(floors, last),
        "chained_levels": es.chained_levels(by_change.select("change", "position", "b", "se"), "position"),
    }


def stacked_tables(spark: SparkSession, studies: dict[str, Study], outcome: str, pools: list[str], days: int, treated: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """One model over the hours of all changes, with one elasticity and with one per change; where some changes are ``treated`` and the others
    controls, the difference in differences; means and ranges per change."""
    panels = _together({name: spark.read.parquet(study.path("panel")).filter(F.abs("t_days") <= days) for name, study in studies.items()})
    names = [name for name, _ in sorted(studies.items(), key=lambda item: item[1].change_ms)]
    controls = {"log_liq": "ln(liq_mean)", "log_volume": "ln(volume)"}
    specs = [es.stacked_spec(f"{outcome}|{k}", outcome, names, pools, controls, k == "by_change") for k in ("one", "by_change")]
    tables = {
        "stacked_elasticity": fit(panels, specs).filter(F.col("term").startswith("log_dt")),
        "means_by_change": es.ranges(panels, ["change", "post"], [outcome, "sigma_ps", "volume"]),
    }
    if treated:
        # A pool has a level of its own at every change.
        marked = panels.withColumn("treated", F.col("change").isin(*treated).cast("int")).withColumn("pool", F.concat("change", F.lit(":"), "pool"))
        own = [f"{name}:{pool}" for name in names for pool in pools]
        tables["difference_in_differences"] = es.cluster_t_pvalues(fit(marked, [es.did_spec(outcome, outcome, own, days)]).filter("term IN ('post', 'post_treated')"))
    return tables


def study_tables(spark: SparkSession, study: Study, outcome: str, days: int, controls: str) -> dict[str, DataFrame]:
    """What the response times of one study imply, beside its regressions; the total rebuilt from components."""
    table = lambda name: spark.read.parquet(study.path(f"tables/{name}"))
    stats, fixed = table("response_stats_all"), table("counterfactual_all")
    before = stats.filter("regime = 'pre'").select("pool", F.col("mean_sqrt_s").alias("_before"))
    counterfactual = fixed.join(before, "pool").select("pool", F.ln(F.try_divide(F.col("mean_sqrt_s"), F.col("_before"))).alias("counterfactual"), F.col("p_first").alias("p_k1_counterfactual"))
    named = es.split_names(table("coefficients").filter("term = 'post'"), ["outcome", "window", "controls", "pool"])
    own = named.filter((F.col("outcome") == outcome) & (F.col("window") == str(days)) & (F.col("controls") == controls) & (F.col("pool") != "POOLED"))
    parts = table("component_coefficients_all").filter("term = 'post'").select(F.col("model_name").alias("component"), "b")  # pooled over pools: the same for each
    responses = table("component_weights_all").select("pool", "component").join(parts, "component")
    law = F.lit(0.5) * F.ln(F.lit(study.dt_post_ms / study.dt_pre_ms))
    return {
        "estimate_comparison": es.estimate_comparison(table("implied_effects_all"), counterfactual, own.select("pool", "b", "se")),
        "component_reconstruction": es.component_reconstruction(table("component_weights_all"), responses, law, list(INSENSITIVE)),
    }


def reference_tables(spark: SparkSession, first: Study, second: Study, pools: list[str]) -> dict[str, DataFrame]:
    """The same study under two references: regime levels side by side, and whether their difference moves at the change."""
    one, two = (spark.read.parquet(s.path("panel")) for s in (first, second))
    regimes = [spark.read.parquet(s.path("tables/regime_table")) for s in (first, second)]
    kinds = dict(regimes[0].dtypes)
    numbers = [c for c in regimes[0].columns if c in regimes[1].columns and c not in ("pool", "regime") and kinds[c] in ("double", "bigint", "int", "float")]
    return {
        "levels_two_references": es.levels_two_references(*regimes, ["pool", "regime"], numbers),
        "wedge_coefficients": fit(pn.reference_wedge(one, two, list(WEDGES)), es.wedge_specs(list(WEDGES), pools)),
    }


def compare_studies(
    spark: SparkSession, studies: dict[str, Study], out: str, outcome: str = "overshoot_strict_bps", days: int = 30, controls: str = "sigma",
    treated: tuple[str, ...] = (), other_reference: dict[str, Study] | None = None,
) -> dict[str, DataFrame]:
    """All tables over ``studies`` (name -> study), written under ``out``; tables of one study end with its name. ``other_reference`` holds the same studies
    built on another reference."""
    prepare(spark)
    pools = sorted({p for s in studies.values() for p in s.pools})
    tables = estimate_tables(spark, studies, outcome, days, controls) | stacked_tables(spark, studies, outcome, pools, days, treated)
    for name, study in studies.items():
        tables |= {f"{k}_{name}": t for k, t in study_tables(spark, study, outcome, days, controls).items()}
        if other_reference and name in other_reference:
            tables |= {f"{k}_{name}": t for k, t in reference_tables(spark, study, other_reference[name], pools).items()}
    write_tables(tables, out)
    return tables
