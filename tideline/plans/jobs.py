"""User-level jobs. Each reads tables, builds its plans and writes its result tables as Parquet.

The big intermediate results (enriched swaps, arbitrages, labelled arbitrages) are written once and read back, so
later steps scan columns instead of repeating the alignment."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from tideline import schemas
from tideline.functions import clock
from tideline.operators.blocks import with_intervals
from tideline.operators.gram import fit
from tideline.operators.openings import blocks_waited, classify_openings, last_inside_band, with_opening_sizes
from tideline.operators.ordered import previous_row
from tideline.plans import audit, enrich, estimates as es, latency, operators as op, panel as pn, regime as rg, response as rs
from tideline.session import prepare
from tideline.sources import readers
from tideline.sources.sinks import replace_partitions, write_tables


@dataclass(frozen=True)
class Study:
    """One change point: where its tables are and the options that change results."""

    root: str
    change_block: int
    change_ms: int
    dt_pre_ms: float
    dt_post_ms: float
    pools: tuple[str, ...]
    days: int = 30
    reference: str = "ticks"  # or "candles"
    lag_ms: int = 0
    candle_age_ms: int = 1_000
    horizons_ms: dict[str, int] = field(default_factory=lambda: {"5": 5_000, "30": 30_000})
    series_step_ms: int = 1_000
    max_search_ms: int = 120_000
    max_tau_ms: int = 60_000
    min_arbs: int = 20
    min_pair: int = 200
    public_wallets: int = 30
    public_median: float = 2.0
    grid_step_ms: int = latency.GRID_STEP_MS
    grid_top_ms: int = latency.GRID_TOP_MS
    outcomes: tuple[str, ...] = ("overshoot_strict_bps", "overshoot_bps", "arb_profit", "n_arb", "arb_loss", "volume")
    windows: tuple[int, ...] = (7, 14, 30)

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def interval_ms(self):
        return F.when(F.col("regime") == "pre", float(self.dt_pre_ms)).otherwise(float(self.dt_post_ms))


def _read(spark: SparkSession, study: Study, name: str, schema=None) -> DataFrame:
    prepare(spark)
    return readers.read_table(spark, study.path(name), schema) if schema else spark.read.parquet(study.path(name))


def enrich_swaps(spark: SparkSession, study: Study) -> dict[str, DataFrame]:
    """Raw swaps to the enriched fact table (by pool and date), then daily, hour-of-day and regime tables."""
    pools = _read(spark, study, "pools", schemas.POOLS)
    blocks = _read(spark, study, "blocks", schemas.BLOCKS)
    candles = _read(spark, study, "candles", schemas.CANDLES)
    raw = enrich.prepare_swaps(_read(spark, study, "swaps", schemas.SWAPS), pools)
    timed = enrich.with_block_time(raw.withColumn("liquidity", F.col("liquidity").cast("double")), blocks)
    if study.reference == "candles":
        priced = enrich.with_candle_reference(enrich.with_previous_price(timed), candles, study.horizons_ms)
        facts = enrich.pricing.with_trade_metrics(priced.na.drop(subset=["p_pre", "p_cex"]))
    else:
        ticks = _read(spark, study, "ticks", schemas.TICKS).select("symbol", "ts_ms", "price")
        facts = enrich.enriched(timed, ticks, candles, study.lag_ms, study.candle_age_ms, study.horizons_ms)
    dated = facts.withColumn("date", clock.utc_date(F.col("ts_ms")))
    replace_partitions(dated.repartition("pool", "date", clock.hour_of_day(F.col("ts_ms"))), study.path("enriched"), ["pool", "date"])
    swaps = _read(spark, study, "enriched")
    attached = candles.join(pools.select("pool", "symbol"), "symbol").select("pool", "ts_ms", "close")
    fees = swaps.groupBy("pool").agg(F.max("fee_rate").alias("fee_rate"))
    series = rg.series_statistics(rg.price_series(swaps, attached, study.series_step_ms), fees, study.change_ms, study.series_step_ms)
    block_stats = rg.block_statistics(with_intervals(blocks), study.change_block)
    tables = {
        "daily_table": pn.daily_table(swaps),
        "hour_of_day_table": pn.hour_of_day_table(swaps, study.change_block),
        "regime_table": rg.regime_table(rg.swap_statistics(_with_gap_column(swaps), study.change_block), block_stats, series),
    }
    write_tables(tables, study.path("tables"))
    return tables


def _with_gap_column(swaps: DataFrame) -> DataFrame:
    return swaps if "p_cex_1s" in swaps.columns else swaps.withColumn("p_cex_1s", F.lit(None).cast("double"))


def build_panel(spark: SparkSession, study: Study) -> dict[str, DataFrame]:
    """Hourly panel, its regime table, regressions with placebos, matched hours and exposure."""
    swaps = _with_gap_column(_read(spark, study, "enriched"))
    pn.hourly_panel(swaps, study.change_ms, study.dt_pre_ms / 1000, study.dt_post_ms / 1000).write.mode("overwrite").parquet(study.path("panel"))
    panel = _read(spark, study, "panel")
    pools, outcomes = list(study.pools), list(study.outcomes)
    specs = es.spec_grid(outcomes, pools, list(study.windows))
    false = [es.placebo(es.panel_spec(f"{o}|{w}|{c}|POOLED", o, pools, c, w), -w / 2) for o in outcomes for w in study.windows for c in ("sigma", "rd")]
    pairs = pn.shifted_pairs(panel, study.days, ["arb_profit", "overshoot_strict_bps", "arb_loss", "n_arb", "sigma_ps"])
    tables = {
        "panel_regime_table": pn.regime_ratios(pn.panel_regime_table(panel), ["pool"]),
        "coefficients": fit(panel, specs + false),
        "matched": es.matched_pvalues(pn.matched_changes(
            pairs, ["arb_profit", "overshoot_strict_bps", "arb_loss", "n_arb", "sigma_ps"], net_of={"arb_loss_net_of_variance": ("arb_loss", "sigma_ps", 2.0)})),
        "exposure": es.exposure(panel),
        "lp_levels": pn.lp_levels(panel),
        "daily_normalised": pn.daily_normalised(panel),
        "descriptives": es.descriptives(panel),
    }
    write_tables(tables, study.path("tables"))
    return tables


def core_analysis(spark: SparkSession, study: Study) -> dict[str, DataFrame]:
    """Pooled estimates: jump at the change, heterogeneity, volatility path and event study."""
    panel = _read(spark, study, "panel")
    pools = list(study.pools)
    outcome = study.outcomes[0]
    flagged = es.with_median_flag(panel.filter("sigma_ps > 0"), ["pool"], "sigma_ps")
    tables = {
        "rd_jump": fit(panel, [es.panel_spec(f"{o}|{w}", o, pools, "rd", w) for o in study.outcomes for w in study.windows]),
        "heterogeneity": fit(flagged, es.heterogeneity_specs(outcome, outcome, pools)),
        "sigma_path": pn.sigma_path(panel, study.windows),
        "event_study": es.event_study(panel, es.panel_spec(outcome, outcome, pools, "sigma+L+vol"), pre_only=True),
        "lp_decomposition": fit(panel, es.lp_decomposition_specs(pools, study.days)),
    }
    write_tables(tables, study.path("tables"))
    return tables


def find_arbs(swaps: DataFrame, ticks: DataFrame, pools: DataFrame, blocks: DataFrame, study: Study) -> DataFrame:
    """Arbitrages with the previous swap's state, opening, waiting blocks and sizes."""
    names = {f"prev_{c}": c for c in ("ts_ms", "block", "dev_pre", "dev_post", "is_arb")}
    stepped = previous_row(swaps, ["pool"], enrich.ORDER, names, width=enrich.BLOCK_SLICE)
    arbs = stepped.filter("is_arb AND prev_ts_ms IS NOT NULL")
    ranges = last_inside_band(arbs, ticks, pools, study.max_search_ms)
    ticking = ticks.select("symbol", clock.utc_date(F.col("ts_ms")).alias("_day")).distinct()
    days = ticking.select("symbol", F.explode(F.array(F.col("_day"), F.date_add("_day", 1))).alias("_day")).distinct().withColumn("_ticking", F.lit(True))
    with_days = arbs.withColumn("_day", clock.utc_date(F.col("ts_ms"))).join(days, ["symbol", "_day"], "left")
    opened = classify_openings(with_days, ranges, study.max_search_ms, has_ticks=F.coalesce("_ticking", F.lit(False))).drop("_day", "_ticking")
    waited = blocks_waited(with_opening_sizes(opened), blocks)
    return waited.select(
        "*", F.when(F.col("block") < study.change_block, "pre").otherwise("post").alias("regime"), clock.days_since(F.col("ts_ms"), study.change_ms).alias("days_from_change")
    )


def response_times(spark: SparkSession, study: Study, exclusions: DataFrame | None = None, reuse: bool = False, tag: str = "all") -> dict[str, DataFrame]:
    """Openings and response-time statistics. ``reuse`` keeps the openings of an earlier run; ``exclusions`` drops
    senders (the bots-only variant needs no second search)."""
    swaps = _read(spark, study, "enriched")
    if not reuse:
        ticks = _read(spark, study, "ticks", schemas.TICKS).select("symbol", "ts_ms", "price")
        pools = _read(spark, study, "pools", schemas.POOLS)
        found = find_arbs(swaps, ticks, pools, _read(spark, study, "blocks", schemas.BLOCKS), study)
        found.write.mode("overwrite").parquet(study.path("arbs"))
    arbs = _read(spark, study, "arbs")
    if exclusions is not None:
        arbs, swaps = readers.without_members(arbs, exclusions), readers.without_members(swaps, exclusions)
    by = ["pool", "regime"]
    regime = F.when(F.col("block") < study.change_block, "pre").otherwise("post").alias("regime")
    own = swaps.groupBy("pool", regime, "sender").agg(F.count(F.lit(1)).alias("n"))
    inside = rs.in_window(arbs, study.days)
    strict = inside.filter("is_arb_strict")
    stats = rs.response_stats(inside, by, study.interval_ms(), study.max_tau_ms)
    counts = latency.counted_intervals(inside.filter(rs.market_triggered(study.max_tau_ms)), by, "tau_lo_ms", "tau_ms", study.grid_step_ms, study.grid_top_ms)
    masses = latency.turnbull(counts, by, study.grid_step_ms, study.grid_top_ms)
    paired = rs.paired_groups(strict, "sender", ["pool"], study.dt_pre_ms, study.dt_post_ms, study.min_pair, study.max_tau_ms)
    tables = {
        f"response_stats_{tag}": stats,
        f"turnbull_{tag}": masses,
        f"turnbull_summary_{tag}": latency.mass_summary(masses, by, study.interval_ms()),
        f"lognormal_{tag}": latency.lognormal_fit(inside.filter(rs.market_triggered(study.max_tau_ms)), by, "tau_lo_ms", "tau_ms"),
        f"implied_effects_{tag}": rs.implied_effects(stats, ["pool"]),
        f"counterfactual_{tag}": latency.fixed_latency_counterfactual(masses.filter("regime = 'pre'"), ["pool"], F.lit(float(study.dt_post_ms))),
        f"concentration_{tag}": rs.sender_concentration(strict, by, study.min_arbs),
        f"active_bots_{tag}": rs.active_bots(strict, own, by, study.min_arbs),
        f"top_senders_{tag}": rs.top_senders(strict, own, by, study.max_tau_ms),
        f"paired_{tag}": paired,
        f"paired_summary_{tag}": rs.paired_summary(paired, ["pool"]),
        f"entry_exit_{tag}": rs.entry_exit(strict, "sender", ["pool"], study.min_arbs),
    }
    write_tables(tables, study.path("tables"))
    return tables


def component_tables(spark: SparkSession, study: Study, exclusions: DataFrame | None = None, tag: str = "all") -> dict[str, DataFrame]:
    """Hourly component panel, weights before the change, and share regressions."""
    arbs = _read(spark, study, "arbs").filter("is_arb_strict")
    if exclusions is not None:
        arbs = readers.without_members(arbs, exclusions)
    hours = _read(spark, study, "panel").select("pool", "hour_ms", "sigma_ps", "liq_mean", "volume", "post", "hod", "day", "t_days")
    components = rs.component_panel(arbs, study.max_tau_ms).join(hours, ["pool", "hour_ms"])
    specs = [es.share_spec(f"share_{t}", f"share_{t}", study.days) for t in ("cex", "continuation", "same_block", "onchain")]
    specs += [
        es.panel_spec(c, c, list(study.pools), "sigma+L+vol").variant(where=es.positive([c, "sigma_ps", "volume", "liq_mean"]) + f" AND abs(t_days) <= {study.days}", min_rows=60)
        for c in ("overshoot_all", "cex_jump", "cex_move", "continuation", "same_block", "cex_sqrt_tau_mean")
    ]
    tables = {f"component_panel_{tag}": components, f"component_weights_{tag}": rs.component_weights(arbs, study.days), f"component_coefficients_{tag}": fit(components, specs)}
    write_tables(tables, study.path("tables"))
    return tables


def operator_tables(spark: SparkSession, study: Study) -> dict[str, DataFrame]:
    """Contracts, public routers, operators, their concentration, profiles, gas and speed.

    Components use all strict arbitrages; the window applies afterwards."""
    arbs = _read(spark, study, "arbs").filter("is_arb_strict")
    tx = _read(spark, study, "transactions", schemas.TRANSACTIONS)
    joined = op.with_transactions(arbs, tx)
    contracts = op.contract_table(joined, study.public_wallets, study.public_median)
    labelled, operators = op.with_operators(joined, contracts, study.min_arbs)
    labelled.write.mode("overwrite").parquet(study.path("labelled"))
    a = rs.in_window(_read(spark, study, "labelled"), study.days)
    native = a.withColumn("native_price", F.col("p_cex"))
    tables = {
        "contracts": contracts,
        "public_contracts": contracts.filter("public").select("sender", "distinct_wallets", "median_per_wallet", "public"),
        "operators": operators,
        "coverage": op.transaction_coverage(a, ["pool", "regime"]),
        "contracts_vs_operators": op.contracts_vs_operators(a, operators, ["pool", "regime"], study.min_arbs),
        "flow_profiles": op.flow_profiles(a, study.max_tau_ms),
        "wallet_rotation": op.wallet_rotation(a.filter("NOT via_public"), ["regime"], study.min_arbs),
        "gas_position": op.gas_position(native, ["regime", "trigger"]),
        "router_robustness": op.router_robustness(a, ["pool", "regime"], study.interval_ms(), study.max_tau_ms),
        "operator_points": op.operator_points(a, study.interval_ms(), study.max_tau_ms, 500),
        "operator_entry_exit": rs.entry_exit(a.filter(F.col("operator") != op.ANONYMOUS), "operator", ["pool"], study.min_arbs),
    }
    write_tables(tables, study.path("tables"))
    return tables


def report(spark: SparkSession, study: Study) -> dict[str, DataFrame]:
    """Every table in order; the bots-only variants reuse the openings and drop the public routers found."""
    out = {**enrich_swaps(spark, study), **build_panel(spark, study), **core_analysis(spark, study), **response_times(spark, study), **component_tables(spark, study)}
    out |= operator_tables(spark, study)
    routers = spark.read.parquet(study.path("tables/public_contracts")).select(F.lower("sender").alias("sender"))
    out |= response_times(spark, study, exclusions=routers, reuse=True, tag="bots")
    out |= component_tables(spark, study, exclusions=routers, tag="bots")
    return out


def source_audit(spark: SparkSession, first: DataFrame, second: DataFrame, blocks: DataFrame) -> dict[str, DataFrame]:
    """Two deliveries of one segment compared row by row, and the provider's clock against the block table."""
    values = [c for c in ("sender", "recipient", "amount0", "amount1", "sqrt_price_x96", "liquidity", "tick", "tx") if c in first.columns and c in second.columns]
    keys = ["block", "log_index"]
    return {
        "differences": audit.source_diff(first, second, keys, values),
        "summary": audit.diff_summary(first, second, keys, values),
        "clock": audit.timestamp_crosscheck(second, blocks),
    }
