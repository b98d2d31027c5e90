"""Before/after statistics of pools from swaps, blocks and the evenly spaced price series."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tideline.functions import clock
from tideline.operators.asof import grid_join
from tideline.operators.episodes import episodes, half_life, log_returns
from tideline.operators.quantiles import Quantile, summarise
from tideline.plans.panel import ratio, total, when

BPS = 1e4


def price_series(swaps: DataFrame, candles: DataFrame, step_ms: int, bounded: bool = False) -> DataFrame:
    """Pool price and reference on a complete time grid per pool, both carried forward; dev = pool/reference - 1.

    ``candles``: pool, ts_ms, close (the reference series attached to each pool)."""
    step = clock.floor_ms(F.col("ts_ms"), step_ms)
    last = swaps.groupBy("pool", step.alias("ts_ms")).agg(F.max_by("p_post", F.struct("block", "log_index")).alias("p_pool"))
    spans = swaps.groupBy("pool").agg(F.min("ts_ms").alias("t0"), F.max("ts_ms").alias("t1"))
    grid = grid_join(spans, {"p_pool": (last, "p_pool"), "p_cex": (candles, "close")}, ["pool"], "ts_ms", step_ms, bounded)
    return grid.withColumn("dev", ratio("p_pool", "p_cex") - 1.0)


def series_statistics(series: DataFrame, fees: DataFrame, change_ms: int, step_ms: int, bounded: bool = False) -> DataFrame:
    """Deviation, persistence and volatility of the gridded series per pool and regime."""
    tagged = series.withColumn("regime", F.when(F.col("ts_ms") < change_ms, "pre").otherwise("post")).join(fees, "pool")
    keys, order = ["pool", "regime"], ["ts_ms"]
    levels = tagged.groupBy(*keys).agg(
        (F.avg(F.abs("dev")) * BPS).alias("mean_abs_dev_bps"),
        F.avg(F.when(F.abs("dev") > F.col("fee_rate"), 1.0).otherwise(0.0)).alias("share_outside_band"),
    )
    runs = episodes(tagged, keys, order, F.abs("dev") > F.col("fee_rate"), width=clock.DAY_MS, bounded=bounded)
    lengths = runs.groupBy(*keys).agg((F.avg("length") * (step_ms / 1000.0)).alias("outside_episode_mean_s"))
    persistence = half_life(tagged, keys, order, "dev", width=clock.DAY_MS, bounded=bounded).select(
        *keys, (F.col("half_life") * (step_ms / 1000.0)).alias("dev_half_life_s")
    )
    fine = log_returns(tagged, keys, order, "p_cex", width=clock.DAY_MS, bounded=bounded)
    fine_vol = fine.groupBy(*keys).agg((F.stddev_samp("log_return") * BPS).alias("ref_vol_step_bps"))
    origin = tagged.groupBy(*keys).agg(F.min("ts_ms").alias("_first"))
    sixty = tagged.join(origin, keys).filter(F.pmod((F.col("ts_ms") - F.col("_first")) / F.lit(step_ms), F.lit(60)) == 0)
    coarse = log_returns(sixty.drop("_first"), keys, order, "p_cex", width=clock.DAY_MS, bounded=bounded)
    coarse_vol = coarse.groupBy(*keys).agg((F.stddev_samp("log_return") * BPS / F.sqrt(F.lit(60.0))).alias("ref_vol_60_steps_bps"))
    out = levels
    for part in (lengths, persistence, fine_vol, coarse_vol):
        out = out.join(part, keys, "left")
    return out


def swap_statistics(swaps: DataFrame, change_block: int, bounded: bool = False) -> DataFrame:
    """Sums behind the regime table, per pool and regime."""
    gap = ratio("p_cex_1s", "p_cex") - 1.0
    tagged = swaps.withColumn("regime", F.when(F.col("block") < change_block, "pre").otherwise("post"))
    keys = ["pool", "regime"]
    sums = summarise(
        tagged, keys,
        [
            F.count(F.lit(1)).alias("swaps"),
            F.sum("volume_q").alias("volume_q"),
            F.count_if("is_arb").alias("n_arb"),
            F.count_if("is_arb_strict").alias("n_arb_strict"),
            total("is_arb", "volume_q").alias("arb_volume"),
            F.sum("fee_income").alias("fee_income"),
            F.sum("arb_loss").alias("arb_loss"),
            F.sum("lp_gain").alias("lp_gain"),
            total("is_arb", "arb_loss").alias("arb_loss_arbs"),
            F.sum("markout_30s").alias("markout_30s"),
            (F.avg(F.abs(gap)) * BPS).alias("ref_gap_mean_abs_bps"),
            (F.sqrt(F.avg(gap * gap)) * BPS).alias("ref_gap_rms_bps"),
        ],
        [Quantile("median_arb_size", when("is_arb", "volume_q"), 0.5)],
        bounded,
    )
    return sums.join(distinct_blocks(tagged), keys)


def distinct_blocks(tagged: DataFrame) -> DataFrame:
    """Blocks with at least one swap: one row per block first, then counted (no per-group set of blocks)."""
    return tagged.select("pool", "regime", "block").distinct().groupBy("pool", "regime").agg(F.count(F.lit(1)).alias("blocks_with_swap"))


def block_statistics(intervals: DataFrame, change_block: int) -> DataFrame:
    return intervals.groupBy(F.when(F.col("number") < change_block, "pre").otherwise("post").alias("regime")).agg(
        ((F.max("milli_ts") - F.min("milli_ts")) / float(clock.HOUR_MS)).alias("hours"),
        F.count(F.lit(1)).alias("n_blocks"),
        (F.avg("interval") * 1000.0).alias("block_interval_ms"),
        F.count("interval").alias("n_intervals"),
    )


def regime_table(swap_stats: DataFrame, block_stats: DataFrame, series_stats: DataFrame) -> DataFrame:
    """The before/after table of a pool: one row per (pool, regime)."""
    j = swap_stats.join(F.broadcast(block_stats), "regime").join(series_stats, ["pool", "regime"], "left")
    sigma = F.col("ref_vol_60_steps_bps") / BPS
    per_hour = F.col("arb_loss") / F.col("hours")
    return j.select(
        "pool", "regime", "hours", "n_blocks", "block_interval_ms", "n_intervals", "swaps",
        (F.col("swaps") / F.col("n_blocks")).alias("swaps_per_block"),
        (F.col("blocks_with_swap") / F.col("n_blocks")).alias("share_blocks_with_swap"),
        (F.col("volume_q") / F.col("hours")).alias("volume_quote_per_hour"),
        ratio("n_arb", "swaps").alias("arb_swaps_share"),
        ratio("n_arb_strict", "swaps").alias("arb_strict_share"),
        ratio("arb_volume", "volume_q").alias("arb_volume_share"),
        (F.col("n_arb") / F.col("hours")).alias("arb_swaps_per_hour"),
        "median_arb_size",
        (ratio("fee_income", "volume_q") * BPS).alias("fee_bps_of_volume"),
        (ratio("arb_loss", "volume_q") * BPS).alias("arb_loss_bps_of_volume"),
        (ratio("lp_gain", "volume_q") * BPS).alias("lp_net_bps_of_volume"),
        ratio("arb_loss", "fee_income").alias("arb_loss_over_fee"),
        per_hour.alias("arb_loss_per_hour"),
        ratio("arb_loss_arbs", "n_arb").alias("arb_loss_per_arb"),
        "mean_abs_dev_bps", "share_outside_band", "dev_half_life_s", "outside_episode_mean_s", "ref_vol_step_bps", "ref_vol_60_steps_bps",
        F.try_divide(per_hour, F.pow(sigma, F.lit(2.0))).alias("arb_loss_rate_over_sigma2"),
        F.try_divide(per_hour, F.pow(sigma, F.lit(3.0))).alias("arb_loss_rate_over_sigma3"),
        (ratio("markout_30s", "volume_q") * BPS).alias("markout_30s_bps_of_volume"),
        "ref_gap_mean_abs_bps", "ref_gap_rms_bps",
    )
