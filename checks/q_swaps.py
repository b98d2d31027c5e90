"""Alignment queries: previous prices, as-of references, metrics, openings, panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import market as m
from checks.market import with_parts
from checks.registry import query
from checks.rounding import rounded, sql_round
from tideline.functions import clock, pricing
from tideline.operators.asof import as_of, as_of_many, cross_rate, grid_join, last_per_bucket
from tideline.operators.blocks import contiguity
from tideline.operators.openings import last_inside_band
from tideline.operators.ordered import previous_row
from tideline.plans import enrich, panel as pn, regime as rg




# ------------------------------------------------------------------------------------------ flagship: aligned hourly flow
FLAGSHIP_SQL = with_parts(
    """SELECT hour_ms, count(*) AS swaps, round(avg(abs(dev)), 6) AS mean_abs_dev, count(*) FILTER (abs(dev) > 0.3) AS outside
       FROM (SELECT (c.ts_ms // 3600000) * 3600000 AS hour_ms, c.value / t.price - 1 AS dev
             FROM ev c ASOF LEFT JOIN tk t ON c.ts_ms >= t.ts_ms WHERE c.event_type = 'click')
       WHERE dev IS NOT NULL GROUP BY hour_ms""",
    "tk",
)


@query("hourly_deviation", FLAGSHIP_SQL)
def hourly_deviation(spark, sf):
    trades = m.events(spark, sf).filter("event_type = 'click'").select(F.lit("REF").alias("symbol"), "ts_ms", "event_id", "value")
    aligned = as_of(trades, m.ticks(spark, sf), ["symbol"], F.col("ts_ms"), "ts_ms", {"price": "price"})
    dev = aligned.withColumn("dev", pricing.deviation(F.col("value"), F.col("price"))).filter("dev IS NOT NULL")
    hourly = dev.groupBy(clock.floor_ms(F.col("ts_ms"), clock.HOUR_MS).alias("hour_ms")).agg(
        F.count(F.lit(1)).alias("swaps"), F.avg(F.abs("dev")).alias("mean_abs_dev"),
        F.count_if(F.abs("dev") > 0.3).alias("outside"),
    )
    return rounded(hourly)


# ------------------------------------------------------------------------------------------------- previous-row windows
PREV_PRICE_SQL = with_parts("SELECT pool, block, log_index, p_post, p_pre FROM sw", "sw")


@query("prev_price", PREV_PRICE_SQL)
def prev_price(spark, sf):
    return enrich.with_previous_price(m.swaps(spark, sf)).select("pool", "block", "log_index", "p_post", "p_pre")


@query("prev_price_sliced", PREV_PRICE_SQL)
def prev_price_sliced(spark, sf):
    return enrich.with_previous_price(m.swaps(spark, sf), bounded=False).select("pool", "block", "log_index", "p_post", "p_pre")


@query("prev_state", with_parts(
    """SELECT pool, block, log_index, lag(ts_ms) OVER w AS prev_ts_ms, lag(block) OVER w AS prev_block,
              round(lag(dev_pre) OVER w, 8) AS prev_dev_pre, round(lag(dev_post) OVER w, 8) AS prev_dev_post, lag(is_arb) OVER w AS prev_is_arb
       FROM en WINDOW w AS (PARTITION BY pool ORDER BY block, log_index)""", "en"))
def prev_state(spark, sf):
    names = {f"prev_{c}": c for c in ("ts_ms", "block", "dev_pre", "dev_post", "is_arb")}
    out = previous_row(m.enriched_swaps(spark, sf), ["pool"], enrich.ORDER, names, width=enrich.BLOCK_SLICE)
    return rounded(out.select("pool", "block", "log_index", *names), 8)


# ------------------------------------------------------------------------------------------------------------ as-of joins
ASOF_SQL = with_parts(
    "SELECT s.pool, s.log_index, t.price AS p_cex FROM sw s ASOF LEFT JOIN tk t ON s.ts_ms >= t.ts_ms", "sw", "tk")


def _asof(spark, sf, bounded):
    out = as_of(m.swaps(spark, sf), m.ticks(spark, sf), ["symbol"], F.col("ts_ms"), "ts_ms", {"p_cex": "price"}, bounded=bounded)
    return out.select("pool", "log_index", "p_cex")


@query("asof_backward", ASOF_SQL)
def asof_backward(spark, sf):
    return _asof(spark, sf, None)


@query("asof_backward_sliced", ASOF_SQL)
def asof_backward_sliced(spark, sf):
    return _asof(spark, sf, False)


@query("asof_lagged", with_parts(
    """SELECT s.pool, s.log_index, a.price AS lag_0, b.price AS lag_15m, c.price AS lag_60m
       FROM sw s ASOF LEFT JOIN tk a ON s.ts_ms >= a.ts_ms ASOF LEFT JOIN tk b ON s.ts_ms - 900000 >= b.ts_ms
                 ASOF LEFT JOIN tk c ON s.ts_ms - 3600000 >= c.ts_ms""", "sw", "tk"))
def asof_lagged(spark, sf):
    lags = {"lag_0": 0, "lag_15m": 900_000, "lag_60m": 3_600_000}
    queries = {name: (F.col("ts_ms") - F.lit(shift), "price") for name, shift in lags.items()}
    out = as_of_many(m.swaps(spark, sf), m.ticks(spark, sf), ["symbol"], ["pool", "block", "log_index"], queries, "ts_ms")
    return out.select("pool", "log_index", *lags)


@query("cross_rate_asof", with_parts(
    """SELECT ts_ms, round(base / quote, 8) AS price FROM (
         SELECT ts_ms, last_value(b IGNORE NULLS) OVER (ORDER BY ts_ms) AS base, last_value(q IGNORE NULLS) OVER (ORDER BY ts_ms) AS quote
         FROM (SELECT ts_ms, max(value) FILTER (event_type = 'view') AS b, max(value) FILTER (event_type = 'click') AS q
               FROM (SELECT event_type, ts_ms, arg_max(value, event_id) AS value FROM ev WHERE event_type IN ('view', 'click') GROUP BY 1, 2)
               GROUP BY ts_ms))
       WHERE base IS NOT NULL AND quote IS NOT NULL""", "ev"))
def cross_rate_asof(spark, sf):
    out = cross_rate(m.ticks(spark, sf, "view"), m.ticks(spark, sf, "click"), ["symbol"], "ts_ms", "price")
    return rounded(out.select("ts_ms", "price"), 8)


@query("grid_join", with_parts(
    """SELECT pool, ts_ms, p_pool, p_cex, round(p_pool / p_cex - 1, 8) AS dev FROM (
         SELECT g.pool, g.ts_ms, last_value(l.p IGNORE NULLS) OVER w AS p_pool, last_value(c.close IGNORE NULLS) OVER w AS p_cex
         FROM (SELECT pool, unnest(range(min(ts_ms), max(ts_ms) + 1, 60000)) AS ts_ms FROM en GROUP BY pool) g
         LEFT JOIN (SELECT pool, ts_ms, arg_max(p_post, log_index) AS p FROM en GROUP BY pool, ts_ms) l USING (pool, ts_ms)
         LEFT JOIN cd c ON c.ts_ms = g.ts_ms WINDOW w AS (PARTITION BY g.pool ORDER BY g.ts_ms))
       WHERE p_pool IS NOT NULL AND p_cex IS NOT NULL""", "en", "cd"))
def grid_join_query(spark, sf):
    return rounded(market_series(spark, sf), 8)


def market_series(spark, sf):
    per_pool = m.candles(spark, sf).join(m.pool_symbols(spark, sf), "symbol").select("pool", "ts_ms", "close")
    return rg.price_series(m.enriched_swaps(spark, sf), per_pool, m.STEP_MS).select("pool", "ts_ms", "p_pool", "p_cex", "dev")


@query("block_ts_lookup", with_parts(
    """SELECT s.pool, s.log_index, CASE WHEN b.number IS NOT NULL THEN b.milli_ts ELSE s.block_ts * 1000 END AS ts_ms
       FROM (SELECT pool, log_index, block, CASE WHEN log_index % 3 = 0 THEN -1 ELSE ts_ms // 1000 END AS block_ts FROM sw) s
       LEFT JOIN (SELECT * FROM bl WHERE number % 5 <> 0) b ON b.number = s.block
       WHERE b.number IS NOT NULL OR s.block_ts > 0""", "sw", "bl"))
def block_ts_lookup(spark, sf):
    provided = F.when(F.col("log_index") % 3 == 0, -1).otherwise(F.floor(F.col("ts_ms") / 1000)).cast("bigint")
    swaps = m.swaps(spark, sf).withColumn("block_ts", provided).drop("ts_ms")
    return enrich.with_block_time(swaps, m.blocks(spark, sf).filter("number % 5 <> 0")).select("pool", "log_index", "ts_ms")


# --------------------------------------------------------------------------------------------------------- enriched swaps
METRICS = "p_cex p_cex_1s dev_pre dev_post volume_q fee_income lp_gain arb_loss markout_5s markout_30s"
METRICS_SQL = with_parts(f"SELECT pool, block, log_index, is_arb, is_arb_strict, {sql_round(METRICS, 8)} FROM en", "en")


@query("swap_metrics", METRICS_SQL)
def swap_metrics(spark, sf):
    return rounded(m.enriched_swaps(spark, sf).select("pool", "block", "log_index", "is_arb", "is_arb_strict", *METRICS.split()), 8)


@query("swap_metrics_sliced", METRICS_SQL)
def swap_metrics_sliced(spark, sf):
    out = m.enriched_swaps(spark, sf, bounded=False)
    return rounded(out.select("pool", "block", "log_index", "is_arb", "is_arb_strict", *METRICS.split()), 8)


@query("drop_unaligned", with_parts(
    """SELECT pool, count(*) AS n_all, count(*) FILTER (p_pre IS NOT NULL AND price IS NOT NULL) AS n_aligned
       FROM (SELECT s.*, t.price FROM sw s ASOF LEFT JOIN tk t ON s.ts_ms >= t.ts_ms) GROUP BY pool""", "sw", "tk"))
def drop_unaligned(spark, sf):
    priced = enrich.with_previous_price(m.swaps(spark, sf))
    seen = as_of(priced, m.ticks(spark, sf), ["symbol"], F.col("ts_ms"), "ts_ms", {"p_cex": "price"})
    return seen.groupBy("pool").agg(
        F.count(F.lit(1)).alias("n_all"),
        F.count_if(F.col("p_pre").isNotNull() & F.col("p_cex").isNotNull()).alias("n_aligned"),
    )


@query("band_bounds", with_parts(
    """SELECT pool, log_index, m AS multiplier, round(p_pre / (1 + m * fee_rate), 8) AS lo, round(p_pre / (1 - m * fee_rate), 8) AS hi
       FROM en, (VALUES (1.0::DOUBLE), (1.5::DOUBLE), (2.0::DOUBLE)) v(m)""", "en"))
def band_bounds(spark, sf):
    wide = m.enriched_swaps(spark, sf).withColumn("multiplier", F.explode(F.array(*[F.lit(x) for x in pricing.BAND_MULTIPLIERS])))
    width = F.col("multiplier") * F.col("fee_rate")
    return rounded(wide.select("pool", "log_index", "multiplier", pricing.band_low(F.col("p_pre"), width).alias("lo"), pricing.band_high(F.col("p_pre"), width).alias("hi")), 8)


# --------------------------------------------------------------------------------------------------------------- openings
RANGES_SQL = with_parts("SELECT pool, block, log_index, first_ts, first_price, cross_ts, cross_price, cross_ts_m15, cross_ts_m20 FROM rg", "rg")


def _ranges(spark, sf, bounded):
    out = last_inside_band(m.arb_candidates(spark, sf, bounded), m.ticks(spark, sf), m.pool_symbols(spark, sf), m.SEARCH_MS, bounded=bounded)
    return out.select("pool", "block", "log_index", "first_ts", "first_price", "cross_ts", "cross_price", "cross_ts_m15", "cross_ts_m20")


@query("last_inside_band", RANGES_SQL)
def last_inside(spark, sf):
    return _ranges(spark, sf, None)


@query("last_inside_band_sliced", RANGES_SQL)
def last_inside_sliced(spark, sf):
    return _ranges(spark, sf, False)


OPENING_COLS = "trigger t_open p_open tau_ms trigger_m15 tau_ms_m15 trigger_m20 tau_ms_m20"


@query("opening_classify", with_parts(f"SELECT pool, block, log_index, {OPENING_COLS.replace(' ', ', ')} FROM ar", "ar"))
def opening_classify(spark, sf):
    return m.arbs(spark, sf).select("pool", "block", "log_index", *OPENING_COLS.split())


@query("blocks_between", with_parts("SELECT pool, block, log_index, k_blocks, tau_lo_ms FROM ar", "ar"))
def blocks_between(spark, sf):
    return m.arbs(spark, sf).select("pool", "block", "log_index", "k_blocks", "tau_lo_ms")


@query("overshoot_jump_move", with_parts(
    "SELECT pool, block, log_index, round(overshoot_bps, 6) AS overshoot_bps, round(jump_bps, 6) AS jump_bps, round(move_bps, 6) AS move_bps FROM ar", "ar"))
def overshoot_jump_move(spark, sf):
    return rounded(m.arbs(spark, sf).select("pool", "block", "log_index", "overshoot_bps", "jump_bps", "move_bps"))


# ----------------------------------------------------------------------------------------------------------------- panels
PANEL_COLS = (
    "volume fee_income lp_gain arb_loss markout_30s arb_volume arb_loss_arbs arb_profit overshoot_bps overshoot_strict_bps "
    "mean_abs_dev_pre share_swaps_outside liq_mean ref_gap_bps median_arb_size arb_loss_bps lp_net_bps loss_per_arb dt t_days"
)
PANEL_SQL = with_parts(
    f"""SELECT pool, hour_ms, CAST(swaps AS BIGINT) AS swaps, CAST(n_arb AS BIGINT) AS n_arb, CAST(n_arb_strict AS BIGINT) AS n_arb_strict,
        post, hod, dow, day, {sql_round(PANEL_COLS)}, {sql_round('rv sigma_ps')} FROM pn""", "pn")


def _panel(spark, sf, bounded):
    p = m.panel(spark, sf, bounded=bounded)
    names = ["pool", "hour_ms", "swaps", "n_arb", "n_arb_strict", "post", "hod", "dow", "day"]
    return rounded(p.select(*names, *PANEL_COLS.split(), "rv", "sigma_ps"))


@query("hourly_panel", PANEL_SQL)
def hourly_panel(spark, sf):
    return _panel(spark, sf, None)


@query("hourly_panel_sliced", PANEL_SQL)
def hourly_panel_sliced(spark, sf):
    return _panel(spark, sf, False)


@query("realised_vol", with_parts("SELECT pool, hour_ms, round(rv, 8) AS rv, round(sigma_ps, 8) AS sigma_ps FROM vol", "vol"))
def realised_vol(spark, sf):
    return rounded(pn.realised_vol(m.enriched_swaps(spark, sf)), 8)


@query("daily_table", with_parts(
    """SELECT pool, (ts_ms // 86400000) * 86400000 AS ts_ms, count(*) AS swaps, round(sum(volume_q), 6) AS volume_quote,
              round(avg(CASE WHEN is_arb THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS arb_share, round(sum(fee_income), 6) AS fee_income,
              round(sum(arb_loss), 6) AS arb_loss, round(sum(lp_gain), 6) AS lp_gain,
              round(10000 * sum(arb_loss) / sum(volume_q), 6) AS arb_loss_bps, round(10000 * sum(fee_income) / sum(volume_q), 6) AS fee_bps
       FROM en GROUP BY 1, 2""", "en"))
def daily_table(spark, sf):
    return rounded(pn.daily_table(m.enriched_swaps(spark, sf)))


def _hod_sql() -> str:
    cols = []
    for r, test in (("pre", f"block < {m.CHANGE_BLOCK}"), ("post", f"block >= {m.CHANGE_BLOCK}")):
        f = f"FILTER ({test})"
        cols += [
            f"nullif(count(*) {f}, 0) AS {r}_swaps", f"round(sum(volume_q) {f}, 6) AS {r}_volume_quote",
            f"round(avg(CASE WHEN is_arb THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) {f}, 6) AS {r}_arb_share", f"round(sum(arb_loss) {f}, 6) AS {r}_arb_loss",
            f"round(sum(fee_income) {f}, 6) AS {r}_fee_income", f"round(10000 * sum(arb_loss) {f} / nullif(sum(volume_q) {f}, 0), 6) AS {r}_arb_loss_bps",
        ]
    return f"SELECT pool, CAST((ts_ms // 3600000) % 24 AS INTEGER) AS hod, {', '.join(cols)} FROM en GROUP BY 1, 2"


@query("hour_of_day_pivot", with_parts(_hod_sql(), "en"))
def hour_of_day_pivot(spark, sf):
    return rounded(pn.hour_of_day_table(m.enriched_swaps(spark, sf), m.CHANGE_BLOCK))


SWAP_STATS = "volume_q arb_volume fee_income arb_loss lp_gain arb_loss_arbs markout_30s ref_gap_mean_abs_bps ref_gap_rms_bps median_arb_size"
PARTS_REGIME = {
    "ss": (("en",), f"""
        SELECT pool, CASE WHEN block < {m.CHANGE_BLOCK} THEN 'pre' ELSE 'post' END AS regime, count(*) AS swaps, sum(volume_q) AS volume_q,
               count(*) FILTER (is_arb) AS n_arb, count(*) FILTER (is_arb_strict) AS n_arb_strict, coalesce(sum(volume_q) FILTER (is_arb), 0) AS arb_volume,
               sum(fee_income) AS fee_income, sum(arb_loss) AS arb_loss, sum(lp_gain) AS lp_gain, coalesce(sum(arb_loss) FILTER (is_arb), 0) AS arb_loss_arbs,
               sum(markout_30s) AS markout_30s, avg(abs(p_cex_1s / p_cex - 1)) * 10000 AS ref_gap_mean_abs_bps,
               sqrt(avg((p_cex_1s / p_cex - 1) * (p_cex_1s / p_cex - 1))) * 10000 AS ref_gap_rms_bps,
               quantile_cont(volume_q, 0.5) FILTER (is_arb) AS median_arb_size, count(DISTINCT block) AS blocks_with_swap
        FROM en GROUP BY 1, 2"""),
    "bs": (("bl",), f"""
        SELECT CASE WHEN number < {m.CHANGE_BLOCK} THEN 'pre' ELSE 'post' END AS regime, (max(milli_ts) - min(milli_ts)) / 3600000.0::DOUBLE AS hours,
               count(*) AS n_blocks, avg(gap) * 1000 AS block_interval_ms, count(gap) AS n_intervals
        FROM (SELECT *, (milli_ts - lag(milli_ts) OVER (ORDER BY number)) / 1000.0::DOUBLE AS gap FROM bl) GROUP BY 1"""),
    "sr": (("en", "cd"), f"""
        SELECT *, p_pool / p_cex - 1 AS dev, CASE WHEN ts_ms < {m.CHANGE_MS} THEN 'pre' ELSE 'post' END AS regime FROM (
          SELECT g.pool, g.ts_ms, last_value(l.p IGNORE NULLS) OVER w AS p_pool, last_value(c.close IGNORE NULLS) OVER w AS p_cex
          FROM (SELECT pool, unnest(range(min(ts_ms), max(ts_ms) + 1, 60000)) AS ts_ms FROM en GROUP BY pool) g
          LEFT JOIN (SELECT pool, ts_ms, arg_max(p_post, log_index) AS p FROM en GROUP BY pool, ts_ms) l USING (pool, ts_ms)
          LEFT JOIN cd c ON c.ts_ms = g.ts_ms WINDOW w AS (PARTITION BY g.pool ORDER BY g.ts_ms))
        WHERE p_pool IS NOT NULL AND p_cex IS NOT NULL"""),
    "ep": (("sr",), f"""
        SELECT pool, regime, run, count(*) AS length, min(ts_ms) AS start, max(ts_ms) AS stop FROM (
          SELECT *, sum(CASE WHEN o AND NOT coalesce(b, false) THEN 1 ELSE 0 END) OVER (PARTITION BY pool, regime ORDER BY ts_ms) AS run
          FROM (SELECT *, abs(dev) > {m.GAMMA} AS o, lag(abs(dev) > {m.GAMMA}) OVER (PARTITION BY pool, regime ORDER BY ts_ms) AS b FROM sr))
        WHERE o GROUP BY 1, 2, 3"""),
    "hl": (("sr",), """
        SELECT pool, regime, CASE WHEN n >= 100 AND rho > 0 AND rho < 1 THEN ln(0.5) / ln(rho) END AS half_life, rho, n
        FROM (SELECT pool, regime, count(*) AS n, covar_samp(x, dev) / var_pop(x) AS rho
              FROM (SELECT *, lag(dev) OVER (PARTITION BY pool, regime ORDER BY ts_ms) AS x FROM sr) WHERE x IS NOT NULL GROUP BY 1, 2)"""),
    "st": (("sr", "ep", "hl"), f"""
        SELECT a.*, e.mean_length * 60 AS outside_episode_mean_s, h.half_life * 60 AS dev_half_life_s, v.v1 AS ref_vol_step_bps, w.v60 AS ref_vol_60_steps_bps
        FROM (SELECT pool, regime, avg(abs(dev)) * 10000 AS mean_abs_dev_bps, avg(CASE WHEN abs(dev) > {m.GAMMA} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS share_outside_band FROM sr GROUP BY 1, 2) a
        LEFT JOIN (SELECT pool, regime, avg(length) AS mean_length FROM ep GROUP BY 1, 2) e USING (pool, regime)
        LEFT JOIN hl h USING (pool, regime)
        LEFT JOIN (SELECT pool, regime, stddev_samp(r) * 10000 AS v1 FROM (SELECT pool, regime, ln(p_cex) - ln(lag(p_cex) OVER (PARTITION BY pool, regime ORDER BY ts_ms)) AS r FROM sr) GROUP BY 1, 2) v USING (pool, regime)
        LEFT JOIN (SELECT pool, regime, stddev_samp(r) * 10000 / sqrt(60) AS v60 FROM (
                     SELECT pool, regime, ln(p_cex) - ln(lag(p_cex) OVER (PARTITION BY pool, regime ORDER BY ts_ms)) AS r
                     FROM (SELECT *, row_number() OVER (PARTITION BY pool, regime ORDER BY ts_ms) AS i FROM sr) WHERE (i - 1) % 60 = 0) GROUP BY 1, 2) w USING (pool, regime)"""),
}
m.PARTS.update(PARTS_REGIME)


@query("swap_statistics", with_parts(
    f"SELECT pool, regime, swaps, n_arb, n_arb_strict, blocks_with_swap, {sql_round(SWAP_STATS)} FROM ss", "ss"))
def swap_statistics(spark, sf):
    return rounded(rg.swap_statistics(m.enriched_swaps(spark, sf), m.CHANGE_BLOCK))


REGIME_COLS = (
    "hours block_interval_ms swaps_per_block share_blocks_with_swap volume_quote_per_hour arb_swaps_share arb_strict_share arb_volume_share arb_swaps_per_hour "
    "median_arb_size fee_bps_of_volume arb_loss_bps_of_volume lp_net_bps_of_volume arb_loss_over_fee arb_loss_per_hour arb_loss_per_arb mean_abs_dev_bps "
    "share_outside_band dev_half_life_s outside_episode_mean_s ref_vol_step_bps ref_vol_60_steps_bps arb_loss_rate_over_sigma2 arb_loss_rate_over_sigma3 "
    "markout_30s_bps_of_volume ref_gap_mean_abs_bps ref_gap_rms_bps"
)
REGIME_SQL = with_parts(f"""
    SELECT pool, regime, n_blocks, n_intervals, swaps, {sql_round(REGIME_COLS, 4)} FROM (
      SELECT s.pool, s.regime, b.hours, b.n_blocks, b.block_interval_ms, b.n_intervals, s.swaps, s.swaps / b.n_blocks::DOUBLE AS swaps_per_block,
             s.blocks_with_swap / b.n_blocks::DOUBLE AS share_blocks_with_swap, s.volume_q / b.hours AS volume_quote_per_hour,
             s.n_arb / s.swaps::DOUBLE AS arb_swaps_share, s.n_arb_strict / s.swaps::DOUBLE AS arb_strict_share, s.arb_volume / s.volume_q AS arb_volume_share,
             s.n_arb / b.hours AS arb_swaps_per_hour, s.median_arb_size, 10000 * s.fee_income / s.volume_q AS fee_bps_of_volume,
             10000 * s.arb_loss / s.volume_q AS arb_loss_bps_of_volume, 10000 * s.lp_gain / s.volume_q AS lp_net_bps_of_volume,
             s.arb_loss / s.fee_income AS arb_loss_over_fee, s.arb_loss / b.hours AS arb_loss_per_hour, s.arb_loss_arbs / s.n_arb AS arb_loss_per_arb,
             t.mean_abs_dev_bps, t.share_outside_band, t.dev_half_life_s, t.outside_episode_mean_s, t.ref_vol_step_bps, t.ref_vol_60_steps_bps,
             s.arb_loss / b.hours / power(t.ref_vol_60_steps_bps / 10000, 2) AS arb_loss_rate_over_sigma2,
             s.arb_loss / b.hours / power(t.ref_vol_60_steps_bps / 10000, 3) AS arb_loss_rate_over_sigma3,
             10000 * s.markout_30s / s.volume_q AS markout_30s_bps_of_volume, s.ref_gap_mean_abs_bps, s.ref_gap_rms_bps
      FROM ss s JOIN bs b USING (regime) LEFT JOIN st t USING (pool, regime))""", "ss", "bs", "st")


@query("regime_table", REGIME_SQL)
def regime_table(spark, sf):
    from tideline.operators.blocks import with_intervals

    swaps = m.enriched_swaps(spark, sf)
    fees = swaps.groupBy("pool").agg(F.max("fee_rate").alias("fee_rate"))
    series = rg.series_statistics(market_series(spark, sf), fees, m.CHANGE_MS, m.STEP_MS)
    blocks = rg.block_statistics(with_intervals(m.blocks(spark, sf)), m.CHANGE_BLOCK)
    return rounded(rg.regime_table(rg.swap_statistics(swaps, m.CHANGE_BLOCK), blocks, series), 4)


@query("last_per_bucket", with_parts(
    """SELECT event_type AS symbol, (ts_ms // 60000) * 60000 AS ts_ms, arg_max(value, (ts_ms, event_id)) AS value FROM ev GROUP BY 1, 2""", "ev"))
def last_per_bucket_query(spark, sf):
    return last_per_bucket(m.events(spark, sf).withColumn("symbol", F.col("event_type")), ["symbol"], "ts_ms", "event_id", "value", clock.MINUTE_MS)


@query("block_table_contiguity", with_parts(
    "SELECT min(number) AS first_block, max(number) AS last_block, count(*) AS n_rows, count(DISTINCT number) AS n_numbers, count(*) = count(DISTINCT number) AND max(number) - min(number) + 1 = count(*) AS contiguous FROM bl", "bl"))
def block_table_contiguity(spark, sf):
    return contiguity(m.blocks(spark, sf))
