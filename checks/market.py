"""A market read from the test tables.

events -> swaps (pool = event type, price = value, order = minute block and event id), the reference series is the
value of ``view`` events (plus one hundredth: a price is never zero), blocks are the minutes of the time span, the change point is
2024-01-16 00:00. As in the jobs, enriched swaps, panels and arbitrages are written once and read by every later query of the session;
``forget`` makes the next query write them again.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tideline.functions import clock
from tideline.operators.asof import last_per_bucket
from tideline.operators.blocks import number_spine
from tideline.operators.openings import blocks_waited, classify_openings, last_inside_band, with_opening_sizes
from tideline.operators.ordered import previous_row
from tideline.plans.enrich import BLOCK_SLICE, ORDER, enriched
from tideline.plans.panel import hourly_panel
from tideline.session import prepare, scratch_folder

CHANGE_MS = 1_705_363_200_000
CHANGE_BLOCK = CHANGE_MS // 60_000
GAMMA = 0.3
SEARCH_MS = 4 * 3_600_000
MAX_TAU_MS = 4 * 3_600_000
DT_PRE_MS, DT_POST_MS = 60_000, 45_000
STEP_MS = 60_000
HORIZONS = {"5": 300_000, "30": 1_800_000}
PUBLIC_WALLETS, PUBLIC_MEDIAN = 50, 1


_WRITTEN: dict[tuple, str] = {}


def forget() -> None:
    _WRITTEN.clear()


def written(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A table that is written once per session and arguments."""

    @functools.wraps(build)
    def read(spark: SparkSession, sf: str, *args, **named) -> DataFrame:
        key = (spark.sparkContext.applicationId, build.__name__, sf, *args, *sorted(named.items()))
        if key not in _WRITTEN:
            folder = scratch_folder(spark, build.__name__)
            build(spark, sf, *args, **named).write.parquet(folder)
            _WRITTEN[key] = folder
        return prepare(spark).read.parquet(_WRITTEN[key])

    return read


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id", clock.epoch_ms(F.col("ts")).alias("ts_ms"), "user_id", "event_type", F.round(F.col("value") + F.lit(0.01), 2).alias("value"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


def swaps(spark: SparkSession, sf: str) -> DataFrame:
    size = (F.col("k").cast("double") - 49.5) / 10.0
    block = F.floor(F.col("ts_ms") / 60_000).cast("bigint")
    return events(spark, sf).select(
        F.col("event_type").alias("pool"),
        F.lit("REF").alias("symbol"),
        block.alias("block"),
        (block * 60_000).alias("ts_ms"),
        F.col("event_id").alias("log_index"),
        F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("sender"),
        F.concat(F.lit("w"), F.col("k").cast("string")).alias("tx_from"),
        F.col("value").alias("p_post"),
        size.alias("dB"),
        (-size * F.col("value")).alias("dQ"),
        F.lit(GAMMA).alias("fee_rate"),
        (F.col("k").cast("double") + 1.0).alias("liquidity"),
    )


def ticks(spark: SparkSession, sf: str, event_type: str = "view") -> DataFrame:
    trades = events(spark, sf).filter(F.col("event_type") == event_type)
    collapsed = last_per_bucket(trades.withColumn("symbol", F.lit("REF")), ["symbol"], "ts_ms", "event_id", "value")
    return collapsed.withColumnRenamed("value", "price")


def candles(spark: SparkSession, sf: str) -> DataFrame:
    trades = events(spark, sf).filter("event_type = 'view'").withColumn("symbol", F.lit("REF"))
    return last_per_bucket(trades, ["symbol"], "ts_ms", "event_id", "value", STEP_MS).withColumnRenamed("value", "close")


def pool_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select(F.col("event_type").alias("pool"), F.lit("REF").alias("symbol")).distinct()


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    minute = F.floor(F.col("ts_ms") / 60_000).cast("bigint")
    span = events(spark, sf).agg(F.min(minute).alias("_s"), F.max(minute).alias("_e"))
    return number_spine(span, [], "_s", "_e").select("number", (F.col("number") * 60_000).alias("milli_ts"))


@written
def enriched_swaps(spark: SparkSession, sf: str, lag_ms: int = 0, bounded: bool | None = None) -> DataFrame:
    return enriched(
        swaps(spark, sf), ticks(spark, sf), candles(spark, sf), lag_ms=lag_ms, candle_age_ms=STEP_MS,
        horizons_ms=HORIZONS, bounded=bounded,
    )


@written
def panel(spark: SparkSession, sf: str, lag_ms: int = 0, bounded: bool | None = None) -> DataFrame:
    return hourly_panel(enriched_swaps(spark, sf, lag_ms), CHANGE_MS, DT_PRE_MS / 1000, DT_POST_MS / 1000, bounded)


@written
def arb_candidates(spark: SparkSession, sf: str, bounded: bool | None = None) -> DataFrame:
    state = {f"prev_{c}": c for c in ("ts_ms", "block", "dev_pre", "dev_post", "is_arb")}
    stepped = previous_row(enriched_swaps(spark, sf), ["pool"], ORDER, state, width=BLOCK_SLICE, bounded=bounded)
    return stepped.filter("is_arb AND prev_ts_ms IS NOT NULL")


@written
def arbs(spark: SparkSession, sf: str, bounded: bool | None = None) -> DataFrame:
    candidates = arb_candidates(spark, sf, bounded)
    ranges = last_inside_band(candidates, ticks(spark, sf), pool_symbols(spark, sf), SEARCH_MS, bounded=bounded)
    opened = with_opening_sizes(classify_openings(candidates, ranges, SEARCH_MS))
    waited = blocks_waited(opened, blocks(spark, sf), bounded)
    return waited.select(
        "*", F.when(F.col("block") < CHANGE_BLOCK, "pre").otherwise("post").alias("regime"),
        clock.days_since(F.col("ts_ms"), CHANGE_MS).alias("days_from_change"),
    )


# --------------------------------------------------------------------------------------------------------- SQL twins

PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "ev": ((), """
        SELECT event_id, epoch_us(ts) // 1000 AS ts_ms, user_id, event_type, round(value + 0.01::DOUBLE, 2) AS value,
               CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k
        FROM events"""),
    "sw": (("ev",), f"""
        SELECT event_type AS pool, ts_ms // 60000 AS block, (ts_ms // 60000) * 60000 AS ts_ms, event_id AS log_index,
               'c' || user_id AS sender, 'w' || k AS tx_from, value AS p_post,
               lag(value) OVER (PARTITION BY event_type ORDER BY ts_ms // 60000, event_id) AS p_pre,
               (CAST(k AS DOUBLE) - 49.5) / 10.0 AS dB, -((CAST(k AS DOUBLE) - 49.5) / 10.0) * value AS dQ,
               CAST({GAMMA} AS DOUBLE) AS fee_rate, CAST(k AS DOUBLE) + 1.0 AS liquidity
        FROM ev"""),
    "tk": (("ev",), """
        SELECT ts_ms, arg_max(value, event_id) AS price FROM ev WHERE event_type = 'view' GROUP BY ts_ms"""),
    "cd": (("ev",), """
        SELECT (ts_ms // 60000) * 60000 AS ts_ms, arg_max(value, (ts_ms, event_id)) AS close
        FROM ev WHERE event_type = 'view' GROUP BY 1"""),
    "bl": (("ev",), """
        SELECT number, number * 60000 AS milli_ts
        FROM (SELECT unnest(range(min(ts_ms // 60000), max(ts_ms // 60000) + 1)) AS number FROM ev)"""),
}


def _enriched_sql(lag_ms: int) -> str:
    return f"""
        SELECT *, is_arb AND abs(dev_post) <= fee_rate AS is_arb_strict,
               fee_rate * volume_q - lp_gain AS arb_loss, fee_rate * volume_q AS fee_income
        FROM (
          SELECT *, abs(dev_pre) > fee_rate AND sign(dev_post - dev_pre) = -sign(dev_pre)
                    AND abs(dev_post) < abs(dev_pre) AS is_arb,
                 CASE WHEN dB > 0 THEN dB * p_cex ELSE greatest(dQ, 0.0) END AS volume_q,
                 dQ + dB * p_cex AS lp_gain, dQ + dB * p_cex_h5 AS markout_5s, dQ + dB * p_cex_h30 AS markout_30s
          FROM (
            SELECT s.*, r.price AS p_cex, c.close AS p_cex_1s, h5.price AS p_cex_h5, h30.price AS p_cex_h30,
                   s.p_pre / r.price - 1 AS dev_pre, s.p_post / r.price - 1 AS dev_post
            FROM sw s
            ASOF LEFT JOIN tk r ON s.ts_ms - {lag_ms} >= r.ts_ms
            ASOF LEFT JOIN cd c ON s.ts_ms - {STEP_MS} >= c.ts_ms
            ASOF LEFT JOIN tk h5 ON s.ts_ms + {HORIZONS['5']} >= h5.ts_ms
            ASOF LEFT JOIN tk h30 ON s.ts_ms + {HORIZONS['30']} >= h30.ts_ms
            WHERE s.p_pre IS NOT NULL AND r.price IS NOT NULL))"""


def _vol_sql(source: str) -> str:
    return f"""
        SELECT pool, hour_ms, sum(r * r) AS rv, sqrt(sum(r * r) / 3600.0) AS sigma_ps
        FROM (SELECT pool, (minute_ms // 3600000) * 3600000 AS hour_ms,
                     ln(p) - ln(lag(p) OVER (PARTITION BY pool ORDER BY minute_ms)) AS r
              FROM (SELECT g.pool, g.minute_ms, last_value(l.p IGNORE NULLS) OVER (PARTITION BY g.pool ORDER BY g.minute_ms) AS p
                    FROM (SELECT pool, unnest(range(min(ts_ms), max(ts_ms) + 1, 60000)) AS minute_ms FROM {source} GROUP BY pool) g
                    LEFT JOIN (SELECT pool, ts_ms, arg_max(p_cex, log_index) AS p FROM {source} GROUP BY pool, ts_ms) l
                      ON l.pool = g.pool AND l.ts_ms = g.minute_ms))
        WHERE r IS NOT NULL GROUP BY pool, hour_ms"""


def _panel_sql(source: str, vol: str) -> str:
    return f"""
        SELECT g.pool, g.hour_ms, coalesce(a.swaps, 0) AS swaps, coalesce(a.volume, 0) AS volume,
               coalesce(a.fee_income, 0) AS fee_income, coalesce(a.lp_gain, 0) AS lp_gain, coalesce(a.arb_loss, 0) AS arb_loss,
               coalesce(a.markout_30s, 0) AS markout_30s, coalesce(a.n_arb, 0) AS n_arb, coalesce(a.n_arb_strict, 0) AS n_arb_strict,
               coalesce(a.arb_volume, 0) AS arb_volume, coalesce(a.arb_loss_arbs, 0) AS arb_loss_arbs,
               coalesce(a.arb_profit, 0) AS arb_profit, a.overshoot_bps, a.overshoot_strict_bps, a.mean_abs_dev_pre,
               a.share_swaps_outside, a.liq_mean, a.ref_gap_bps, a.median_arb_size, v.rv, v.sigma_ps,
               CAST({GAMMA} AS DOUBLE) AS fee, CASE WHEN g.hour_ms >= {CHANGE_MS} THEN 1 ELSE 0 END AS post,
               CAST((g.hour_ms // 3600000) % 24 AS INTEGER) AS hod, CAST((g.hour_ms // 86400000 + 3) % 7 AS INTEGER) AS dow,
               CAST(DATE '1970-01-01' + CAST(g.hour_ms // 86400000 AS INTEGER) AS DATE) AS day,
               10000 * a.arb_loss / nullif(a.volume, 0) AS arb_loss_bps, 10000 * a.lp_gain / nullif(a.volume, 0) AS lp_net_bps,
               a.arb_loss_arbs / nullif(a.n_arb, 0) AS loss_per_arb,
               CASE WHEN g.hour_ms >= {CHANGE_MS} THEN CAST({DT_POST_MS / 1000} AS DOUBLE) ELSE CAST({DT_PRE_MS / 1000} AS DOUBLE) END AS dt,
               (g.hour_ms - {CHANGE_MS}) / 86400000.0::DOUBLE AS t_days
        FROM (SELECT pool, unnest(range((min(ts_ms) // 3600000) * 3600000, max(ts_ms) + 1, 3600000)) AS hour_ms FROM {source} GROUP BY pool) g
        LEFT JOIN (
          SELECT pool, (ts_ms // 3600000) * 3600000 AS hour_ms, count(*) AS swaps, sum(volume_q) AS volume, sum(fee_income) AS fee_income,
                 sum(lp_gain) AS lp_gain, sum(arb_loss) AS arb_loss, sum(markout_30s) AS markout_30s,
                 count(*) FILTER (is_arb) AS n_arb, count(*) FILTER (is_arb_strict) AS n_arb_strict,
                 coalesce(sum(volume_q) FILTER (is_arb), 0) AS arb_volume, coalesce(sum(arb_loss) FILTER (is_arb), 0) AS arb_loss_arbs,
                 coalesce(sum(arb_loss - fee_income) FILTER (is_arb), 0) AS arb_profit,
                 avg(10000 * (abs(dev_pre) - fee_rate)) FILTER (is_arb) AS overshoot_bps,
                 avg(10000 * (abs(dev_pre) - fee_rate)) FILTER (is_arb_strict) AS overshoot_strict_bps,
                 avg(abs(dev_pre)) AS mean_abs_dev_pre, avg(CASE WHEN abs(dev_pre) > fee_rate THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS share_swaps_outside,
                 avg(liquidity) AS liq_mean, 10000 * sum(abs(p_cex_1s / p_cex - 1)) / count(*) AS ref_gap_bps,
                 quantile_cont(volume_q, 0.5) FILTER (is_arb) AS median_arb_size
          FROM {source} GROUP BY 1, 2) a ON a.pool = g.pool AND a.hour_ms = g.hour_ms
        LEFT JOIN {vol} v ON v.pool = g.pool AND v.hour_ms = g.hour_ms"""


PARTS["en"] = (("sw", "tk", "cd"), _enriched_sql(0))
PARTS["en1"] = (("sw", "tk", "cd"), _enriched_sql(3_600_000))
PARTS["vol"] = (("en",), _vol_sql("en"))
PARTS["vol1"] = (("en1",), _vol_sql("en1"))
PARTS["pn"] = (("en", "vol"), _panel_sql("en", "vol"))
PARTS["pn1"] = (("en1", "vol1"), _panel_sql("en1", "vol1"))
PARTS["ca"] = (("en",), """
        SELECT * FROM (
          SELECT *, lag(ts_ms) OVER w AS prev_ts_ms, lag(block) OVER w AS prev_block, lag(dev_pre) OVER w AS prev_dev_pre,
                 lag(dev_post) OVER w AS prev_dev_post, lag(is_arb) OVER w AS prev_is_arb
          FROM en WINDOW w AS (PARTITION BY pool ORDER BY block, log_index))
        WHERE is_arb AND prev_ts_ms IS NOT NULL""")


def _ranges_sql() -> str:
    picks = []
    for m, s in ((1.0, ""), (1.5, "_m15"), (2.0, "_m20")):
        inside = f"t.price >= a.p_pre / (1 + {m}::DOUBLE * a.fee_rate) AND t.price <= a.p_pre / (1 - {m}::DOUBLE * a.fee_rate)"
        picks.append(f"arg_max(coalesce(t.nts, t.ts_ms), t.ts_ms) FILTER ({inside}) AS cross_ts{s}")
        picks.append(f"arg_max(coalesce(t.npx, t.price), t.ts_ms) FILTER ({inside}) AS cross_price{s}")
    return f"""
        SELECT a.pool, a.block, a.log_index, min(t.ts_ms) AS first_ts, arg_min(t.price, t.ts_ms) AS first_price, {', '.join(picks)}
        FROM ca a JOIN (SELECT *, lead(ts_ms) OVER (ORDER BY ts_ms) AS nts, lead(price) OVER (ORDER BY ts_ms) AS npx FROM tk) t
          ON t.ts_ms > greatest(a.prev_ts_ms, a.ts_ms - {SEARCH_MS}) AND t.ts_ms <= a.ts_ms
        GROUP BY ALL"""


def _opened_sql() -> str:
    cols = []
    for m, s in ((1.0, ""), (1.5, "_m15"), (2.0, "_m20")):
        band = f"({m}::DOUBLE * fee_rate)"
        below = "" if m == 1.0 else f"WHEN abs(dev_pre) <= {band} THEN {{below}}"

        def rule(below_value, cross, same, first, long, onchain, rest):
            return f"""CASE {below.format(below=below_value) if below else ''}
                WHEN cross_ts{s} IS NOT NULL THEN {cross} WHEN prev_ts_ms = ts_ms THEN {same}
                WHEN abs(prev_dev_post) <= {band} AND first_ts IS NOT NULL THEN {first}
                WHEN ts_ms - {SEARCH_MS} > prev_ts_ms THEN {long}
                WHEN abs(prev_dev_post) > {band} AND abs(prev_dev_pre) <= {band} THEN {onchain} ELSE {rest} END"""

        cols.append(rule("'below_threshold'", "'cex'", "'same_block'", "'cex'", "'long'", "'onchain'", "'continuation'") + f" AS trigger{s}")
        cols.append(rule("-1", f"cross_ts{s}", "ts_ms", "first_ts", "-1", "prev_ts_ms", "prev_ts_ms") + f" AS t_open{s}")
        if m == 1.0:
            cols.append(rule("NULL", "cross_price", "NULL", "first_price", "NULL", "NULL", "NULL") + " AS p_open")
    return f"SELECT ca.*, {', '.join(cols)} FROM ca LEFT JOIN rg USING (pool, block, log_index)"


PARTS["rg"] = (("ca", "tk"), _ranges_sql())
PARTS["op"] = (("ca", "rg"), _opened_sql())
PARTS["ar"] = (("op",), f"""
        SELECT *, CASE WHEN t_open >= 0 THEN ts_ms - t_open ELSE -1 END AS tau_ms,
               CASE WHEN t_open_m15 >= 0 THEN ts_ms - t_open_m15 ELSE -1 END AS tau_ms_m15,
               CASE WHEN t_open_m20 >= 0 THEN ts_ms - t_open_m20 ELSE -1 END AS tau_ms_m20,
               CASE WHEN t_open >= 0 THEN block - t_open // 60000 ELSE 0 END AS k_blocks,
               CASE WHEN t_open >= 0 THEN (block - 1) * 60000 - t_open ELSE -1 END AS tau_lo_ms,
               (abs(dev_pre) - fee_rate) * 10000 AS overshoot_bps,
               CASE WHEN trigger = 'cex' THEN greatest((abs(p_pre / p_open - 1) - fee_rate) * 10000, 0) END AS jump_bps,
               (abs(dev_pre) - fee_rate) * 10000
                 - CASE WHEN trigger = 'cex' THEN greatest((abs(p_pre / p_open - 1) - fee_rate) * 10000, 0) END AS move_bps,
               CASE WHEN block < {CHANGE_BLOCK} THEN 'pre' ELSE 'post' END AS regime,
               (ts_ms - {CHANGE_MS}) / 86400000.0::DOUBLE AS days_from_change
        FROM op""")


def with_parts(body: str, *parts: str) -> str:
    """``body`` preceded by the named parts and everything they need, in order."""
    needed: list[str] = []

    def visit(name: str):
        for before in PARTS[name][0]:
            visit(before)
        if name not in needed:
            needed.append(name)

    for name in parts:
        visit(name)
    chain = ",\n".join(f"{name} AS ({PARTS[name][1]})" for name in needed)
    joint = "" if body.lstrip().startswith(",") else "\n"  # a body may open with further parts of its own
    return f"WITH RECURSIVE {chain}{joint}{body}"
