"""Raw pool trades to enriched swaps: prices, flows, exact times, reference prices, per-trade metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tideline.functions import pricing
from tideline.operators.asof import as_of, as_of_many, looked_up
from tideline.operators.ordered import HOUR_MS, previous_row

ORDER = ["block", "log_index"]
# Width of one slice in block numbers (about an hour of blocks at sub-second intervals).
BLOCK_SLICE = 5_000


def prepare_swaps(raw: DataFrame, pools: DataFrame) -> DataFrame:
    """Pool price, oriented flows and fee of every raw swap. ``pools`` is the pool dimension (one row per pool)."""
    joined = raw.join(pools, "pool")
    base, quote = pricing.oriented(
        pricing.number_from_text(F.col("amount0")), pricing.number_from_text(F.col("amount1")),
        F.col("dec0"), F.col("dec1"), F.col("base_is_token0"),
    )
    price = pricing.pool_price(
        pricing.number_from_text(F.col("sqrt_price_x96")), F.col("dec0"), F.col("dec1"), F.col("base_is_token0")
    )
    return joined.select(
        "*", price.alias("p_post"), base.alias("dB"), quote.alias("dQ"), pricing.fee_rate(F.col("fee")).alias("fee_rate")
    ).drop("amount0", "amount1", "sqrt_price_x96", "protocol_fee0", "protocol_fee1")


def with_block_time(swaps: DataFrame, blocks: DataFrame) -> DataFrame:
    """Exact block time; the provider's seconds where the block is unknown; rows with neither are dropped."""
    known = blocks.select(F.col("number").alias("block"), "milli_ts")
    joined = swaps.join(known, "block", "left")
    seconds = F.when(F.col("block_ts") > 0, F.col("block_ts") * 1000)
    return joined.withColumn("ts_ms", F.coalesce("milli_ts", seconds).cast("bigint")).drop("milli_ts").filter("ts_ms IS NOT NULL")


def with_previous_price(swaps: DataFrame, bounded: bool = False) -> DataFrame:
    return previous_row(swaps, ["pool"], ORDER, {"p_pre": "p_post"}, width=BLOCK_SLICE, bounded=bounded)


def with_references(
    swaps: DataFrame, ticks: DataFrame, candles: DataFrame | None, lag_ms: int = 0, candle_age_ms: int = 1000,
    horizons_ms: dict[str, int] | None = None, bounded: bool = False, times: DataFrame | None = None,
) -> DataFrame:
    """Reference prices as of the swap (minus ``lag_ms``) and of later horizons, all in one carried-forward pass.

    They depend on symbol and time alone, so that each time is asked once and the swaps are joined with the answers. ``times`` are rows
    that hold the swaps' symbols and times and cost less to read twice, such as the raw swaps.
    ``ticks``: symbol, ts_ms, price. ``candles``: symbol, ts_ms, close; when given, the last completed candle is
    attached as p_cex_1s for the reference-gap statistics."""
    horizons = {"5": 5_000, "30": 30_000} if horizons_ms is None else horizons_ms
    queries: dict[str, tuple[Column, str]] = {"p_cex": (F.col("ts_ms") - F.lit(lag_ms), "price")}
    for name, shift in horizons.items():
        queries[f"p_cex_h{name}"] = (F.col("ts_ms") + F.lit(shift), "price")
    asked = (swaps if times is None else times).select("symbol", "ts_ms").distinct()
    out = as_of_many(asked, ticks, ["symbol"], ["symbol", "ts_ms"], queries, "ts_ms", width=HOUR_MS, bounded=bounded)
    if candles is None:
        return looked_up(swaps, out, list(queries))
    at = F.col("ts_ms") - F.lit(candle_age_ms)
    return looked_up(swaps, as_of(out, candles, ["symbol"], at, "ts_ms", {"p_cex_1s": "close"}, bounded=bounded), [*queries, "p_cex_1s"])


def with_candle_reference(swaps: DataFrame, candles: DataFrame, horizons_ms: dict[str, int] | None = None, bounded=False) -> DataFrame:
    """Reference from completed candles only: close of the last candle that ended before the swap."""
    horizons = {"5": 5_000, "30": 30_000} if horizons_ms is None else horizons_ms
    queries: dict[str, tuple[Column, str]] = {"p_cex": (F.col("ts_ms") - F.lit(1000), "close")}
    for name, shift in horizons.items():
        queries[f"p_cex_h{name}"] = (F.col("ts_ms") + F.lit(shift), "close")
    asked = swaps.select("symbol", "ts_ms").distinct()
    return looked_up(swaps, as_of_many(asked, candles, ["symbol"], ["symbol", "ts_ms"], queries, "ts_ms", bounded=bounded), list(queries))


def enriched(
    swaps: DataFrame, ticks: DataFrame, candles: DataFrame | None = None, lag_ms: int = 0, candle_age_ms: int = 1000,
    horizons_ms: dict[str, int] | None = None, bounded: bool = False,
) -> DataFrame:
    """Aligned swaps with all metrics; swaps without a previous price or a reference are dropped.

    Needs pool, symbol, block, log_index, ts_ms, p_post, dB, dQ, fee_rate."""
    priced = with_previous_price(swaps, bounded)
    referenced = with_references(priced, ticks, candles, lag_ms, candle_age_ms, horizons_ms, bounded, swaps)
    return pricing.with_trade_metrics(referenced.na.drop(subset=["p_pre", "p_cex"]))
