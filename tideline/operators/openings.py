"""When did each arbitrage opportunity open, and what opened it?

The search range of a swap is (previous swap, this swap], so the ranges of one pool never overlap and every tick
falls into the range of at most one swap. Finding the last tick inside the band is therefore not a range join with
many candidates per row: each tick is handed to the next arbitrage of the pool (one carried-backward column), and an
ordinary aggregation per arbitrage keeps the latest inside tick. Work is linear in ticks plus arbitrages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tideline.functions.pricing import BAND_MULTIPLIERS, band_high, band_low, jump_bps, overshoot_bps
from tideline.operators.asof import as_of, looked_up
from tideline.operators.ordered import HOUR_MS, carry_backward, next_row
from tideline.session import stored


def suffix(multiplier: float) -> str:
    """Column suffix of a band multiplier: none for 1, else e.g. ``_m15``."""
    return "" if multiplier == 1.0 else f"_m{int(round(multiplier * 10))}"


def last_inside_band(
    arbs: DataFrame,
    ticks: DataFrame,
    pool_symbols: DataFrame,
    max_search_ms: int,
    multipliers: tuple[float, ...] = BAND_MULTIPLIERS,
    row_key: tuple[str, ...] = ("block", "log_index"),
    bounded: bool = False,
) -> DataFrame:
    """Per arbitrage and band: the tick after the last inside tick in the search range, and the range's first tick.

    ``arbs``: pool, row_key, ts_ms, prev_ts_ms, p_pre, fee_rate. ``ticks``: symbol, ts_ms (unique), price.
    ``pool_symbols``: pool, symbol (a dimension table). Only arbitrages with ticks in range appear in the result."""
    following = next_row(ticks, ["symbol"], ["ts_ms"], {"next_ts": "ts_ms", "next_price": "price"}, bounded=bounded)
    last_tick = F.coalesce("next_ts", "ts_ms"), F.coalesce("next_price", "price")
    offered = following.join(pool_symbols.select("pool", "symbol"), "symbol").select(
        "pool",
        F.col("ts_ms").alias("_t"),
        F.lit(0).alias("_side"),
        *[F.lit(0).cast("bigint").alias(f"_o{i}") for i in range(len(row_key))],
        F.struct(F.col("price"), last_tick[0].alias("next_ts"), last_tick[1].alias("next_price")).alias("_tick"),
    )
    start = F.greatest(F.col("prev_ts_ms"), F.col("ts_ms") - F.lit(max_search_ms))
    wanted = F.struct(*row_key, F.col("ts_ms").alias("t_b"), start.alias("start"), "p_pre", "fee_rate")
    takers = arbs.select(
        "pool",
        F.col("ts_ms").alias("_t"),
        F.lit(1).alias("_side"),
        *[F.col(c).cast("bigint").alias(f"_o{i}") for i, c in enumerate(row_key)],
        wanted.alias("_arb"),
    )
    order = ["_t", "_side", *[f"_o{i}" for i in range(len(row_key))]]
    stacked = offered.unionByName(takers, allowMissingColumns=True)
    matched = (
        carry_backward(stacked, ["pool"], order, {"_to": "_arb"}, width=HOUR_MS, bounded=bounded)
        .filter((F.col("_side") == 0) & F.col("_to").isNotNull() & (F.col("_t") > F.col("_to.start")))
        .select("pool", "_t", "_tick", "_to.*")
    )
    aggs: list[Column] = [
        F.min("_t").alias("first_ts"),
        F.min_by(F.col("_tick.price"), F.col("_t")).alias("first_price"),
    ]
    for m in multipliers:
        width = F.lit(m) * F.col("fee_rate")
        inside = (F.col("_tick.price") >= band_low(F.col("p_pre"), width)) & (
            F.col("_tick.price") <= band_high(F.col("p_pre"), width)
        )
        at = F.when(inside, F.col("_t"))
        aggs += [
            F.max_by(F.col("_tick.next_ts"), at).alias(f"cross_ts{suffix(m)}"),
            F.max_by(F.col("_tick.next_price"), at).alias(f"cross_price{suffix(m)}"),
        ]
    return matched.groupBy("pool", *row_key).agg(*aggs)


def classify_openings(
    arbs: DataFrame, ranges: DataFrame, max_search_ms: int, has_ticks: Column | None = None,
    multipliers: tuple[float, ...] = BAND_MULTIPLIERS, row_key: tuple[str, ...] = ("block", "log_index"),
) -> DataFrame:
    """Adds t_open, trigger, p_open, tau_ms per band by the ordered rules.

    Rules, first match wins: an inside tick was found -> cex at the tick after it; same block as the previous swap;
    the previous swap left the price inside and there is a tick -> cex at the first tick; the search stopped before
    the previous swap -> long; the previous swap pushed the price out -> onchain; otherwise continuation. A wider
    band the deviation never reached is below_threshold. Without any ticks to consult (``has_ticks`` false):
    no_ticks."""
    out = arbs.join(ranges, ["pool", *row_key], "left")
    same_block = F.col("prev_ts_ms") == F.col("ts_ms")
    cut_short = F.col("ts_ms") - F.lit(max_search_ms) > F.col("prev_ts_ms")
    for m in multipliers:
        s = suffix(m)
        band = F.lit(m) * F.col("fee_rate")
        was_inside = F.abs("prev_dev_post") <= band
        came_inside = F.abs("prev_dev_pre") <= band
        found = F.col(f"cross_ts{s}").isNotNull()
        first = was_inside & F.col("first_ts").isNotNull()
        rules: list[tuple[Column, str, Column, Column]] = []
        nothing, no_price = F.lit(-1).cast("bigint"), F.lit(None).cast("double")
        if has_ticks is not None:
            rules.append((~has_ticks, "no_ticks", nothing, no_price))
        if m != 1.0:
            rules.append((F.abs("dev_pre") <= band, "below_threshold", nothing, no_price))
        rules += [
            (found, "cex", F.col(f"cross_ts{s}"), F.col(f"cross_price{s}")),
            (same_block, "same_block", F.col("ts_ms"), no_price),
            (first, "cex", F.col("first_ts"), F.col("first_price")),
            (cut_short, "long", nothing, no_price),
            (~was_inside & came_inside, "onchain", F.col("prev_ts_ms"), no_price),
            (F.lit(True), "continuation", F.col("prev_ts_ms"), no_price),
        ]
        chosen = None
        for test, name, opened, price in rules:
            value = F.struct(F.lit(name).alias("trigger"), opened.alias("t_open"), price.alias("p_open"))
            chosen = F.when(test, value) if chosen is None else chosen.when(test, value)
        out = out.withColumn("_rule", chosen).select(
            "*",
            F.col("_rule.trigger").alias(f"trigger{s}"),
            F.col("_rule.t_open").alias(f"t_open{s}"),
            F.col("_rule.p_open").alias(f"p_open{s}"),
        ).drop("_rule")
        opened = F.col(f"t_open{s}")
        out = out.withColumn(f"tau_ms{s}", F.when(opened >= 0, F.col("ts_ms") - opened).otherwise(F.lit(-1).cast("bigint")))
    extra = [f"p_open{suffix(m)}" for m in multipliers if m != 1.0]
    crossings = [f"{c}{suffix(m)}" for m in multipliers for c in ("cross_ts", "cross_price")]
    return out.drop("first_ts", "first_price", *crossings, *extra)


def blocks_waited(opened: DataFrame, blocks: DataFrame, bounded: bool = False) -> DataFrame:
    """Adds k_blocks (blocks in (t_open, t_block]) and tau_lo_ms (previous block's time minus t_open).

    ``blocks`` is the complete table (number, milli_ts), so a block's own position is its number. Each opening time is looked up once;
    the arbitrages are written before, as they are read for their times and for the result."""
    table = blocks.select(F.lit(0).alias("_chain"), F.col("number").alias("_open_block"), F.col("milli_ts").alias("_bt"))
    known = F.col("t_open") >= 0
    opened = stored(opened.withColumn("_asked_ms", F.when(known, F.col("t_open")).otherwise(F.col("ts_ms"))), "opened")
    asked = opened.select(F.lit(0).alias("_chain"), "_asked_ms").distinct()
    found = as_of(asked, table, ["_chain"], F.col("_asked_ms"), "_bt", {"_open_block": "_open_block"}, bounded=bounded).drop("_chain")
    placed = looked_up(opened, found, ["_open_block"]).drop("_asked_ms")
    before = blocks.select((F.col("number") + 1).alias("block"), F.col("milli_ts").alias("_before_ms"))
    first = blocks.agg(F.min("number").alias("_first"), F.min("milli_ts").alias("_first_ms"))
    out = placed.join(before, "block", "left").crossJoin(F.broadcast(first))
    opened_at = F.coalesce(F.col("_open_block"), F.col("_first") - 1)
    return (
        out.withColumn("k_blocks", F.when(known, F.col("block") - opened_at).otherwise(F.lit(0)).cast("bigint"))
        .withColumn(
            "tau_lo_ms",
            F.when(known, F.coalesce("_before_ms", "_first_ms") - F.col("t_open")).otherwise(F.lit(-1)).cast("bigint"),
        )
        .drop("_open_block", "_before_ms", "_first", "_first_ms")
    )


def with_opening_sizes(opened: DataFrame) -> DataFrame:
    """Adds overshoot, and for market-triggered openings its split into the crossing jump and the later move."""
    out = opened.withColumn("overshoot_bps", overshoot_bps(F.col("dev_pre"), F.col("fee_rate")))
    jump = F.when(F.col("trigger") == "cex", jump_bps(F.col("p_pre"), F.col("p_open"), F.col("fee_rate")))
    return out.withColumn("jump_bps", jump).withColumn("move_bps", F.col("overshoot_bps") - F.col("jump_bps"))
