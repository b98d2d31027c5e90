"""Prices, flows and per-trade metrics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value of the pool encoding: square-root prices carry 96 fractional bits.
SQRT_PRICE_SCALE = float(2**96)
FEE_UNITS = 1e6
BPS = 1e4
BAND_MULTIPLIERS = (1.0, 1.5, 2.0)


def number_from_text(text: Column) -> Column:
    """Decimal text of up to 78 digits as DOUBLE (about 16 significant digits survive)."""
    return text.cast("double")


def pool_price(sqrt_price_x96: Column, dec0: Column, dec1: Column, base_is_token0: Column) -> Column:
    """Quote per base from the square-root price of token1 per token0."""
    token1_per_token0 = F.pow(sqrt_price_x96 / F.lit(SQRT_PRICE_SCALE), F.lit(2.0)) * F.pow(F.lit(10.0), dec0 - dec1)
    return F.when(base_is_token0, token1_per_token0).otherwise(F.try_divide(F.lit(1.0), token1_per_token0))


def oriented(amount0: Column, amount1: Column, dec0: Column, dec1: Column, base_is_token0: Column) -> tuple[Column, Column]:
    """(base, quote) received by the pool, negative when paid out, in whole tokens."""
    a0, a1 = amount0 / F.pow(F.lit(10.0), dec0), amount1 / F.pow(F.lit(10.0), dec1)
    return F.when(base_is_token0, a0).otherwise(a1), F.when(base_is_token0, a1).otherwise(a0)


def fee_rate(fee: Column) -> Column:
    return fee / F.lit(FEE_UNITS)


def deviation(price: Column, reference: Column) -> Column:
    return F.try_divide(price, reference) - F.lit(1.0)


def with_trade_metrics(df):
    """Adds deviations, the arbitrage flags, volume, fees, gains, losses and mark-outs to aligned swaps.

    Needs p_pre, p_post, p_cex, dB, dQ, fee_rate; mark-outs need p_cex_h5 and p_cex_h30."""
    out = df.withColumn("dev_pre", deviation(F.col("p_pre"), F.col("p_cex"))).withColumn(
        "dev_post", deviation(F.col("p_post"), F.col("p_cex"))
    )
    closer = F.abs("dev_post") < F.abs("dev_pre")
    toward = (F.signum(F.col("dev_post") - F.col("dev_pre")) == -F.signum("dev_pre")) & closer
    out = out.withColumn("is_arb", (F.abs("dev_pre") > F.col("fee_rate")) & toward)
    out = out.withColumn("is_arb_strict", F.col("is_arb") & (F.abs("dev_post") <= F.col("fee_rate")))
    bought = F.when(F.col("dB") > 0, F.col("dB") * F.col("p_cex")).otherwise(F.greatest(F.col("dQ"), F.lit(0.0)))
    out = out.withColumn("volume_q", bought)
    out = out.withColumn("fee_income", F.col("fee_rate") * F.col("volume_q"))
    out = out.withColumn("lp_gain", F.col("dQ") + F.col("dB") * F.col("p_cex"))
    out = out.withColumn("arb_loss", F.col("fee_income") - F.col("lp_gain"))
    for horizon in ("5", "30"):
        if f"p_cex_h{horizon}" in df.columns:
            out = out.withColumn(f"markout_{horizon}s", F.col("dQ") + F.col("dB") * F.col(f"p_cex_h{horizon}"))
    return out


def band_low(price: Column, width: Column) -> Column:
    return price / (F.lit(1.0) + width)


def band_high(price: Column, width: Column) -> Column:
    return price / (F.lit(1.0) - width)


def overshoot_bps(dev: Column, fee: Column) -> Column:
    return (F.abs(dev) - fee) * F.lit(BPS)


def jump_bps(p_pre: Column, p_open: Column, fee: Column) -> Column:
    """How far beyond the band edge the crossing tick already was (never below zero)."""
    return F.greatest((F.abs(F.try_divide(p_pre, p_open) - F.lit(1.0)) - fee) * F.lit(BPS), F.lit(0.0))
