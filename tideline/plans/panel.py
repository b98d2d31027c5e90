"""Hourly panels and the tables computed straight from swaps or panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tideline.functions import clock
from tideline.operators.asof import time_grid
from tideline.operators.episodes import log_returns
from tideline.operators.ordered import carry_forward
from tideline.operators.quantiles import Quantile, summarise

BPS = 1e4


def when(condition: str | Column, value: str | Column) -> Column:
    test = F.expr(condition) if isinstance(condition, str) else condition
    return F.when(test, F.col(value) if isinstance(value, str) else value)


def total(condition: str | Column, value: str | Column) -> Column:
    return F.coalesce(F.sum(when(condition, value)), F.lit(0.0))


def ratio(a, b) -> Column:
    return F.try_divide(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b)


def minute_prices(swaps: DataFrame, bounded: bool = False) -> DataFrame:
    """Last reference price of each minute per pool, carried over empty minutes."""
    minute = clock.floor_ms(F.col("ts_ms"), clock.MINUTE_MS)
    last = swaps.groupBy("pool", minute.alias("minute_ms")).agg(F.max_by("p_cex", F.struct("block", "log_index")).alias("_p"))
    spans = last.groupBy("pool").agg(F.min("minute_ms").alias("_s"), F.max("minute_ms").alias("_e"))
    grid = time_grid(spans, ["pool"], "_s", "_e", clock.MINUTE_MS, "minute_ms")
    joined = grid.join(last, ["pool", "minute_ms"], "left")
    return carry_forward(joined, ["pool"], ["minute_ms"], {"p_cex": "_p"}, width=clock.DAY_MS, bounded=bounded).drop("_p")


def realised_vol(swaps: DataFrame, bounded: bool = False) -> DataFrame:
    """(pool, hour_ms, rv, sigma_ps): squared one-minute log returns per hour, volatility per root second."""
    returns = log_returns(minute_prices(swaps, bounded), ["pool"], ["minute_ms"], "p_cex", width=clock.DAY_MS, bounded=bounded)
    hour = clock.floor_ms(F.col("minute_ms"), clock.HOUR_MS)
    rv = returns.filter("log_return IS NOT NULL").groupBy("pool", hour.alias("hour_ms")).agg(
        F.sum(F.col("log_return") * F.col("log_return")).alias("rv")
    )
    return rv.withColumn("sigma_ps", F.sqrt(F.col("rv") / 3600.0))


def hourly_panel(swaps: DataFrame, change_ms: int, dt_pre: float, dt_post: float, bounded: bool = False) -> DataFrame:
    """One row per pool and hour, hours without swaps included (zero sums, NULL means)."""
    hour = clock.floor_ms(F.col("ts_ms"), clock.HOUR_MS)
    gap = F.abs(ratio("p_cex_1s", "p_cex") - 1.0)
    above = (F.abs("dev_pre") - F.col("fee_rate")) * BPS
    sums = summarise(
        swaps.withColumn("hour_ms", hour),
        ["pool", "hour_ms"],
        [
            F.count(F.lit(1)).alias("swaps"),
            F.sum("volume_q").alias("volume"),
            F.sum("fee_income").alias("fee_income"),
            F.sum("lp_gain").alias("lp_gain"),
            F.sum("arb_loss").alias("arb_loss"),
            F.sum("markout_30s").alias("markout_30s"),
            F.count_if("is_arb").alias("n_arb"),
            F.count_if("is_arb_strict").alias("n_arb_strict"),
            total("is_arb", "volume_q").alias("arb_volume"),
            total("is_arb", "arb_loss").alias("arb_loss_arbs"),
            total("is_arb", F.col("arb_loss") - F.col("fee_income")).alias("arb_profit"),
            F.avg(when("is_arb", above)).alias("overshoot_bps"),
            F.avg(when("is_arb_strict", above)).alias("overshoot_strict_bps"),
            F.avg(F.abs("dev_pre")).alias("mean_abs_dev_pre"),
            F.avg(F.when(F.abs("dev_pre") > F.col("fee_rate"), 1.0).otherwise(0.0)).alias("share_swaps_outside"),
            F.avg("liquidity").alias("liq_mean"),
            (F.sum(gap) / F.count(F.lit(1)) * BPS).alias("ref_gap_bps"),
            F.max("fee_rate").alias("_fee"),
        ],
        [Quantile("median_arb_size", when("is_arb", "volume_q"), 0.5)],
        bounded,
    )
    # Spine and fees come from the aggregate, so the swaps are read once for both.
    spans = sums.groupBy("pool").agg(F.min("hour_ms").alias("_s"), F.max("hour_ms").alias("_e"), F.max("_fee").alias("fee"))
    grid = time_grid(spans.select("pool", "_s", "_e"), ["pool"], "_s", "_e", clock.HOUR_MS, "hour_ms")
    zero = ["swaps", "n_arb", "n_arb_strict", "volume", "fee_income", "lp_gain", "arb_loss", "markout_30s", "arb_volume", "arb_loss_arbs", "arb_profit"]
    out = (
        grid.join(sums.drop("_fee"), ["pool", "hour_ms"], "left")
        .na.fill(0, subset=zero)
        .join(realised_vol(swaps, bounded), ["pool", "hour_ms"], "left")
        .join(spans.select("pool", "fee"), "pool")
    )
    post = F.when(F.col("hour_ms") >= change_ms, 1).otherwise(0)
    return out.select(
        "*",
        post.alias("post"),
        clock.hour_of_day(F.col("hour_ms")).alias("hod"),
        clock.day_of_week(F.col("hour_ms")).alias("dow"),
        clock.utc_date(F.col("hour_ms")).alias("day"),
        (ratio("arb_loss", F.nullif("volume", F.lit(0.0))) * BPS).alias("arb_loss_bps"),
        (ratio("lp_gain", F.nullif("volume", F.lit(0.0))) * BPS).alias("lp_net_bps"),
        ratio("arb_loss_arbs", "n_arb").alias("loss_per_arb"),
        F.when(F.col("hour_ms") >= change_ms, F.lit(float(dt_post))).otherwise(F.lit(float(dt_pre))).alias("dt"),
        clock.days_since(F.col("hour_ms"), change_ms).alias("t_days"),
    )


def daily_table(swaps: DataFrame) -> DataFrame:
    day = clock.floor_ms(F.col("ts_ms"), clock.DAY_MS)
    d = swaps.groupBy("pool", day.alias("ts_ms")).agg(
        F.count(F.lit(1)).alias("swaps"),
        F.sum("volume_q").alias("volume_quote"),
        F.avg(F.col("is_arb").cast("double")).alias("arb_share"),
        F.sum("fee_income").alias("fee_income"),
        F.sum("arb_loss").alias("arb_loss"),
        F.sum("lp_gain").alias("lp_gain"),
    )
    return d.select(
        "*", (ratio("arb_loss", "volume_quote") * BPS).alias("arb_loss_bps"), (ratio("fee_income", "volume_quote") * BPS).alias("fee_bps")
    )


def hour_of_day_table(swaps: DataFrame, change_block: int) -> DataFrame:
    """Hour-of-day sums with the regimes side by side."""
    tagged = swaps.select(
        "pool", clock.hour_of_day(F.col("ts_ms")).alias("hod"),
        F.when(F.col("block") < change_block, "pre").otherwise("post").alias("regime"),
        "volume_q", "is_arb", "arb_loss", "fee_income",
    )
    wide = tagged.groupBy("pool", "hod").pivot("regime", ["pre", "post"]).agg(
        F.count(F.lit(1)).alias("swaps"),
        F.sum("volume_q").alias("volume_quote"),
        F.avg(F.col("is_arb").cast("double")).alias("arb_share"),
        F.sum("arb_loss").alias("arb_loss"),
        F.sum("fee_income").alias("fee_income"),
    )
    for regime in ("pre", "post"):
        wide = wide.withColumn(f"{regime}_arb_loss_bps", ratio(f"{regime}_arb_loss", f"{regime}_volume_quote") * BPS)
    return wide


def panel_regime_table(panel: DataFrame) -> DataFrame:
    """Panel statistics per pool and regime (one row each), means weighted by the counts behind them."""

    def weighted(value: str, weight: str) -> Column:
        return F.try_divide(F.sum(F.coalesce(value, F.lit(0.0)) * F.col(weight)), F.sum(weight))

    t = summarise(
        panel,
        ["pool", "post"],
        [
            F.count(F.lit(1)).alias("hours"),
            F.sum("swaps").alias("swaps"),
            F.sum("volume").alias("_volume"),
            F.sum("n_arb").alias("_arbs"),
            F.sum("arb_loss").alias("_loss"),
            F.sum("fee_income").alias("_fees"),
            F.sum("lp_gain").alias("_gain"),
            F.sum("arb_profit").alias("_profit"),
            weighted("overshoot_bps", "n_arb").alias("overshoot_bps"),
            weighted("overshoot_strict_bps", "n_arb_strict").alias("overshoot_strict_bps"),
            weighted("share_swaps_outside", "swaps").alias("share_swaps_outside_band"),
            F.sqrt(F.sum("rv") / (F.count(F.lit(1)) * 3600.0)).alias("_sigma"),
            F.max("dt").alias("_dt"),
            F.max("fee").alias("_fee"),
        ],
        [Quantile("median_arb_size", F.col("median_arb_size"), 0.5)],
    )
    per_hour = lambda c: F.col(c) / F.col("hours")
    return t.select(
        "pool", "post", "hours", "swaps",
        per_hour("_volume").alias("volume_per_hour"),
        per_hour("_arbs").alias("arbs_per_hour"),
        "median_arb_size",
        per_hour("_loss").alias("arb_loss_per_hour"),
        (ratio("_loss", "_volume") * BPS).alias("arb_loss_bps"),
        ratio("_loss", "_fees").alias("arb_loss_over_fee"),
        (ratio("_gain", "_volume") * BPS).alias("lp_net_bps"),
        per_hour("_profit").alias("arb_profit_per_hour"),
        "overshoot_bps", "overshoot_strict_bps",
        (F.col("_sigma") * BPS).alias("sigma_ps_bps"),
        (F.col("_sigma") * F.sqrt("_dt") / F.col("_fee")).alias("exposure"),
        "share_swaps_outside_band",
        ratio(per_hour("_profit"), F.pow("_sigma", F.lit(3.0))).alias("arb_profit_rate_over_sigma3"),
        ratio(per_hour("_loss"), F.pow("_sigma", F.lit(2.0))).alias("loss_rate_over_sigma2"),
    )


def regime_ratios(table: DataFrame, by: list[str]) -> DataFrame:
    """Long form of a pre/post table: (by..., statistic, pre, post, post_over_pre)."""
    names = [c for c in table.columns if c not in (*by, "post")]
    long = table.select(*by, "post", *[F.col(c).cast("double").alias(c) for c in names]).unpivot([*by, "post"], names, "statistic", "value")
    wide = long.groupBy(*by, "statistic").agg(
        F.max(F.when(F.col("post") == 0, F.col("value"))).alias("pre"), F.max(F.when(F.col("post") == 1, F.col("value"))).alias("post")
    )
    return wide.withColumn("post_over_pre", ratio("post", F.nullif("pre", F.lit(0.0))))


def lp_levels(panel: DataFrame) -> DataFrame:
    """Liquidity-provider loss over fees at the block time and 30 s later, arbitrage share, regimes side by side."""
    t = panel.groupBy("pool").pivot("post", [0, 1]).agg(
        ratio(F.sum("fee_income") - F.sum("lp_gain"), F.sum("fee_income")).alias("loss_fee_0"),
        ratio(F.sum("fee_income") - F.sum("markout_30s"), F.sum("fee_income")).alias("loss_fee_30"),
        ratio(F.sum("n_arb"), F.sum("swaps")).alias("arb_share"),
    )
    names = {f"{i}_{c}": f"{regime}_{c}" for i, regime in ((0, "pre"), (1, "post")) for c in ("loss_fee_0", "loss_fee_30", "arb_share")}
    return t.select("pool", *[F.col(old).alias(new) for old, new in names.items()])


def pool_pairs(panel: DataFrame, first: str, second: str) -> DataFrame:
    """Two fee tiers of one pair at the same hour: shares and log ratios of volume and liquidity."""
    a = panel.filter(F.col("pool") == first).select("hour_ms", "volume", "liq_mean", "sigma_ps", "post", "hod", "day", "t_days")
    b = panel.filter(F.col("pool") == second).select("hour_ms", F.col("volume").alias("volume_2"), F.col("liq_mean").alias("liq_mean_2"))
    j = a.join(b, "hour_ms").filter("volume > 0 AND volume_2 > 0 AND liq_mean > 0 AND liq_mean_2 > 0 AND sigma_ps > 0")
    return j.select(
        "*",
        (F.col("volume") / (F.col("volume") + F.col("volume_2"))).alias("vshare"),
        (F.col("liq_mean") / (F.col("liq_mean") + F.col("liq_mean_2"))).alias("lshare"),
        F.ln(F.col("volume") / F.col("volume_2")).alias("lv"),
        F.ln(F.col("liq_mean") / F.col("liq_mean_2")).alias("ll"),
    )


def fee_tier_shares(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("post").agg(
        (F.sum("volume") / (F.sum("volume") + F.sum("volume_2"))).alias("volume_share"), F.avg("lshare").alias("liquidity_share")
    )


def daily_normalised(panel: DataFrame, min_hours: int = 20) -> DataFrame:
    d = panel.groupBy("pool", "day").agg(
        F.sum("arb_profit").alias("profit"), F.sum("arb_loss").alias("loss"), F.sum("volume").alias("vol"),
        F.sum("rv").alias("rv"), F.count(F.lit(1)).alias("n"),
    ).filter(F.col("n") >= min_hours)
    daily = F.sqrt(F.col("rv") / 86400.0)
    return d.select("*", ratio("profit", F.pow(daily, F.lit(3.0)) * 1e12).alias("profit_over_sigma3"), (daily * BPS).alias("sigma_bps"))


def sigma_path(panel: DataFrame, windows: tuple[int, ...] = (7, 14, 30)) -> DataFrame:
    """Post/pre ratios of daily means for each window of days around the change, per pool."""
    daily = panel.withColumn("dayrel", F.floor("t_days").cast("int")).groupBy("pool", "dayrel").agg(
        F.avg("sigma_ps").alias("sigma"), F.sum("volume").alias("volume"), F.sum("arb_loss").alias("loss"), F.sum("arb_profit").alias("profit")
    )
    spread = daily.withColumn("window", F.explode(F.array(*[F.lit(w) for w in windows]))).filter(
        (F.col("dayrel") >= -F.col("window")) & (F.col("dayrel") < F.col("window"))
    )
    measures = ("sigma", "volume", "loss", "profit")
    pre = lambda c: F.avg(F.when(F.col("dayrel") < 0, F.col(c)))
    post = lambda c: F.avg(F.when(F.col("dayrel") >= 0, F.col(c)))
    return spread.groupBy("pool", "window").agg(*[F.try_divide(post(c), pre(c)).alias(f"{c}_ratio") for c in measures])


def shifted_pairs(panel: DataFrame, days: int, columns: list[str]) -> DataFrame:
    """Each hour before the change next to the hour a whole number of weeks later (same weekday and hour)."""
    shift = 7 * max(1, round(days / 7)) * clock.DAY_MS
    pre = panel.filter("post = 0").select("pool", "hour_ms", *[F.col(c).alias(f"{c}_pre") for c in columns])
    post = panel.filter("post = 1").select("pool", (F.col("hour_ms") - shift).alias("hour_ms"), *[F.col(c).alias(f"{c}_post") for c in columns])
    return pre.join(post, ["pool", "hour_ms"])


def log_change(column: str) -> Column:
    """ln(post / pre) of a matched hour (NULL unless both > 0)."""
    pre, post = F.col(f"{column}_pre"), F.col(f"{column}_post")
    return F.when((pre > 0) & (post > 0), F.ln(post / pre))


def matched_changes(pairs: DataFrame, columns: list[str], min_pairs: int = 20, net_of: dict[str, tuple[str, str, float]] | None = None) -> DataFrame:
    """Mean log ratio, median ratio and t statistic of matched hours per pool and metric.

    ``net_of`` adds metrics net of a power of another column, {name: (column, other, power)}: ln(column ratio) - power * ln(other ratio),
    over the hours where both are positive on both sides."""
    logs = {c: log_change(c) for c in columns} | {name: log_change(c) - power * log_change(other) for name, (c, other, power) in (net_of or {}).items()}
    metric = F.explode(F.array(*[F.struct(F.lit(name).alias("metric"), v.alias("lr")) for name, v in logs.items()]))
    long = pairs.select("pool", metric.alias("_m")).select("pool", "_m.*").filter("lr IS NOT NULL")
    t = summarise(
        long, ["pool", "metric"],
        [F.count(F.lit(1)).alias("n"), F.avg("lr").alias("mean_log_ratio"), F.stddev_samp("lr").alias("_sd")],
        [Quantile("_median", F.col("lr"), 0.5)],
    ).filter(F.col("n") >= min_pairs)
    return t.select(
        "pool", "metric", "n", F.exp("_median").alias("median_ratio"), "mean_log_ratio",
        F.try_divide(F.col("mean_log_ratio"), F.col("_sd") / F.sqrt("n")).alias("t_stat"),
    )


def reference_wedge(first: DataFrame, second: DataFrame, outcomes: list[str]) -> DataFrame:
    """ln(second) - ln(first) of each outcome for the same pool and hour under two references (NULL unless both > 0)."""
    b = second.select("pool", "hour_ms", *[F.col(c).alias(f"_b_{c}") for c in outcomes])
    logs = [
        F.when((F.col(c) > 0) & (F.col(f"_b_{c}") > 0), F.ln(f"_b_{c}") - F.ln(c)).alias(f"w_{c}") for c in outcomes
    ]
    keep = [c for c in ("post", "hod", "day", "t_days", "sigma_ps", "liq_mean", "volume", "ref_gap_bps") if c in first.columns]
    return first.join(b, ["pool", "hour_ms"]).select("pool", "hour_ms", *keep, *logs)


def reference_gap(swaps: DataFrame) -> DataFrame:
    """Distance of the candle reference from the tick reference per pool and hour."""
    gap = ratio("p_cex_1s", "p_cex") - 1.0
    hour = clock.floor_ms(F.col("ts_ms"), clock.HOUR_MS)
    return swaps.groupBy("pool", hour.alias("hour_ms")).agg(
        (F.avg(F.abs(gap)) * BPS).alias("mean_abs_bps"), (F.sqrt(F.avg(gap * gap)) * BPS).alias("rms_bps")
    )
