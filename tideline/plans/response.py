"""Response times: how fast opportunities were taken, by whom, and what each component contributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tideline.functions import clock
from tideline.functions.pricing import BAND_MULTIPLIERS
from tideline.operators.openings import suffix
from tideline.operators.quantiles import Quantile, summarise
from tideline.operators.ranking import concentration, top_n
from tideline.plans.panel import ratio, when

# The opening types of the tables, and the quantiles reported for response times.
TRIGGERS = ("cex", "continuation", "same_block", "onchain", "long")
TAU_QUANTILES = (0.05, 0.10, 0.25, 0.50, 0.75, 0.90)


def is_trigger(name: str) -> Column:
    return F.col("trigger") == name


def in_window(df: DataFrame, days: float) -> DataFrame:
    """Closed window around the change (hourly panels use the half-open one)."""
    return df.filter(F.abs("days_from_change") <= days)


def market_triggered(max_tau_ms: int) -> Column:
    return is_trigger("cex") & (F.col("tau_ms") >= 0) & (F.col("tau_ms") <= max_tau_ms)


def mean_when(test: Column, value: str | Column) -> Column:
    return F.avg(when(test, value))


def share(test: Column, of: Column | None = None) -> Column:
    flag = F.when(test, 1.0).otherwise(0.0)
    return F.avg(flag if of is None else F.when(of, flag))


def response_stats(arbs: DataFrame, by: list[str], dt_ms: Column, max_tau_ms: int, bounded: bool = False) -> DataFrame:
    """One row per group: counts, trigger shares and overshoots, response-time quantiles and intercepts, block waits,
    the jump/move split, wider bands, sharp openings and the on-chain distribution of blocks waited.

    ``dt_ms`` is the block interval of the row's regime. Blocks of statistics need 30 observations, else NULL."""
    cex, onchain = market_triggered(max_tau_ms), is_trigger("onchain") & (F.col("tau_ms") <= max_tau_ms)
    sharp = cex & (F.col("jump_bps") >= 0.5 * F.col("fee_rate") * 1e4)
    tau = F.col("tau_ms").cast("double")
    df = arbs.withColumn("_dt", dt_ms)
    aggs = [
        F.count(F.lit(1)).alias("n_arb"),
        F.count_if("is_arb_strict").alias("n_arb_strict"),
        F.max("_dt").cast("double").alias("dt_ms"),
        *[share(is_trigger(t)).alias(f"share_{t}") for t in TRIGGERS],
        *[mean_when(is_trigger(t), "overshoot_bps").alias(f"overshoot_{t}") for t in TRIGGERS],
        F.count_if(cex).alias("n_cex"),
        F.try_divide(F.count_if(cex), F.count_if(is_trigger("cex"))).alias("share_cex_tau_le_max"),
        mean_when(cex, tau).alias("tau_mean"),
        share(tau < 100, cex).alias("tau_share_lt_100ms"),
        share(tau < F.col("_dt"), cex).alias("tau_share_lt_dt"),
        mean_when(cex, F.sqrt(tau / 1000.0)).alias("mean_sqrt_s"),
        *[share(F.col("k_blocks") == k, cex).alias(f"p_k{k}") for k in (1, 2)],
        share(F.col("k_blocks") >= 3, cex).alias("p_k3plus"),
        mean_when(cex, "k_blocks").alias("mean_k"),
        mean_when(cex, "overshoot_bps").alias("cex_overshoot"),
        mean_when(cex, "jump_bps").alias("cex_jump"),
        mean_when(cex, "move_bps").alias("cex_move"),
        share(F.col("jump_bps") > 0.5 * F.col("overshoot_bps"), cex).alias("share_jump_gt_half"),
        F.count_if(onchain).alias("n_onchain"),
        *[share(F.col("k_blocks") <= k, onchain).alias(f"onchain_cdf_{k}") for k in (1, 2, 3, 4)],
        mean_when(onchain, "k_blocks").alias("onchain_mean_k"),
        mean_when(onchain, F.sqrt(tau / 1000.0)).alias("onchain_mean_sqrt_s"),
        F.count_if(sharp).alias("n_sharp"),
        mean_when(sharp, tau).alias("sharp_tau_mean"),
        share(F.col("k_blocks") == 1, sharp).alias("sharp_p_k1"),
    ]
    wanted = [Quantile(f"tau_p{int(q * 100)}", when(cex, tau), q) for q in TAU_QUANTILES]
    wanted += [
        Quantile("cex_overshoot_median", when(cex, "overshoot_bps"), 0.5),
        Quantile("cex_jump_median", when(cex, "jump_bps"), 0.5),
        Quantile("onchain_tau_p50", when(onchain, tau), 0.5),
        Quantile("sharp_tau_p10", when(sharp, tau), 0.1),
        Quantile("sharp_tau_p50", when(sharp, tau), 0.5),
    ]
    for m in BAND_MULTIPLIERS[1:]:
        s = suffix(m)
        wide = (F.col(f"trigger{s}") == "cex") & (F.col(f"tau_ms{s}") <= max_tau_ms)
        aggs += [F.count_if(wide).alias(f"n_band{s}"), mean_when(wide, f"tau_ms{s}").alias(f"tau_mean{s}")]
        wanted += [Quantile(f"tau_p{int(q * 100)}{s}", when(wide, f"tau_ms{s}"), q) for q in (0.1, 0.5)]
    t = summarise(df, by, aggs, wanted, bounded)
    enough = {"tau_": "n_cex", "mean_sqrt_s": "n_cex", "p_k": "n_cex", "mean_k": "n_cex", "cex_": "n_cex", "share_jump": "n_cex",
              "onchain_": "n_onchain", "sharp_": "n_sharp"}
    for m in BAND_MULTIPLIERS[1:]:
        enough[f"band{suffix(m)}"] = f"n_band{suffix(m)}"
    out = []
    for name in t.columns:
        gate = next((f"n_band{suffix(m)}" for m in BAND_MULTIPLIERS[1:] if name.endswith(suffix(m)) and not name.startswith("n_")), None)
        gate = gate or next((n for prefix, n in enough.items() if name.startswith(prefix)), None)
        out.append(F.col(name) if gate is None or name in by else F.when(F.col(gate) >= 30, F.col(name)).alias(name))
    t = t.select(*out)
    for q in (0.10, 0.25, 0.50):
        t = t.withColumn(f"ell_q{int(q * 100)}", F.col(f"tau_p{int(q * 100)}") - q * F.col("dt_ms"))
    return t


def quantile_intercepts(arbs: DataFrame, by: list[str], dt_ms: Column, max_tau_ms: int, qs=(0.1, 0.25, 0.5), bounded=False) -> DataFrame:
    """Latency intercepts: quantile of the response time minus the same share of the block interval."""
    kept = arbs.filter(market_triggered(max_tau_ms)).withColumn("_dt", dt_ms)
    t = summarise(
        kept, by, [F.count(F.lit(1)).alias("n"), F.max("_dt").cast("double").alias("dt_ms"), share(F.col("k_blocks") == 1).alias("p_first")],
        [Quantile(f"_q{int(q * 100)}", F.col("tau_ms"), q) for q in qs], bounded,
    )
    return t.select(*by, "n", "dt_ms", "p_first", *[(F.col(f"_q{int(q * 100)}") - q * F.col("dt_ms")).alias(f"ell_q{int(q * 100)}") for q in qs])


def component_panel(arbs: DataFrame, max_tau_ms: int = 60_000, bounded: bool = False) -> DataFrame:
    """Hourly components of the overshoot per pool: counts, means and shares per trigger, jump and move, response times."""
    cex = is_trigger("cex")
    quick = cex & (F.col("tau_ms") <= max_tau_ms)
    kinds = [t for t in TRIGGERS if t != "long"]
    aggs = [
        F.count(F.lit(1)).alias("n"), F.avg("overshoot_bps").alias("overshoot_all"),
        F.sum("arb_loss").alias("arb_loss_sum"), F.sum("volume_q").alias("arb_volume"),
    ]
    for t in kinds:
        aggs += [mean_when(is_trigger(t), "overshoot_bps").alias(t), F.count_if(is_trigger(t)).alias(f"{t}_n"), share(is_trigger(t)).alias(f"share_{t}")]
    aggs += [
        mean_when(cex, "jump_bps").alias("cex_jump"), mean_when(cex, "move_bps").alias("cex_move"),
        mean_when(quick, "tau_ms").alias("cex_tau_mean_ms"), mean_when(quick, F.sqrt(F.col("tau_ms") / 1000.0)).alias("cex_sqrt_tau_mean"),
        share(F.col("k_blocks") == 1, quick).alias("cex_p_k1"),
    ]
    hourly = arbs.withColumn("hour_ms", clock.floor_ms(F.col("ts_ms"), clock.HOUR_MS))
    return summarise(hourly, ["pool", "hour_ms"], aggs, [Quantile("cex_tau_median_ms", when(quick, "tau_ms"), 0.5)], bounded)


def component_weights(arbs: DataFrame, days: float) -> DataFrame:
    """Share of each component in the mean overshoot before the change, per pool (long rows)."""
    pre = in_window(arbs.filter("regime = 'pre'"), days)
    parts = {"cex_jump": when(is_trigger("cex"), "jump_bps"), "cex_move": when(is_trigger("cex"), "move_bps")}
    parts |= {t: when(is_trigger(t), "overshoot_bps") for t in TRIGGERS if t not in ("cex", "long")}
    t = pre.groupBy("pool").agg(
        F.count(F.lit(1)).alias("n"), F.avg("overshoot_bps").alias("mean_overshoot"), F.sum("overshoot_bps").alias("_total"),
        *[F.coalesce(F.sum(v), F.lit(0.0)).alias(f"_{k}") for k, v in parts.items()],
    )
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("component"), F.try_divide(F.col(f"_{k}"), F.col("_total")).alias("weight")) for k in parts]))
    return t.select("pool", "n", "mean_overshoot", rows.alias("_r")).select("pool", "n", "mean_overshoot", "_r.*")


def overshoot_components(arbs: DataFrame, by: list[str], scale: Column) -> DataFrame:
    """Shares and mean scaled overshoot per component (``scale`` divides, e.g. volatility in bps)."""
    d = arbs.withColumn("_s", scale).filter(F.col("_s") > 0)
    value = lambda c: F.col(c) / F.col("_s")
    return d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value("overshoot_bps")).alias("total"),
        mean_when(is_trigger("cex"), value("jump_bps")).alias("jump"), mean_when(is_trigger("cex"), value("move_bps")).alias("move"),
        *[share(is_trigger(t)).alias(f"share_{t}") for t in TRIGGERS],
        *[mean_when(is_trigger(t), value("overshoot_bps")).alias(f"mean_{t}") for t in TRIGGERS],
    )


def overshoot_decomposition(components: DataFrame, effects: DataFrame) -> DataFrame:
    """Change of the scaled overshoot split into contributions, next to totals in which only the waiting part changes.

    ``effects``: pool, implied (log change of the mean root response time), law (half log change of the interval)."""
    fields = [c for c in components.columns if c not in ("pool", "regime")]
    pack = F.struct(*fields)
    wide = components.groupBy("pool").agg(
        F.max(F.when(F.col("regime") == "pre", pack)).alias("a"), F.max(F.when(F.col("regime") == "post", pack)).alias("b")
    ).join(effects, "pool").filter("a IS NOT NULL AND b IS NOT NULL")
    part = lambda side, t: F.coalesce(F.col(f"{side}.share_{t}") * F.col(f"{side}.mean_{t}"), F.lit(0.0))
    split = lambda side, c: F.coalesce(F.col(f"{side}.share_cex") * F.col(f"{side}.{c}"), F.lit(0.0))
    middle = 0.5 * (F.col("a.total") + F.col("b.total"))
    shrink = lambda change, base: F.when(F.col("a.total") - base * (1 - F.exp(change)) > 0, F.ln((F.col("a.total") - base * (1 - F.exp(change))) / F.col("a.total")))
    waiting = split("a", "move")
    return wide.select(
        "pool", F.ln(F.col("b.total") / F.col("a.total")).alias("actual"),
        shrink(F.col("implied"), waiting).alias("counterfactual_tau"),
        shrink(F.col("law"), waiting).alias("counterfactual_law"),
        shrink(F.col("implied"), waiting + part("a", "continuation")).alias("counterfactual_tau_all"),
        *[((split("b", c) - split("a", c)) / middle).alias(f"contrib_cex_{c}") for c in ("jump", "move")],
        *[((part("b", t) - part("a", t)) / middle).alias(f"contrib_{t}") for t in TRIGGERS if t not in ("cex", "long")],
    )


def implied_effects(stats: DataFrame, by: list[str]) -> DataFrame:
    """From response statistics of both regimes: the root law, the implied effect, and the equivalent fixed latency."""
    pick = lambda regime, c: F.max(F.when(F.col("regime") == regime, F.col(c)))
    cols = ("dt_ms", "mean_sqrt_s", "tau_p10", "tau_p50", "p_k1", "cex_overshoot", "cex_jump", "cex_move")
    w = stats.groupBy(*by).agg(*[pick(reg, c).alias(f"{c}_{reg}") for c in cols for reg in ("pre", "post")])
    implied = F.ln(F.try_divide(F.col("mean_sqrt_s_post"), F.col("mean_sqrt_s_pre")))
    squared = F.exp(2 * implied)
    latency = F.try_divide(F.col("dt_ms_post") - squared * F.col("dt_ms_pre"), squared - 1) / 1000
    change = lambda c: F.when((F.col(f"{c}_pre") > 0) & (F.col(f"{c}_post") > 0), F.ln(F.col(f"{c}_post") / F.col(f"{c}_pre")))
    return w.select(
        *by, (0.5 * F.ln(F.col("dt_ms_post") / F.col("dt_ms_pre"))).alias("law"), implied.alias("implied"),
        F.greatest(latency, F.lit(0.0)).alias("equivalent_latency_s"),
        (F.col("tau_p50_post") - F.col("tau_p50_pre")).alias("d_median_tau_ms"), (0.5 * (F.col("dt_ms_post") - F.col("dt_ms_pre"))).alias("mechanical_d_median_ms"),
        (F.col("tau_p10_post") - F.col("tau_p10_pre")).alias("d_p10_tau_ms"), (0.1 * (F.col("dt_ms_post") - F.col("dt_ms_pre"))).alias("mechanical_d_p10_ms"),
        F.col("p_k1_post").alias("p_k1_post_actual"),
        change("cex_overshoot").alias("d_log_overshoot"), change("cex_move").alias("d_log_move"), change("cex_jump").alias("d_log_jump"),
    )


def competition_panel(arbs: DataFrame, max_tau_ms: int, bounded: bool = False) -> DataFrame:
    """Hourly competition per pool: response-time quantiles, first-block share, active senders, largest sender's share."""
    hourly = arbs.withColumn("hour_ms", clock.floor_ms(F.col("ts_ms"), clock.HOUR_MS))
    cex = market_triggered(max_tau_ms)
    keys = ["pool", "hour_ms"]
    speed = summarise(
        hourly.filter(cex), keys,
        [
            F.count(F.lit(1)).alias("n_cex"), F.avg(F.sqrt(F.col("tau_ms") / 1000.0)).alias("sqrt_tau"), share(F.col("k_blocks") == 1).alias("first_block"),
            F.avg("jump_bps").alias("jump"), F.avg("move_bps").alias("move"), F.avg("overshoot_bps").alias("overshoot_cex"),
        ],
        [Quantile("tau_p10", F.col("tau_ms"), 0.1), Quantile("tau_med", F.col("tau_ms"), 0.5)], bounded,
    )
    # One row per sender and hour first; the largest sender is then a maximum, not a set.
    senders = hourly.groupBy(*keys, "sender").agg(F.count(F.lit(1)).alias("_n")).groupBy(*keys).agg(
        F.sum("_n").alias("n_arbs"), F.count(F.lit(1)).alias("n_senders"), (F.max("_n") / F.sum("_n")).alias("top1_share")
    )
    return speed.join(senders, keys)


def sender_counts(arbs: DataFrame, by: list[str]) -> DataFrame:
    return arbs.groupBy(*by, "sender").agg(F.count(F.lit(1)).alias("n"), F.sum("volume_q").alias("volume"))


def sender_concentration(arbs: DataFrame, by: list[str], active: int = 20) -> DataFrame:
    return concentration(sender_counts(arbs, by), by, "n", "volume", active)


def active_bots(arbs: DataFrame, swaps_by_sender: DataFrame, by: list[str], min_arbs: int) -> DataFrame:
    """Senders with enough arbitrages, those whose swaps are mostly arbitrages, and the latter's share."""
    counts = sender_counts(arbs, by).join(swaps_by_sender.select(*by, "sender", F.col("n").alias("own")), [*by, "sender"], "left")
    big = F.col("n") >= min_arbs
    bot = big & (F.col("n") / F.greatest(F.coalesce("own", "n"), F.lit(1)) >= 0.5)
    return counts.groupBy(*by).agg(
        F.count_if(big).alias("n_active"), F.count_if(bot).alias("n_bots"),
        (F.sum(F.when(bot, F.col("n")).otherwise(0)) / F.sum("n")).alias("bots_share_of_arbs"),
    )


def top_senders(arbs: DataFrame, swaps_by_sender: DataFrame, by: list[str], max_tau_ms: int, n: int = 15, min_obs: int = 20, bounded=False) -> DataFrame:
    """The ``n`` senders with most arbitrages per group and their statistics; ties go to the smaller sender id."""
    counts = arbs.groupBy(*by, "sender").agg(F.count(F.lit(1)).alias("n_arb"))
    totals = counts.groupBy(*by).agg(F.sum("n_arb").alias("_all"))
    leaders = top_n(counts, by, [F.col("n_arb").desc(), F.col("sender")], n).join(totals, by)
    cex = market_triggered(max_tau_ms)
    detail = summarise(
        arbs.join(leaders.select(*by, "sender"), [*by, "sender"], "left_semi"), [*by, "sender"],
        [
            F.count_if(cex).alias("n_cex"), share(F.col("k_blocks") == 1, cex).alias("_k1"), F.avg("overshoot_bps").alias("overshoot_bps"),
            F.sum("arb_loss").alias("arb_loss_sum"), F.sum("volume_q").alias("volume"), share(is_trigger("same_block")).alias("share_same_block"),
        ],
        [Quantile("_p10", when(cex, "tau_ms"), 0.1), Quantile("_p50", when(cex, "tau_ms"), 0.5)], bounded,
    )
    own = swaps_by_sender.select(*by, "sender", F.col("n").alias("_own"))
    j = leaders.join(detail, [*by, "sender"]).join(own, [*by, "sender"], "left")
    shown = lambda c, name: F.when(F.col("n_cex") >= min_obs, F.col(c)).alias(name)
    return j.select(
        *by, "rank", "sender", "n_arb", (F.col("n_arb") / F.col("_all")).alias("share"),
        (F.col("n_arb") / F.greatest(F.coalesce("_own", "n_arb"), F.lit(1))).alias("arb_share_of_own_swaps"),
        "n_cex", shown("_p10", "tau_p10_ms"), shown("_p50", "tau_p50_ms"), shown("_k1", "p_k1"),
        "overshoot_bps", "arb_loss_sum", "volume", "share_same_block",
    )


def paired_groups(arbs: DataFrame, member: str, by: list[str], dt_pre: float, dt_post: float, min_pair: int, max_tau_ms: int, bounded=False) -> DataFrame:
    """Members with at least ``min_pair`` market-triggered arbitrages in both regimes: quantiles before and after,
    their change, the mechanical change, latency intercepts and first-block shares."""
    c = arbs.filter(market_triggered(max_tau_ms))
    t = summarise(
        c, [*by, member, "regime"], [F.count(F.lit(1)).alias("n"), share(F.col("k_blocks") == 1).alias("k1")],
        [Quantile("p10", F.col("tau_ms"), 0.1), Quantile("p50", F.col("tau_ms"), 0.5)], bounded,
    ).filter(F.col("n") >= min_pair)
    keys = [*by, member]
    side = lambda regime, s: t.filter(F.col("regime") == regime).select(*keys, *[F.col(x).alias(f"{x}_{s}") for x in ("n", "k1", "p10", "p50")])
    j = side("pre", "pre").join(side("post", "post"), keys)
    return j.select(
        *keys, "n_pre", "n_post", "p10_pre", "p10_post", "p50_pre", "p50_post",
        (F.col("p10_post") - F.col("p10_pre")).alias("d_p10_ms"), (F.col("p50_post") - F.col("p50_pre")).alias("d_p50_ms"),
        F.lit(0.1 * (dt_post - dt_pre)).alias("mechanical_d_p10_ms"), F.lit(0.5 * (dt_post - dt_pre)).alias("mechanical_d_p50_ms"),
        (F.col("p10_pre") - 0.1 * dt_pre).alias("ell_q10_pre"), (F.col("p10_post") - 0.1 * dt_post).alias("ell_q10_post"),
        (F.col("p50_pre") - 0.5 * dt_pre).alias("ell_q50_pre"), (F.col("p50_post") - 0.5 * dt_post).alias("ell_q50_post"),
        F.col("k1_pre").alias("p_k1_pre"), F.col("k1_post").alias("p_k1_post"),
    )


def paired_summary(paired: DataFrame, by: list[str], margin_ms: float = 20.0, bounded=False) -> DataFrame:
    lower = F.col("ell_q10_post") < F.col("ell_q10_pre") - margin_ms
    return summarise(
        paired, by, [F.count(F.lit(1)).alias("n_paired"), share(lower).alias("share_lower_q10")],
        [Quantile("median_d_ell_q10", F.col("ell_q10_post") - F.col("ell_q10_pre"), 0.5), Quantile("median_d_ell_q50", F.col("ell_q50_post") - F.col("ell_q50_pre"), 0.5)], bounded,
    )


def entry_exit(arbs: DataFrame, member: str, by: list[str], min_arbs: int) -> DataFrame:
    """Members active in both regimes, only after, only before; entrants' share of activity after the change."""
    n = arbs.groupBy(*by, member).agg(F.count_if(F.col("regime") == "pre").alias("a"), F.count_if(F.col("regime") == "post").alias("b"))
    was, now = F.col("a") >= min_arbs, F.col("b") >= min_arbs
    return n.groupBy(*by).agg(
        F.count_if(was & now).alias("stayers"), F.count_if(~was & now).alias("entrants"), F.count_if(was & ~now).alias("exits"),
        F.try_divide(F.sum(F.when(~was & now, F.col("b")).otherwise(0)), F.sum("b")).alias("entrants_share"),
    )


def tau_histogram(arbs: DataFrame, max_tau_ms: int, low_ms: float = 20.0, edges: int = 60) -> DataFrame:
    """Counts in log-spaced bins of the response time (values below ``low_ms`` go into the first bin), per regime."""
    import math

    tau = F.greatest(F.col("tau_ms").cast("double"), F.lit(low_ms))
    top = math.log(float(max_tau_ms))
    bin_number = F.least(F.width_bucket(F.ln(tau), F.lit(math.log(low_ms)), F.lit(top), F.lit(edges - 1)), F.lit(edges - 1))
    return arbs.filter(market_triggered(max_tau_ms)).groupBy("regime", bin_number.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def block_wait_distribution(arbs: DataFrame, max_tau_ms: int, pooled_from: int = 7) -> DataFrame:
    k = F.least(F.col("k_blocks"), F.lit(pooled_from)).cast("int")
    return arbs.filter(market_triggered(max_tau_ms)).groupBy("regime", k.alias("k")).agg(F.count(F.lit(1)).alias("n"))


def value_bins(df: DataFrame, by: list[str], value: str, edges: tuple[float, ...], aggs: list[Column]) -> DataFrame:
    """Statistics by fixed left-closed bins of a column; the last bin is open-ended."""
    number = None
    for i, lo in enumerate(edges):
        hi = edges[i + 1] if i + 1 < len(edges) else None
        test = F.col(value) >= lo if hi is None else (F.col(value) >= lo) & (F.col(value) < hi)
        number = F.when(test, i) if number is None else number.when(test, i)
    return df.withColumn("bin", number).filter("bin IS NOT NULL").groupBy(*by, "bin").agg(*aggs)
