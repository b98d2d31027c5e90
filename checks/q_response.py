"""Response-time, component, competition and sender queries on the stand-in market."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import market as m
from checks.market import with_parts
from checks.registry import query
from checks.rounding import rounded, sql_round
from tideline.operators.quantiles import Quantile, summarise
from tideline.operators.ranking import quantile_bins, spearman, top_n
from tideline.plans import response as rs

def interval_ms():
    """Block interval of the row's regime."""
    return F.when(F.col("regime") == "pre", float(m.DT_PRE_MS)).otherwise(float(m.DT_POST_MS))



DT_SQL = f"CASE WHEN regime = 'pre' THEN {m.DT_PRE_MS}.0::DOUBLE ELSE {m.DT_POST_MS}.0::DOUBLE END"
CEX = f"trigger = 'cex' AND tau_ms >= 0 AND tau_ms <= {m.MAX_TAU_MS}"
ONCHAIN = f"trigger = 'onchain' AND tau_ms <= {m.MAX_TAU_MS}"
SHARP = f"{CEX} AND jump_bps >= 0.5 * fee_rate * 10000"
MIN_ARBS, MIN_PAIR = 5, 2
m.PARTS["sa"] = (("ar",), "SELECT * FROM ar WHERE is_arb_strict")


def mean_if(test: str, of: str) -> str:
    return f"avg(CASE WHEN {test} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER ({of})"


def _stats_sql(source: str, by: str) -> str:
    cols = ["count(*) AS n_arb", "count(*) FILTER (is_arb_strict) AS n_arb_strict", f"max({DT_SQL}) AS dt_ms"]
    for t in rs.TRIGGERS:
        cols += [f"{mean_if(f'''trigger = '{t}' ''', 'true')} AS share_{t}", f"avg(overshoot_bps) FILTER (trigger = '{t}') AS overshoot_{t}"]
    gate = lambda n, x: f"CASE WHEN count(*) FILTER ({n}) >= 30 THEN {x} END"
    cols += [f"count(*) FILTER ({CEX}) AS n_cex", f"count(*) FILTER ({CEX}) / nullif(count(*) FILTER (trigger = 'cex'), 0)::DOUBLE AS share_cex_tau_le_max",
             f"count(*) FILTER ({ONCHAIN}) AS n_onchain", f"count(*) FILTER ({SHARP}) AS n_sharp"]
    named = {
        "tau_mean": f"avg(tau_ms) FILTER ({CEX})", "tau_share_lt_100ms": mean_if("tau_ms < 100", CEX), "tau_share_lt_dt": mean_if(f"tau_ms < {DT_SQL}", CEX),
        "mean_sqrt_s": f"avg(sqrt(tau_ms / 1000.0::DOUBLE)) FILTER ({CEX})", "p_k1": mean_if("k_blocks = 1", CEX), "p_k2": mean_if("k_blocks = 2", CEX),
        "p_k3plus": mean_if("k_blocks >= 3", CEX), "mean_k": f"avg(k_blocks) FILTER ({CEX})", "cex_overshoot": f"avg(overshoot_bps) FILTER ({CEX})",
        "cex_jump": f"avg(jump_bps) FILTER ({CEX})", "cex_move": f"avg(move_bps) FILTER ({CEX})", "share_jump_gt_half": mean_if("jump_bps > 0.5 * overshoot_bps", CEX),
        "cex_overshoot_median": f"quantile_cont(overshoot_bps, 0.5) FILTER ({CEX})", "cex_jump_median": f"quantile_cont(jump_bps, 0.5) FILTER ({CEX})",
    }
    for q in rs.TAU_QUANTILES:
        named[f"tau_p{int(q * 100)}"] = f"quantile_cont(tau_ms::DOUBLE, {q}) FILTER ({CEX})"
    for q in (0.10, 0.25, 0.50):
        named[f"ell_q{int(q * 100)}"] = f"quantile_cont(tau_ms::DOUBLE, {q}) FILTER ({CEX}) - {q}::DOUBLE * max({DT_SQL})"
    cols += [f"{gate(CEX, x)} AS {n}" for n, x in named.items()]
    on = {f"onchain_cdf_{k}": mean_if(f"k_blocks <= {k}", ONCHAIN) for k in (1, 2, 3, 4)}
    on |= {"onchain_mean_k": f"avg(k_blocks) FILTER ({ONCHAIN})", "onchain_mean_sqrt_s": f"avg(sqrt(tau_ms / 1000.0::DOUBLE)) FILTER ({ONCHAIN})",
           "onchain_tau_p50": f"quantile_cont(tau_ms::DOUBLE, 0.5) FILTER ({ONCHAIN})"}
    cols += [f"{gate(ONCHAIN, x)} AS {n}" for n, x in on.items()]
    sh = {"sharp_tau_mean": f"avg(tau_ms) FILTER ({SHARP})", "sharp_p_k1": mean_if("k_blocks = 1", SHARP),
          "sharp_tau_p10": f"quantile_cont(tau_ms::DOUBLE, 0.1) FILTER ({SHARP})", "sharp_tau_p50": f"quantile_cont(tau_ms::DOUBLE, 0.5) FILTER ({SHARP})"}
    cols += [f"{gate(SHARP, x)} AS {n}" for n, x in sh.items()]
    for s in ("_m15", "_m20"):
        band = f"trigger{s} = 'cex' AND tau_ms{s} <= {m.MAX_TAU_MS}"
        cols.append(f"count(*) FILTER ({band}) AS n_band{s}")
        cols += [f"{gate(band, x)} AS {n}" for n, x in {f"tau_mean{s}": f"avg(tau_ms{s}) FILTER ({band})", f"tau_p10{s}": f"quantile_cont(tau_ms{s}::DOUBLE, 0.1) FILTER ({band})",
                                                        f"tau_p50{s}": f"quantile_cont(tau_ms{s}::DOUBLE, 0.5) FILTER ({band})"}.items()]
    return f"SELECT {by}, {', '.join(cols)} FROM {source} GROUP BY {by}"


m.PARTS["rs"] = (("ar",), _stats_sql("ar", "pool, regime"))
INTS = {"n_arb", "n_arb_strict", "n_cex", "n_onchain", "n_sharp", "n_band_m15", "n_band_m20"}
STAT_COLS = [
    "dt_ms", *[f"share_{t}" for t in rs.TRIGGERS], *[f"overshoot_{t}" for t in rs.TRIGGERS], "share_cex_tau_le_max", "tau_mean", "tau_share_lt_100ms",
    "tau_share_lt_dt", "mean_sqrt_s", "p_k1", "p_k2", "p_k3plus", "mean_k", "cex_overshoot", "cex_jump", "cex_move", "share_jump_gt_half",
    "cex_overshoot_median", "cex_jump_median", *[f"tau_p{int(q * 100)}" for q in rs.TAU_QUANTILES], "ell_q10", "ell_q25", "ell_q50",
    "onchain_cdf_1", "onchain_cdf_2", "onchain_cdf_3", "onchain_cdf_4", "onchain_mean_k", "onchain_mean_sqrt_s", "onchain_tau_p50",
    "sharp_tau_mean", "sharp_p_k1", "sharp_tau_p10", "sharp_tau_p50", "tau_mean_m15", "tau_p10_m15", "tau_p50_m15", "tau_mean_m20", "tau_p10_m20", "tau_p50_m20",
]
STATS_SQL = with_parts(f"SELECT pool, regime, {', '.join(sorted(INTS))}, {sql_round(' '.join(STAT_COLS))} FROM rs", "rs")


@query("response_stats", STATS_SQL)
def response_stats(spark, sf):
    return rounded(rs.response_stats(m.arbs(spark, sf), ["pool", "regime"], interval_ms(), m.MAX_TAU_MS))


@query("response_stats_sliced", STATS_SQL)
def response_stats_sliced(spark, sf):
    return rounded(rs.response_stats(m.arbs(spark, sf), ["pool", "regime"], interval_ms(), m.MAX_TAU_MS, bounded=False))


@query("implied_effects", with_parts(f"""
    SELECT pool, round(law, 6) AS law, round(implied, 6) AS implied, round(greatest((d1 - exp(2 * implied) * d0) / (exp(2 * implied) - 1) / 1000, 0), 6) AS equivalent_latency_s,
           round(t51 - t50, 6) AS d_median_tau_ms, round(0.5 * (d1 - d0), 6) AS mechanical_d_median_ms, round(t11 - t10, 6) AS d_p10_tau_ms,
           round(0.1::DOUBLE * (d1 - d0), 6) AS mechanical_d_p10_ms, round(k1, 6) AS p_k1_post_actual, round(ln(o1 / o0), 6) AS d_log_overshoot,
           round(CASE WHEN m0 > 0 AND m1 > 0 THEN ln(m1 / m0) END, 6) AS d_log_move, round(CASE WHEN j0 > 0 AND j1 > 0 THEN ln(j1 / j0) END, 6) AS d_log_jump
    FROM (SELECT *, 0.5 * ln(d1 / d0) AS law, ln(s1 / s0) AS implied FROM (
      SELECT pool, {', '.join(f"max({c}) FILTER (regime = '{reg}') AS {a}{i}" for a, c in (('d', 'dt_ms'), ('s', 'mean_sqrt_s'), ('t1', 'tau_p10'), ('t5', 'tau_p50'), ('k', 'p_k1'), ('o', 'cex_overshoot'), ('m', 'cex_move'), ('j', 'cex_jump')) for i, reg in ((0, 'pre'), (1, 'post')))}
      FROM rs GROUP BY pool))""", "rs"))
def implied_effects(spark, sf):
    stats = rs.response_stats(m.arbs(spark, sf), ["pool", "regime"], interval_ms(), m.MAX_TAU_MS)
    return rounded(rs.implied_effects(stats, ["pool"]))


@query("quantile_intercepts", with_parts(
    f"""SELECT pool, regime, count(*) AS n, max({DT_SQL}) AS dt_ms, round({mean_if('k_blocks = 1', 'true')}, 6) AS p_first,
        {', '.join(f"round(quantile_cont(tau_ms::DOUBLE, {q}) - {q}::DOUBLE * max({DT_SQL}), 6) AS ell_q{int(q * 100)}" for q in (0.1, 0.25, 0.5))}
        FROM ar WHERE {CEX} GROUP BY pool, regime""", "ar"))
def quantile_intercepts(spark, sf):
    return rounded(rs.quantile_intercepts(m.arbs(spark, sf), ["pool", "regime"], interval_ms(), m.MAX_TAU_MS))


def _component_sql() -> str:
    cols = ["count(*) AS n", "avg(overshoot_bps) AS overshoot_all", "sum(arb_loss) AS arb_loss_sum", "sum(volume_q) AS arb_volume"]
    for t in ("cex", "continuation", "same_block", "onchain"):
        cols += [f"avg(overshoot_bps) FILTER (trigger = '{t}') AS {t}", f"count(*) FILTER (trigger = '{t}') AS {t}_n", f"count(*) FILTER (trigger = '{t}') / count(*)::DOUBLE AS share_{t}"]
    quick = f"trigger = 'cex' AND tau_ms <= {m.MAX_TAU_MS}"
    cols += ["avg(jump_bps) FILTER (trigger = 'cex') AS cex_jump", "avg(move_bps) FILTER (trigger = 'cex') AS cex_move", f"avg(tau_ms) FILTER ({quick}) AS cex_tau_mean_ms",
             f"avg(sqrt(tau_ms / 1000.0::DOUBLE)) FILTER ({quick}) AS cex_sqrt_tau_mean", f"{mean_if('k_blocks = 1', quick)} AS cex_p_k1",
             f"quantile_cont(tau_ms::DOUBLE, 0.5) FILTER ({quick}) AS cex_tau_median_ms"]
    return f"SELECT pool, (ts_ms // 3600000) * 3600000 AS hour_ms, {', '.join(cols)} FROM sa GROUP BY 1, 2"


m.PARTS["cp"] = (("sa",), _component_sql())
COMP = ("overshoot_all arb_loss_sum arb_volume cex share_cex continuation share_continuation same_block share_same_block onchain share_onchain "
        "cex_jump cex_move cex_tau_mean_ms cex_sqrt_tau_mean cex_p_k1 cex_tau_median_ms")


def strict_arbs(spark, sf):
    return m.arbs(spark, sf).filter("is_arb_strict")


@query("component_panel", with_parts(f"SELECT pool, hour_ms, n, cex_n, continuation_n, same_block_n, onchain_n, {sql_round(COMP)} FROM cp", "cp"))
def component_panel(spark, sf):
    return rounded(rs.component_panel(strict_arbs(spark, sf), m.MAX_TAU_MS))


@query("component_weights", with_parts("""
    SELECT pool, n, round(mean_overshoot, 6) AS mean_overshoot, component, round(weight, 6) AS weight FROM (
      SELECT pool, count(*) AS n, avg(overshoot_bps) AS mean_overshoot,
             coalesce(sum(jump_bps) FILTER (trigger = 'cex'), 0) / sum(overshoot_bps) AS cex_jump, coalesce(sum(move_bps) FILTER (trigger = 'cex'), 0) / sum(overshoot_bps) AS cex_move,
             coalesce(sum(overshoot_bps) FILTER (trigger = 'continuation'), 0) / sum(overshoot_bps) AS continuation,
             coalesce(sum(overshoot_bps) FILTER (trigger = 'same_block'), 0) / sum(overshoot_bps) AS same_block,
             coalesce(sum(overshoot_bps) FILTER (trigger = 'onchain'), 0) / sum(overshoot_bps) AS onchain
      FROM sa WHERE regime = 'pre' AND abs(days_from_change) <= 14 GROUP BY pool)
    UNPIVOT (weight FOR component IN (cex_jump, cex_move, continuation, same_block, onchain))""", "sa"))
def component_weights(spark, sf):
    return rounded(rs.component_weights(strict_arbs(spark, sf), 14))


COMPETITION = "sqrt_tau first_block jump move overshoot_cex tau_p10 tau_med top1_share"
m.PARTS["co"] = (("ar",), f"""
    SELECT a.*, b.n_arbs, b.n_senders, b.top1_share FROM (
      SELECT pool, (ts_ms // 3600000) * 3600000 AS hour_ms, count(*) AS n_cex, avg(sqrt(tau_ms / 1000.0::DOUBLE)) AS sqrt_tau, {mean_if('k_blocks = 1', 'true')} AS first_block,
             avg(jump_bps) AS jump, avg(move_bps) AS move, avg(overshoot_bps) AS overshoot_cex, quantile_cont(tau_ms::DOUBLE, 0.1) AS tau_p10, quantile_cont(tau_ms::DOUBLE, 0.5) AS tau_med
      FROM ar WHERE {CEX} GROUP BY 1, 2) a
    JOIN (SELECT pool, hour_ms, CAST(sum(n) AS BIGINT) AS n_arbs, count(*) AS n_senders, max(n) / sum(n)::DOUBLE AS top1_share
          FROM (SELECT pool, (ts_ms // 3600000) * 3600000 AS hour_ms, sender, count(*) AS n FROM ar GROUP BY 1, 2, 3) GROUP BY 1, 2) b USING (pool, hour_ms)""")


@query("competition_panel", with_parts(f"SELECT pool, hour_ms, n_cex, n_arbs, n_senders, {sql_round(COMPETITION)} FROM co", "co"))
def competition_panel(spark, sf):
    return rounded(rs.competition_panel(m.arbs(spark, sf), m.MAX_TAU_MS))


@query("hour_panel_join", with_parts(
    """SELECT a.pool, a.log_index, a.tau_ms, p.hod, p.post, round(p.sigma_ps, 6) AS sigma_ps, round(p.liq_mean, 6) AS liq_mean, round(p.volume, 6) AS volume, p.day
       FROM ar a JOIN pn p ON p.pool = a.pool AND p.hour_ms = (a.ts_ms // 3600000) * 3600000""", "ar", "pn"))
def hour_panel_join(spark, sf):
    return rounded(_with_panel(spark, sf).select("pool", "log_index", "tau_ms", "hod", "post", "sigma_ps", "liq_mean", "volume", "day"))


def _with_panel(spark, sf):
    hours = m.panel(spark, sf).select("pool", "hour_ms", "hod", "post", "sigma_ps", "liq_mean", "volume", "day", "t_days")
    a = m.arbs(spark, sf).withColumn("hour_ms", F.col("ts_ms") - F.pmod(F.col("ts_ms"), F.lit(3_600_000)))
    return a.join(hours, ["pool", "hour_ms"])


# ---------------------------------------------------------------------------------------------------------------- senders
m.PARTS["sc"] = (("sa",), "SELECT pool, regime, sender, count(*) AS n, sum(volume_q) AS volume FROM sa GROUP BY 1, 2, 3")
m.PARTS["ns"] = (("en",), f"SELECT pool, CASE WHEN block < {m.CHANGE_BLOCK} THEN 'pre' ELSE 'post' END AS regime, sender, count(*) AS n FROM en GROUP BY 1, 2, 3")


def concentration_sql(source: str, by: str, active: int, volume: bool = True) -> str:
    vol = ", round(sum(volume * volume) / power(sum(volume), 2), 6) AS hhi_volume" if volume else ""
    return f"""SELECT {by}, count(*) AS n_members, CAST(sum(n) AS BIGINT) AS n_total, round(sum(n * n) / power(sum(n), 2), 6) AS hhi_count,
        round(sum(n) FILTER (i <= 1) / sum(n), 6) AS top1_share, round(sum(n) FILTER (i <= 3) / sum(n), 6) AS top3_share, round(sum(n) FILTER (i <= 5) / sum(n), 6) AS top5_share,
        count(*) FILTER (10 * cum < 9 * tot) + 1 AS n_for_90pct, count(*) FILTER (n >= {active}) AS n_active{vol}
      FROM (SELECT *, row_number() OVER w AS i, sum(n) OVER (w ROWS UNBOUNDED PRECEDING) AS cum, sum(n) OVER (PARTITION BY {by}) AS tot
            FROM {source} WINDOW w AS (PARTITION BY {by} ORDER BY n DESC, {'sender' if volume else 'member'})) GROUP BY {by}"""


@query("concentration", with_parts(concentration_sql("sc", "pool, regime", MIN_ARBS), "sc"))
def concentration(spark, sf):
    return rounded(rs.sender_concentration(strict_arbs(spark, sf), ["pool", "regime"], MIN_ARBS))


@query("count_by_key_regime", with_parts("SELECT pool, regime, sender, n FROM ns", "ns"))
def count_by_key_regime(spark, sf):
    return _swap_counts(spark, sf)


def _swap_counts(spark, sf):
    regime = F.when(F.col("block") < m.CHANGE_BLOCK, "pre").otherwise("post").alias("regime")
    return m.enriched_swaps(spark, sf).groupBy("pool", regime, "sender").agg(F.count(F.lit(1)).alias("n"))


@query("active_bots", with_parts(f"""
    SELECT pool, regime, count(*) FILTER (n >= {MIN_ARBS}) AS n_active, count(*) FILTER (n >= {MIN_ARBS} AND n / own::DOUBLE >= 0.5) AS n_bots,
           round(coalesce(sum(n) FILTER (n >= {MIN_ARBS} AND n / own::DOUBLE >= 0.5), 0) / sum(n), 6) AS bots_share_of_arbs
    FROM (SELECT sc.*, ns.n AS own FROM sc JOIN ns USING (pool, regime, sender)) GROUP BY 1, 2""", "sc", "ns"))
def active_bots(spark, sf):
    return rounded(rs.active_bots(strict_arbs(spark, sf), _swap_counts(spark, sf), ["pool", "regime"], MIN_ARBS))


TOP = "share arb_share_of_own_swaps tau_p10_ms tau_p50_ms p_k1 overshoot_bps arb_loss_sum volume share_same_block"
TOP_SQL = with_parts(f"""
    SELECT pool, regime, CAST(rank AS INTEGER) AS rank, sender, n_arb, n_cex, {sql_round(TOP)} FROM (
      SELECT r.pool, r.regime, r.rank, r.sender, r.n AS n_arb, r.n / r.tot::DOUBLE AS share, r.n / ns.n::DOUBLE AS arb_share_of_own_swaps, d.*
      FROM (SELECT *, row_number() OVER (PARTITION BY pool, regime ORDER BY n DESC, sender) AS rank, sum(n) OVER (PARTITION BY pool, regime) AS tot FROM sc) r
      JOIN ns USING (pool, regime, sender)
      JOIN (SELECT pool AS p_, regime AS r_, sender AS s_, count(*) FILTER ({CEX}) AS n_cex,
                   CASE WHEN count(*) FILTER ({CEX}) >= 3 THEN quantile_cont(tau_ms::DOUBLE, 0.1) FILTER ({CEX}) END AS tau_p10_ms,
                   CASE WHEN count(*) FILTER ({CEX}) >= 3 THEN quantile_cont(tau_ms::DOUBLE, 0.5) FILTER ({CEX}) END AS tau_p50_ms,
                   CASE WHEN count(*) FILTER ({CEX}) >= 3 THEN {mean_if('k_blocks = 1', CEX)} END AS p_k1, avg(overshoot_bps) AS overshoot_bps,
                   sum(arb_loss) AS arb_loss_sum, sum(volume_q) AS volume, {mean_if("trigger = 'same_block'", 'true')} AS share_same_block
            FROM sa GROUP BY 1, 2, 3) d ON d.p_ = r.pool AND d.r_ = r.regime AND d.s_ = r.sender
      WHERE r.rank <= 15)""", "sc", "ns", "sa")


@query("top_senders", TOP_SQL)
def top_senders(spark, sf):
    return rounded(rs.top_senders(strict_arbs(spark, sf), _swap_counts(spark, sf), ["pool", "regime"], m.MAX_TAU_MS, min_obs=3))


PAIRED = "p10_pre p10_post p50_pre p50_post d_p10_ms d_p50_ms mechanical_d_p10_ms mechanical_d_p50_ms ell_q10_pre ell_q10_post ell_q50_pre ell_q50_post p_k1_pre p_k1_post"
m.PARTS["pq"] = (("ar",), f"""
    SELECT sender, regime, count(*) AS n, quantile_cont(tau_ms::DOUBLE, 0.1) AS p10, quantile_cont(tau_ms::DOUBLE, 0.5) AS p50, {mean_if('k_blocks = 1', 'true')} AS k1
    FROM ar WHERE {CEX} GROUP BY 1, 2 HAVING count(*) >= {MIN_PAIR}""")
m.PARTS["pr"] = (("pq",), f"""
    SELECT a.sender, a.n AS n_pre, b.n AS n_post, a.p10 AS p10_pre, b.p10 AS p10_post, a.p50 AS p50_pre, b.p50 AS p50_post, b.p10 - a.p10 AS d_p10_ms, b.p50 - a.p50 AS d_p50_ms,
           {0.1 * (m.DT_POST_MS - m.DT_PRE_MS)}::DOUBLE AS mechanical_d_p10_ms, {0.5 * (m.DT_POST_MS - m.DT_PRE_MS)}::DOUBLE AS mechanical_d_p50_ms,
           a.p10 - {0.1 * m.DT_PRE_MS}::DOUBLE AS ell_q10_pre, b.p10 - {0.1 * m.DT_POST_MS}::DOUBLE AS ell_q10_post,
           a.p50 - {0.5 * m.DT_PRE_MS}::DOUBLE AS ell_q50_pre, b.p50 - {0.5 * m.DT_POST_MS}::DOUBLE AS ell_q50_post, a.k1 AS p_k1_pre, b.k1 AS p_k1_post
    FROM pq a JOIN pq b ON a.sender = b.sender AND a.regime = 'pre' AND b.regime = 'post'""")


def _paired(spark, sf):
    return rs.paired_groups(m.arbs(spark, sf), "sender", [], m.DT_PRE_MS, m.DT_POST_MS, MIN_PAIR, m.MAX_TAU_MS)


@query("paired_groups", with_parts(f"SELECT sender, n_pre, n_post, {sql_round(PAIRED)} FROM pr", "pr"))
def paired_groups(spark, sf):
    return rounded(_paired(spark, sf))


@query("paired_summary", with_parts(f"""
    SELECT count(*) AS n_paired, round({mean_if('ell_q10_post < ell_q10_pre - 20', 'true')}, 6) AS share_lower_q10,
           round(quantile_cont(ell_q10_post - ell_q10_pre, 0.5), 6) AS median_d_ell_q10, round(quantile_cont(ell_q50_post - ell_q50_pre, 0.5), 6) AS median_d_ell_q50 FROM pr""", "pr"))
def paired_summary(spark, sf):
    return rounded(rs.paired_summary(_paired(spark, sf), []))


@query("entry_exit", with_parts(f"""
    SELECT pool, count(*) FILTER (a >= {MIN_ARBS} AND b >= {MIN_ARBS}) AS stayers, count(*) FILTER (a < {MIN_ARBS} AND b >= {MIN_ARBS}) AS entrants,
           count(*) FILTER (a >= {MIN_ARBS} AND b < {MIN_ARBS}) AS exits, round(coalesce(sum(b) FILTER (a < {MIN_ARBS} AND b >= {MIN_ARBS}), 0) / nullif(sum(b), 0), 6) AS entrants_share
    FROM (SELECT pool, sender, count(*) FILTER (regime = 'pre') AS a, count(*) FILTER (regime = 'post') AS b FROM sa GROUP BY 1, 2) GROUP BY pool""", "sa"))
def entry_exit(spark, sf):
    return rounded(rs.entry_exit(strict_arbs(spark, sf), "sender", ["pool"], MIN_ARBS))


@query("tau_histogram", with_parts(f"""
    SELECT regime, CAST(least(1 + floor((ln(greatest(tau_ms, 20.0::DOUBLE)) - ln(20.0::DOUBLE)) / (ln({m.MAX_TAU_MS}::DOUBLE) - ln(20.0::DOUBLE)) * 59), 59) AS INTEGER) AS bin, count(*) AS n
    FROM ar WHERE {CEX} GROUP BY 1, 2""", "ar"))
def tau_histogram(spark, sf):
    return rs.tau_histogram(m.arbs(spark, sf), m.MAX_TAU_MS)


@query("block_wait_distribution", with_parts(f"SELECT regime, CAST(least(k_blocks, 7) AS INTEGER) AS k, count(*) AS n FROM ar WHERE {CEX} GROUP BY 1, 2", "ar"))
def block_wait_distribution(spark, sf):
    return rs.block_wait_distribution(m.arbs(spark, sf), m.MAX_TAU_MS)


JBINS = (0.0, 500.0, 1500.0, 4000.0, 10000.0, 25000.0)


@query("bin_table", with_parts(f"""
    SELECT regime, CASE {' '.join(f'WHEN jump_bps >= {lo} AND jump_bps < {hi} THEN {i}' for i, (lo, hi) in enumerate(zip(JBINS, JBINS[1:])))} ELSE 5 END AS bin,
           count(*) AS n, round(avg(tau_ms), 6) AS mean_tau, round({mean_if('k_blocks = 1', 'true')}, 6) AS p_first
    FROM ar WHERE {CEX} GROUP BY 1, 2""", "ar"))
def bin_table(spark, sf):
    a = m.arbs(spark, sf).filter(rs.market_triggered(m.MAX_TAU_MS))
    return rounded(rs.value_bins(a, ["regime"], "jump_bps", JBINS, [F.count(F.lit(1)).alias("n"), F.avg("tau_ms").alias("mean_tau"), rs.share(F.col("k_blocks") == 1).alias("p_first")]))


@query("jump_quantiles", with_parts(f"""
    SELECT {', '.join(f"round(quantile_cont(jump_bps, {q}), 6) AS q{int(q * 100)}" for q in (0.25, 0.5, 0.75, 0.9, 0.95, 0.99))} FROM ar WHERE {CEX}""", "ar"))
def jump_quantiles(spark, sf):
    a = m.arbs(spark, sf).filter(rs.market_triggered(m.MAX_TAU_MS))
    return rounded(summarise(a, [], [], [Quantile(f"q{int(q * 100)}", F.col("jump_bps"), q) for q in (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)], bounded=False))


@query("tercile_table", with_parts(f"""
    SELECT post, tercile, count(*) AS n, round(quantile_cont(tau_med, 0.5), 6) AS tau_median, round(avg(first_block), 6) AS first_block, round(avg(n_senders), 6) AS senders
    FROM (SELECT co.*, p.post, CASE WHEN p.sigma_ps > e.b THEN 2 WHEN p.sigma_ps > e.a THEN 1 ELSE 0 END AS tercile
          FROM co JOIN pn p USING (pool, hour_ms)
          JOIN (SELECT co.pool, p.post, quantile_cont(p.sigma_ps, 1.0::DOUBLE / 3) AS a, quantile_cont(p.sigma_ps, 2.0::DOUBLE / 3) AS b
                FROM co JOIN pn p USING (pool, hour_ms) WHERE p.sigma_ps > 0 GROUP BY 1, 2) e ON e.pool = co.pool AND e.post = p.post
          WHERE p.sigma_ps > 0) GROUP BY 1, 2""", "co", "pn"))
def tercile_table(spark, sf):
    hours = m.panel(spark, sf).select("pool", "hour_ms", "sigma_ps", "post")
    h = rs.competition_panel(m.arbs(spark, sf), m.MAX_TAU_MS).join(hours, ["pool", "hour_ms"]).filter("sigma_ps > 0")
    binned = quantile_bins(h, ["pool", "post"], "sigma_ps", 3, "tercile")
    return rounded(summarise(
        binned, ["post", "tercile"], [F.count(F.lit(1)).alias("n"), F.avg("first_block").alias("first_block"), F.avg("n_senders").alias("senders")],
        [Quantile("tau_median", F.col("tau_med"), 0.5)]))


@query("overshoot_decomposition", with_parts(f"""
    WITH_CONTINUES
    SELECT pool, round(ln(tot1 / tot0), 6) AS actual, round(ln((tot0 - sm0 * (1 - exp(implied))) / tot0), 6) AS counterfactual_tau,
           round(ln((tot0 - sm0 * (1 - exp(law))) / tot0), 6) AS counterfactual_law, round(ln((tot0 - (sm0 + sc0) * (1 - exp(implied))) / tot0), 6) AS counterfactual_tau_all,
           round((sj1 - sj0) / (0.5 * (tot0 + tot1)), 6) AS contrib_cex_jump, round((sm1 - sm0) / (0.5 * (tot0 + tot1)), 6) AS contrib_cex_move,
           round((sc1 - sc0) / (0.5 * (tot0 + tot1)), 6) AS contrib_continuation, round((sb1 - sb0) / (0.5 * (tot0 + tot1)), 6) AS contrib_same_block,
           round((so1 - so0) / (0.5 * (tot0 + tot1)), 6) AS contrib_onchain
    FROM (SELECT pool, {', '.join(f"{expr} FILTER (regime = '{reg}') AS {n}{i}" for n, expr in (('tot', 'avg(o)'), ('sj', "avg(CASE WHEN trigger = 'cex' THEN j ELSE 0 END)"), ('sm', "avg(CASE WHEN trigger = 'cex' THEN v ELSE 0 END)"), ('sc', "avg(CASE WHEN trigger = 'continuation' THEN o ELSE 0 END)"), ('sb', "avg(CASE WHEN trigger = 'same_block' THEN o ELSE 0 END)"), ('so', "avg(CASE WHEN trigger = 'onchain' THEN o ELSE 0 END)")) for i, reg in ((0, 'pre'), (1, 'post')))}
          FROM (SELECT a.pool, a.regime, a.trigger, a.overshoot_bps / (p.sigma_ps * 10000) AS o, a.jump_bps / (p.sigma_ps * 10000) AS j, a.move_bps / (p.sigma_ps * 10000) AS v
                FROM sa a JOIN pn p ON p.pool = a.pool AND p.hour_ms = (a.ts_ms // 3600000) * 3600000 WHERE p.sigma_ps > 0) GROUP BY pool)
    JOIN (SELECT pool, 0.5 * ln(max(dt_ms) FILTER (regime = 'post') / max(dt_ms) FILTER (regime = 'pre')) AS law,
                 ln(max(mean_sqrt_s) FILTER (regime = 'post') / max(mean_sqrt_s) FILTER (regime = 'pre')) AS implied FROM rs GROUP BY pool) e USING (pool)""".replace("WITH_CONTINUES\n", ""), "sa", "pn", "rs"))
def overshoot_decomposition(spark, sf):
    joined = _with_panel(spark, sf)
    stats = rs.response_stats(m.arbs(spark, sf), ["pool", "regime"], interval_ms(), m.MAX_TAU_MS)
    parts = rs.overshoot_components(joined.filter("is_arb_strict"), ["pool", "regime"], F.col("sigma_ps") * 1e4)
    return rounded(rs.overshoot_decomposition(parts, rs.implied_effects(stats, ["pool"]).select("pool", "implied", "law")))


@query("six_regime_summary", with_parts("""
    SELECT regime, round(min(ell_q10), 6) AS q10_min, round(max(ell_q10), 6) AS q10_max, round(min(ell_q50), 6) AS q50_min, round(max(ell_q50), 6) AS q50_max,
           round(sum(n_cex * ell_q50) / sum(n_cex) FILTER (ell_q50 IS NOT NULL), 6) AS weighted_q50, round(min(p_k1), 6) AS p_k1_min, round(max(p_k1), 6) AS p_k1_max
    FROM rs GROUP BY regime""", "rs"))
def six_regime_summary(spark, sf):
    t = rs.response_stats(m.arbs(spark, sf), ["pool", "regime"], interval_ms(), m.MAX_TAU_MS)
    return rounded(t.groupBy("regime").agg(
        F.min("ell_q10").alias("q10_min"), F.max("ell_q10").alias("q10_max"), F.min("ell_q50").alias("q50_min"), F.max("ell_q50").alias("q50_max"),
        (F.sum(F.col("n_cex") * F.col("ell_q50")) / F.sum(F.when(F.col("ell_q50").isNotNull(), F.col("n_cex")))).alias("weighted_q50"),
        F.min("p_k1").alias("p_k1_min"), F.max("p_k1").alias("p_k1_max")))


@query("sender_rollup", with_parts("""
    SELECT sender, count(*) AS appearances, count(DISTINCT pool) AS pools, count(DISTINCT regime) AS regimes, round(avg(share), 6) AS mean_share, round(max(share), 6) AS max_share,
           CAST(sum(n) AS BIGINT) AS arbs, round(quantile_cont(share, 0.5), 6) AS median_share
    FROM (SELECT *, n / sum(n) OVER (PARTITION BY pool, regime)::DOUBLE AS share FROM sc) GROUP BY sender HAVING count(*) >= 4""", "sc"))
def sender_rollup(spark, sf):
    counts = rs.sender_counts(strict_arbs(spark, sf), ["pool", "regime"])
    totals = counts.groupBy("pool", "regime").agg(F.sum("n").alias("_all"))
    shares = counts.join(totals, ["pool", "regime"]).withColumn("share", F.col("n") / F.col("_all"))
    return rounded(summarise(
        shares, ["sender"],
        [F.count(F.lit(1)).alias("appearances"), F.count_distinct("pool").alias("pools"), F.count_distinct("regime").alias("regimes"),
         F.avg("share").alias("mean_share"), F.max("share").alias("max_share"), F.sum("n").alias("arbs")],
        [Quantile("median_share", F.col("share"), 0.5)]).filter("appearances >= 4"))


@query("spearman", with_parts(f"""
    SELECT regime, count(*) AS n, round(CASE WHEN count(*) >= 5 THEN corr(rx, ry) END, 6) AS rho FROM (
      SELECT regime, rank() OVER (PARTITION BY regime ORDER BY n) + (count(*) OVER (PARTITION BY regime, n) - 1) / 2.0::DOUBLE AS rx,
             rank() OVER (PARTITION BY regime ORDER BY med) + (count(*) OVER (PARTITION BY regime, med) - 1) / 2.0::DOUBLE AS ry
      FROM (SELECT regime, sender, count(*) AS n, quantile_cont(tau_ms::DOUBLE, 0.5) AS med FROM sa WHERE {CEX} GROUP BY 1, 2)) GROUP BY regime""", "sa"))
def spearman_query(spark, sf):
    a = strict_arbs(spark, sf).filter(rs.market_triggered(m.MAX_TAU_MS))
    per = summarise(a, ["regime", "sender"], [F.count(F.lit(1)).alias("n_arb")], [Quantile("med", F.col("tau_ms"), 0.5)])
    return rounded(spearman(per, ["regime"], "n_arb", "med"))


@query("window_abs", with_parts("SELECT pool, count(*) AS n FROM ar WHERE abs(days_from_change) <= 7 GROUP BY pool", "ar"))
def window_abs(spark, sf):
    return rs.in_window(m.arbs(spark, sf), 7).groupBy("pool").agg(F.count(F.lit(1)).alias("n"))


@query("bot_flow_filter", with_parts(f"SELECT pool, trigger, count(*) AS n FROM ar WHERE {CEX} GROUP BY 1, 2", "ar"))
def bot_flow_filter(spark, sf):
    return m.arbs(spark, sf).filter(rs.market_triggered(m.MAX_TAU_MS)).groupBy("pool", "trigger").agg(F.count(F.lit(1)).alias("n"))


@query("sharp_openings", with_parts(f"SELECT pool, regime, count(*) AS n, round(avg(jump_bps), 6) AS mean_jump FROM ar WHERE {SHARP} GROUP BY 1, 2", "ar"))
def sharp_openings(spark, sf):
    a = m.arbs(spark, sf).filter(rs.market_triggered(m.MAX_TAU_MS) & (F.col("jump_bps") >= 0.5 * F.col("fee_rate") * 1e4))
    return rounded(a.groupBy("pool", "regime").agg(F.count(F.lit(1)).alias("n"), F.avg("jump_bps").alias("mean_jump")))


@query("top_n_per_group", with_parts("SELECT pool, regime, sender, n, CAST(i AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY pool, regime ORDER BY n DESC, sender) AS i FROM ns) WHERE i <= 3", "ns"))
def top_n_per_group(spark, sf):
    return top_n(_swap_counts(spark, sf), ["pool", "regime"], [F.col("n").desc(), F.col("sender")], 3)
