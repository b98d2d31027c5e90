"""Regressions and statistics of coefficient tables on the stand-in market."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import market as m
from checks.market import table, with_parts
from checks.q_response import CEX, interval_ms, strict_arbs
from checks.registry import query
from checks.rounding import rounded, sql_round
from tideline.functions import clock
from tideline.operators.gram import design_rows, fit, gram
from tideline.plans import estimates as es, latency, panel as pn, price_discovery as pd_, response as rs

POOLS = ["click", "error", "purchase", "signup", "view"]
OUTCOMES = ["overshoot_bps", "volume", "n_arb"]


def coefficients(df, *terms):
    kept = df.filter(F.col("term").isin(*terms)) if terms else df
    return rounded(kept.select("model_name", "term", "b", "se", "p", "n", "clusters"), 6)


# ------------------------------------------------------------------------------------------------- moments, least squares
@query("gram", """
    SELECT event_type AS cluster, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(CASE WHEN i = -1 THEN count(*) WHEN i = 0 AND j = 0 THEN count(*) WHEN i = 0 AND j = 1 THEN sum(user_id) WHEN i = 0 THEN sum(value)
           WHEN i = 1 AND j = 1 THEN sum(user_id * user_id) WHEN i = 1 THEN sum(user_id * value) ELSE sum(value * value) END, 4) AS value
    FROM events, (VALUES (-1, -1), (0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)) v(i, j) GROUP BY 1, i, j""")
def gram_query(spark, sf):
    from tideline.operators.gram import Spec

    spec = Spec("m", "value", {"user": "user_id"}, cluster="event_type")
    return rounded(gram(design_rows(table(spark, sf, "events"), [spec]), [[]]).select("cluster", "i", "j", "value"), 4)


def _two_regressor_sql(outcome: str) -> str:
    """ln outcome on post and ln sigma with hour effects, day clusters: hour means removed, then the 2 x 2 system."""
    return f"""
    SELECT '{outcome}|' || pool AS model_name, round(bp, 6) AS b, round(sqrt(f * (ipp * ipp * mpp + 2 * ipp * ips * mps + ips * ips * mss)), 6) AS se, n, clusters, round(bs, 6) AS b_sigma
    FROM (SELECT pool, any_value(n) AS n, count(*) AS clusters, any_value(bp) AS bp, any_value(bs) AS bs, any_value(ipp) AS ipp, any_value(ips) AS ips,
                 sum(sp * sp) AS mpp, sum(sp * ss) AS mps, sum(ss * ss) AS mss, count(*) / (count(*) - 1.0::DOUBLE) * (any_value(n) - 1.0::DOUBLE) / (any_value(n) - 2 - any_value(hours)) AS f
          FROM (SELECT d.pool, d.day, any_value(c.n) AS n, any_value(c.hours) AS hours, any_value(c.bp) AS bp, any_value(c.bs) AS bs, any_value(c.ipp) AS ipp, any_value(c.ips) AS ips,
                       sum(d.p * (d.y - c.bp * d.p - c.bs * d.s)) AS sp, sum(d.s * (d.y - c.bp * d.p - c.bs * d.s)) AS ss
                FROM dm d JOIN (
                  SELECT pool, n, hours, vss / (vpp * vss - vps * vps) AS ipp, -vps / (vpp * vss - vps * vps) AS ips,
                         (vss * vpy - vps * vsy) / (vpp * vss - vps * vps) AS bp, (vpp * vsy - vps * vpy) / (vpp * vss - vps * vps) AS bs
                  FROM (SELECT pool, count(*) AS n, count(DISTINCT hod) AS hours, sum(p * p) AS vpp, sum(s * s) AS vss, sum(p * s) AS vps, sum(p * y) AS vpy, sum(s * y) AS vsy FROM dm GROUP BY pool HAVING count(*) >= 30)) c USING (pool)
                GROUP BY d.pool, d.day) GROUP BY pool)"""


def _demeaned(outcome: str) -> str:
    return f"""
    , dm AS (SELECT pool, day, hod, y - avg(y) OVER w AS y, p - avg(p) OVER w AS p, s - avg(s) OVER w AS s
             FROM (SELECT pool, day, hod, ln({outcome}) AS y, post::DOUBLE AS p, ln(sigma_ps) AS s FROM pn WHERE {outcome} > 0 AND sigma_ps > 0) WINDOW w AS (PARTITION BY pool, hod))
    {_two_regressor_sql(outcome)}"""


def _ols(spark, sf, outcome):
    specs = [es.panel_spec(f"{outcome}|{p}", outcome, [p]) for p in POOLS]
    c = fit(m.panel(spark, sf), specs)
    post = c.filter("term = 'post'").select("model_name", "b", "se", "n", "clusters")
    return rounded(post.join(c.filter("term = 'log_sigma'").select("model_name", F.col("b").alias("b_sigma")), "model_name"))


@query("ols_fe_cluster", with_parts(_demeaned("volume"), "pn"))
def ols_fe_cluster(spark, sf):
    return _ols(spark, sf, "volume")


@query("ols_fe_cluster_overshoot", with_parts(_demeaned("overshoot_bps"), "pn"))
def ols_fe_cluster_overshoot(spark, sf):
    return _ols(spark, sf, "overshoot_bps")


@query("rd_jump")
def rd_jump(spark, sf):
    return coefficients(fit(m.panel(spark, sf), [es.panel_spec(o, o, POOLS, "rd", 14) for o in OUTCOMES]), "post", "t_days", "post_t")


@query("placebo")
def placebo(spark, sf):
    p = m.panel(spark, sf)
    return coefficients(fit(p, [es.placebo(es.panel_spec(o, o, POOLS, c, 14), -7) for o in OUTCOMES for c in ("sigma", "rd")]), "post")


@query("did")
def did(spark, sf):
    treated = F.when(F.col("pool").isin("click", "purchase"), 1).otherwise(0)
    return coefficients(fit(m.panel(spark, sf).withColumn("treated", treated), [es.did_spec(o, o, POOLS, 14) for o in OUTCOMES]), "post_treated", "post")


@query("stacked_elasticity")
def stacked_elasticity(spark, sf):
    p = m.panel(spark, sf)
    shifted = pn.hourly_panel(m.enriched_swaps(spark, sf, lag_ms=3_600_000), m.CHANGE_MS, 45.0, 30.0)
    both = p.withColumn("change", F.lit("a")).unionByName(shifted.withColumn("change", F.lit("b")))
    specs = [es.stacked_spec(f"{c}|{g}", "volume", ["a", "b"], POOLS, es.CONTROL_SETS[c] if c == "sigma" else {"log_liq": "ln(liq_mean)"}, g == "by") for c in ("sigma", "liq") for g in ("one", "by")]
    c = fit(both, specs).filter(F.col("term").startswith("log_dt"))
    return rounded(c.select("model_name", "term", "b", "se", "n", "clusters", "wald_p"))


@query("heterogeneity")
def heterogeneity(spark, sf):
    p = es.with_median_flag(m.panel(spark, sf).filter("sigma_ps > 0"), ["pool"], "sigma_ps")
    return coefficients(fit(p, es.heterogeneity_specs("overshoot_bps", "overshoot_bps", POOLS)), "post", "post_log_sigma", "post_high", "post_night")


@query("share_lpm")
def share_lpm(spark, sf):
    c = rs.component_panel(strict_arbs(spark, sf), m.MAX_TAU_MS)
    hours = m.panel(spark, sf).select("pool", "hour_ms", "sigma_ps", "post", "hod", "day", "t_days")
    specs = [es.share_spec(f"share_{t}", f"share_{t}", 30, 1) for t in ("cex", "continuation", "same_block", "onchain")]
    return coefficients(fit(c.join(hours, ["pool", "hour_ms"]), specs), "post", "log_sigma")


@query("spec_grid")
def spec_grid(spark, sf):
    c = fit(m.panel(spark, sf), es.spec_grid(OUTCOMES, POOLS, [7, 14])).filter("term = 'post'")
    return rounded(es.split_names(c.select("model_name", "b", "se", "p", "n", "clusters"), ["outcome", "window", "controls", "pool"]))


@query("residual_event_study")
def residual_event_study(spark, sf):
    return rounded(es.event_study(m.panel(spark, sf), es.panel_spec("volume", "volume", POOLS), pre_only=True))


@query("daily_residual_path")
def daily_residual_path(spark, sf):
    return rounded(es.event_study_levels(es.event_study(m.panel(spark, sf), es.panel_spec("volume", "volume", POOLS))))


def _wedge(spark, sf):
    return pn.reference_wedge(m.panel(spark, sf), m.panel(spark, sf, lag_ms=3_600_000), ["arb_profit", "overshoot_bps", "mean_abs_dev_pre", "n_arb"])


@query("reference_wedge", with_parts("""
    SELECT pool, hour_ms, round(CASE WHEN a.arb_profit > 0 AND b.arb_profit > 0 THEN ln(b.arb_profit) - ln(a.arb_profit) END, 6) AS w_arb_profit,
           round(CASE WHEN a.overshoot_bps > 0 AND b.overshoot_bps > 0 THEN ln(b.overshoot_bps) - ln(a.overshoot_bps) END, 6) AS w_overshoot_bps,
           round(CASE WHEN a.mean_abs_dev_pre > 0 AND b.mean_abs_dev_pre > 0 THEN ln(b.mean_abs_dev_pre) - ln(a.mean_abs_dev_pre) END, 6) AS w_mean_abs_dev_pre,
           round(CASE WHEN a.n_arb > 0 AND b.n_arb > 0 THEN ln(b.n_arb) - ln(a.n_arb) END, 6) AS w_n_arb
    FROM pn a JOIN pn1 b USING (pool, hour_ms)""", "pn", "pn1"))
def reference_wedge(spark, sf):
    return rounded(_wedge(spark, sf).select("pool", "hour_ms", "w_arb_profit", "w_overshoot_bps", "w_mean_abs_dev_pre", "w_n_arb"))


@query("wedge_regression")
def wedge_regression(spark, sf):
    return coefficients(fit(_wedge(spark, sf), es.wedge_specs(["overshoot_bps", "mean_abs_dev_pre"], POOLS)), "post")


@query("fee_tier_rd")
def fee_tier_rd(spark, sf):
    return coefficients(fit(pn.pool_pairs(m.panel(spark, sf), "click", "purchase"), es.fee_tier_specs()), "post", "post_t")


@query("sigma_elasticity")
def sigma_elasticity(spark, sf):
    outcomes = {"overshoot": "CASE WHEN overshoot_bps > 0 THEN ln(overshoot_bps) END", "arbs": "CASE WHEN n_arb > 0 THEN ln(n_arb) END", "share": "share_swaps_outside"}
    c = fit(m.panel(spark, sf), es.sigma_elasticity_specs(outcomes, POOLS, use_t=True)).filter("term = 'log_sigma'")
    return rounded(es.split_names(c.select("model_name", "b", "se", "p", "n", "clusters"), ["outcome", "regime", "controls"]))


@query("t_cluster_pvalue")
def t_cluster_pvalue(spark, sf):
    c = fit(m.panel(spark, sf), [es.panel_spec(p, "volume", [p]) for p in POOLS]).filter("term = 'post'")
    return rounded(es.cluster_t_pvalues(c).select("model_name", "b", "se", "p", "p_t", "clusters"))


@query("lp_decomposition")
def lp_decomposition(spark, sf):
    return coefficients(fit(m.panel(spark, sf), es.lp_decomposition_specs(POOLS, 14)), "post")


# -------------------------------------------------------------------------------------------- coefficient-table statistics
SLOPES = """
    , sl AS (SELECT event_type, w, b, sqrt((syy - b * sxy) / (n - 2) / sxx) AS se, n FROM (
        SELECT event_type, w, regr_slope(value, user_id) AS b, regr_sxx(value, user_id) AS sxx, regr_sxy(value, user_id) AS sxy, regr_syy(value, user_id) AS syy, count(*) AS n
        FROM (SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 1 ELSE 2 END AS w FROM events) GROUP BY 1, 2))"""


def slopes(spark, sf):
    """A coefficient table: slope of value on user id per event type and half of the period."""
    e = table(spark, sf, "events").withColumn("w", F.when(clock.epoch_ms(F.col("ts")) < m.CHANGE_MS, 1).otherwise(2))
    t = e.groupBy("event_type", "w").agg(
        F.regr_slope("value", "user_id").alias("b"), F.regr_sxx("value", "user_id").alias("_xx"), F.regr_sxy("value", "user_id").alias("_xy"),
        F.regr_syy("value", "user_id").alias("_yy"), F.count(F.lit(1)).alias("n"))
    return t.select("event_type", "w", "b", F.sqrt((F.col("_yy") - F.col("b") * F.col("_xy")) / (F.col("n") - 2) / F.col("_xx")).alias("se"), "n")


@query("iv_pool", SLOPES.replace(", sl", "WITH sl", 1) + """
    SELECT w, k, round(wb / sw, 6) AS b, round(1 / sqrt(sw), 6) AS se, round(greatest(wbb - wb * wb / sw, 0), 6) AS q, round((wb / sw - 0.5) * sqrt(sw), 6) AS t
    FROM (SELECT w, count(*) AS k, sum(1 / (se * se)) AS sw, sum(b / (se * se)) AS wb, sum(b * b / (se * se)) AS wbb FROM sl GROUP BY w)""")
def iv_pool(spark, sf):
    return rounded(es.pool_estimates(slopes(spark, sf), ["w"], against=0.5, p_values=False))


@query("iv_pool_pvalues")
def iv_pool_pvalues(spark, sf):
    return rounded(es.pool_estimates(slopes(spark, sf), ["w"]))


def _merged(spark, sf):
    s = slopes(spark, sf)
    return es.merge_estimates(s.filter("w = 1"), s.filter("w = 2"), ["event_type"])


@query("merge_estimates", SLOPES.replace(", sl", "WITH sl", 1) + """
    SELECT event_type, round(a.b, 6) AS b_1, round(a.se, 6) AS se_1, round(b.b, 6) AS b_2, round(b.se, 6) AS se_2 FROM sl a JOIN sl b USING (event_type) WHERE a.w = 1 AND b.w = 2""")
def merge_estimates(spark, sf):
    return rounded(_merged(spark, sf))


@query("difference_test", SLOPES.replace(", sl", "WITH sl", 1) + """
    SELECT event_type, round(b.b - 0.7::DOUBLE * a.b, 6) AS d, round(sqrt(b.se * b.se + 0.49::DOUBLE * a.se * a.se), 6) AS d_se, round((b.b - 0.7::DOUBLE * a.b) / sqrt(b.se * b.se + 0.49::DOUBLE * a.se * a.se), 6) AS z
    FROM sl a JOIN sl b USING (event_type) WHERE a.w = 1 AND b.w = 2""")
def difference_test(spark, sf):
    return rounded(es.difference_test(_merged(spark, sf), 0.7, p_values=False).select("event_type", "d", "d_se", "z"))


@query("wls_line", """
    SELECT event_type, n, round(slope, 8) AS slope, round(intercept, 6) AS intercept, round(sqrt((vyy - slope * vxy) / (n - 2) / vxx), 8) AS slope_se, round(1 - (vyy - slope * vxy) / vyy, 8) AS r2, round(c, 8) AS corr, round(mae, 6) AS mae
    FROM (SELECT *, vxy / vxx AS slope, sy / sw - vxy / vxx * sx / sw AS intercept FROM (
      SELECT event_type, n, sw, sx, sy, c, mae, sxx - sx * sx / sw AS vxx, sxy - sx * sy / sw AS vxy, syy - sy * sy / sw AS vyy FROM (
        SELECT event_type, count(*) AS n, sum(w) AS sw, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy, sum(w * y * y) AS syy, corr(y, x) AS c, avg(abs(x - y)) AS mae
        FROM (SELECT event_type, user_id::DOUBLE AS x, value AS y, 1.0::DOUBLE / (1 + event_id % 7) AS w FROM events) GROUP BY 1)))""")
def wls_line(spark, sf):
    e = table(spark, sf, "events").withColumn("w", 1.0 / (1 + F.col("event_id") % 7)).withColumn("x", F.col("user_id").cast("double"))
    t = es.weighted_line(e, ["event_type"], "x", "value", "w")
    return t.select("event_type", "n", *[F.round(F.col(c) + 0.0137 * 10.0**-d, d).alias(c) for c, d in (("slope", 8), ("intercept", 6), ("slope_se", 8), ("r2", 8), ("corr", 8), ("mae", 6))])


FLOOR_SQL = SLOPES.replace(", sl", "WITH sl", 1) + """
    , es AS (SELECT w, -abs(b) / (abs(b) + se) AS b, 0.1::DOUBLE + se AS se, CASE WHEN event_type < 'm' THEN 1.5::DOUBLE ELSE 0.75::DOUBLE END AS d0, CASE WHEN event_type < 'm' THEN 0.75::DOUBLE ELSE 0.45::DOUBLE END AS d1 FROM sl),
    cv AS (SELECT w, i, sum(power((b - 0.5 * ln((d1 + i * 0.0005::DOUBLE) / (d0 + i * 0.0005::DOUBLE))) / se, 2)) AS chi2, count(*) AS k FROM es, range(20001) g(i) GROUP BY 1, 2),
    mn AS (SELECT w, min(chi2) AS c, arg_min(i, chi2) AS best, max(chi2) FILTER (i = 0) AS zero, max(k) AS k FROM cv GROUP BY w)
    SELECT w, round(best * 0.0005::DOUBLE, 6) AS ell, round(min(i) * 0.0005::DOUBLE, 6) AS ell_low, round(max(i) * 0.0005::DOUBLE, 6) AS ell_high, round(c, 6) AS chi2_min, round(zero, 6) AS chi2_zero, mn.k
    FROM cv JOIN mn USING (w) WHERE chi2 <= c + 3.84 GROUP BY ALL"""


def _floors(spark, sf):
    s = slopes(spark, sf)
    early = F.col("event_type") < "m"
    e = s.select(
        "w", (-F.abs("b") / (F.abs("b") + F.col("se"))).alias("b"), (0.1 + F.col("se")).alias("se"),
        F.when(early, 1.5).otherwise(0.75).alias("dt_pre"), F.when(early, 0.75).otherwise(0.45).alias("dt_post"))
    return es.latency_floor(e, ["w"])


@query("latency_floor_grid", FLOOR_SQL)
def latency_floor_grid(spark, sf):
    return rounded(_floors(spark, sf))


@query("next_halving")
def next_halving(spark, sf):
    return rounded(es.next_halving(_floors(spark, sf), 0.45))


@query("loglog_slope", with_parts("SELECT pool, round(regr_slope(ln(overshoot_bps), ln(sigma_ps)), 6) AS slope, count(*) AS n FROM pn WHERE overshoot_bps > 0 AND sigma_ps > 0 GROUP BY pool", "pn"))
def loglog_slope(spark, sf):
    return rounded(es.loglog_slope(m.panel(spark, sf), ["pool"], "sigma_ps", "overshoot_bps"))


@query("chained_levels", SLOPES.replace(", sl", "WITH sl", 1) + "SELECT event_type, round(exp(sum(b) OVER o), 6) AS level, round(sqrt(sum(se * se) OVER o), 6) AS log_level_se FROM sl WHERE w = 1 WINDOW o AS (ORDER BY event_type)")
def chained_levels(spark, sf):
    return rounded(es.chained_levels(slopes(spark, sf).filter("w = 1"), "event_type").select("event_type", "level", "log_level_se"))


# ------------------------------------------------------------------------------------------------------------ panel tables
@query("shifted_self_join", with_parts("""
    SELECT a.pool, a.hour_ms, round(a.volume, 6) AS volume_pre, round(b.volume, 6) AS volume_post FROM pn a JOIN pn b ON a.pool = b.pool AND b.hour_ms = a.hour_ms + 1209600000 WHERE a.post = 0 AND b.post = 1""", "pn"))
def shifted_self_join(spark, sf):
    return rounded(pn.shifted_pairs(m.panel(spark, sf), 14, ["volume"]))


@query("ttest_1samp", with_parts("""
    , pr AS (SELECT a.pool, v.metric, ln(v.b / v.a) AS lr FROM pn a JOIN pn b ON a.pool = b.pool AND b.hour_ms = a.hour_ms + 1209600000 AND a.post = 0 AND b.post = 1,
             LATERAL (VALUES ('volume', a.volume, b.volume), ('n_arb', a.n_arb, b.n_arb), ('sigma_ps', a.sigma_ps, b.sigma_ps)) v(metric, a, b) WHERE v.a > 0 AND v.b > 0)
    SELECT pool, metric, count(*) AS n, round(exp(quantile_cont(lr, 0.5)), 6) AS median_ratio, round(avg(lr), 6) AS mean_log_ratio, round(avg(lr) / (stddev_samp(lr) / sqrt(count(*))), 6) AS t_stat FROM pr GROUP BY 1, 2 HAVING count(*) >= 20""", "pn"))
def ttest_matched(spark, sf):
    pairs = pn.shifted_pairs(m.panel(spark, sf), 14, ["volume", "n_arb", "sigma_ps"])
    return rounded(pn.matched_changes(pairs, ["volume", "n_arb", "sigma_ps"]))


@query("ttest_net_of_variance", with_parts("""
    , pr AS (SELECT a.pool, ln(b.arb_loss / a.arb_loss) - 2 * ln(b.sigma_ps / a.sigma_ps) AS lr FROM pn a JOIN pn b ON a.pool = b.pool AND b.hour_ms = a.hour_ms + 1209600000 AND a.post = 0 AND b.post = 1
             WHERE a.arb_loss > 0 AND b.arb_loss > 0 AND a.sigma_ps > 0 AND b.sigma_ps > 0)
    SELECT pool, 'arb_loss_net' AS metric, count(*) AS n, round(exp(quantile_cont(lr, 0.5)), 6) AS median_ratio, round(avg(lr), 6) AS mean_log_ratio, round(avg(lr) / (stddev_samp(lr) / sqrt(count(*))), 6) AS t_stat FROM pr GROUP BY 1 HAVING count(*) >= 20""", "pn"))
def ttest_net_of_variance(spark, sf):
    pairs = pn.shifted_pairs(m.panel(spark, sf), 14, ["arb_loss", "sigma_ps"])
    return rounded(pn.matched_changes(pairs, [], net_of={"arb_loss_net": ("arb_loss", "sigma_ps", 2.0)}))


@query("ttest_pvalues")
def ttest_pvalues(spark, sf):
    pairs = pn.shifted_pairs(m.panel(spark, sf), 14, ["volume", "n_arb", "sigma_ps"])
    return rounded(es.matched_pvalues(pn.matched_changes(pairs, ["volume", "n_arb", "sigma_ps"])))


PRT = "volume_per_hour arbs_per_hour median_arb_size arb_loss_per_hour arb_loss_bps arb_loss_over_fee lp_net_bps arb_profit_per_hour overshoot_bps overshoot_strict_bps sigma_ps_bps exposure share_swaps_outside_band arb_profit_rate_over_sigma3 loss_rate_over_sigma2"
m.PARTS["pt2"] = (("pn",), """
    SELECT pool, post, count(*) AS hours, CAST(sum(swaps) AS BIGINT) AS swaps, sum(volume) / count(*) AS volume_per_hour, sum(n_arb) / count(*)::DOUBLE AS arbs_per_hour, quantile_cont(median_arb_size, 0.5) AS median_arb_size,
           sum(arb_loss) / count(*) AS arb_loss_per_hour, 10000 * sum(arb_loss) / sum(volume) AS arb_loss_bps, sum(arb_loss) / sum(fee_income) AS arb_loss_over_fee, 10000 * sum(lp_gain) / sum(volume) AS lp_net_bps,
           sum(arb_profit) / count(*) AS arb_profit_per_hour, sum(coalesce(overshoot_bps, 0) * n_arb) / sum(n_arb) AS overshoot_bps, sum(coalesce(overshoot_strict_bps, 0) * n_arb_strict) / sum(n_arb_strict) AS overshoot_strict_bps,
           10000 * sqrt(sum(rv) / (count(*) * 3600)) AS sigma_ps_bps, sqrt(sum(rv) / (count(*) * 3600)) * sqrt(max(dt)) / max(fee) AS exposure, sum(coalesce(share_swaps_outside, 0) * swaps) / sum(swaps) AS share_swaps_outside_band,
           sum(arb_profit) / count(*) / power(sqrt(sum(rv) / (count(*) * 3600)), 3) AS arb_profit_rate_over_sigma3, sum(arb_loss) / count(*) / power(sqrt(sum(rv) / (count(*) * 3600)), 2) AS loss_rate_over_sigma2
    FROM pn GROUP BY 1, 2""")


@query("panel_regime_table", with_parts(f"SELECT pool, post, hours, swaps, {sql_round(PRT, 4)} FROM pt2", "pt2"))
def panel_regime_table(spark, sf):
    return rounded(pn.panel_regime_table(m.panel(spark, sf)), 4)


@query("panel_regime_ratios", with_parts(f"""
    SELECT pool, lower(statistic) AS statistic, round(max(v) FILTER (post = 0), 4) AS pre, round(max(v) FILTER (post = 1), 4) AS post, round(max(v) FILTER (post = 1) / nullif(max(v) FILTER (post = 0), 0), 6) AS post_over_pre
    FROM (SELECT pool, post, hours::DOUBLE AS hours, swaps::DOUBLE AS swaps, {', '.join(PRT.split())} FROM pt2) UNPIVOT (v FOR statistic IN (hours, swaps, {', '.join(PRT.split())})) GROUP BY 1, 2""", "pt2"))
def panel_regime_ratios(spark, sf):
    t = pn.regime_ratios(pn.panel_regime_table(m.panel(spark, sf)), ["pool"])
    return t.select("pool", "statistic", *[F.round(F.col(c) + 0.0137 * 10.0**-d, d).alias(c) for c, d in (("pre", 4), ("post", 4), ("post_over_pre", 6))])


@query("lp_levels", with_parts("""
    SELECT pool, """ + ", ".join(f"round((sum(fee_income) FILTER (post = {i}) - sum(lp_gain) FILTER (post = {i})) / sum(fee_income) FILTER (post = {i}), 6) AS {r}_loss_fee_0, round((sum(fee_income) FILTER (post = {i}) - sum(markout_30s) FILTER (post = {i})) / sum(fee_income) FILTER (post = {i}), 6) AS {r}_loss_fee_30, round(sum(n_arb) FILTER (post = {i}) / (sum(swaps) FILTER (post = {i}))::DOUBLE, 6) AS {r}_arb_share" for i, r in ((0, "pre"), (1, "post"))) + " FROM pn GROUP BY pool", "pn"))
def lp_levels(spark, sf):
    return rounded(pn.lp_levels(m.panel(spark, sf)))


m.PARTS["pp"] = (("pn",), """
    SELECT a.hour_ms, a.post, a.volume, b.volume AS volume_2, a.volume / (a.volume + b.volume) AS vshare, a.liq_mean / (a.liq_mean + b.liq_mean) AS lshare, ln(a.volume / b.volume) AS lv, ln(a.liq_mean / b.liq_mean) AS ll
    FROM pn a JOIN pn b USING (hour_ms) WHERE a.pool = 'click' AND b.pool = 'purchase' AND a.volume > 0 AND b.volume > 0 AND a.liq_mean > 0 AND b.liq_mean > 0 AND a.sigma_ps > 0""")


@query("pair_pools_by_hour", with_parts(f"SELECT hour_ms, post, {sql_round('vshare lshare lv ll')} FROM pp", "pp"))
def pair_pools_by_hour(spark, sf):
    return rounded(pn.pool_pairs(m.panel(spark, sf), "click", "purchase").select("hour_ms", "post", "vshare", "lshare", "lv", "ll"))


@query("fee_tier_shares", with_parts("SELECT post, round(sum(volume) / (sum(volume) + sum(volume_2)), 6) AS volume_share, round(avg(lshare), 6) AS liquidity_share FROM pp GROUP BY post", "pp"))
def fee_tier_shares(spark, sf):
    return rounded(pn.fee_tier_shares(pn.pool_pairs(m.panel(spark, sf), "click", "purchase")))


@query("daily_normalised", with_parts("""
    SELECT pool, day, round(profit, 6) AS profit, round(loss, 6) AS loss, round(vol, 6) AS vol, round(rv, 6) AS rv, n, round(profit / (power(sqrt(rv / 86400), 3) * 1e12), 8) AS profit_over_sigma3, round(sqrt(rv / 86400) * 10000, 6) AS sigma_bps
    FROM (SELECT pool, day, sum(arb_profit) AS profit, sum(arb_loss) AS loss, sum(volume) AS vol, sum(rv) AS rv, count(*) AS n FROM pn GROUP BY 1, 2) WHERE n >= 20""", "pn"))
def daily_normalised(spark, sf):
    t = pn.daily_normalised(m.panel(spark, sf))
    return t.select("pool", "day", "n", *[F.round(F.col(c) + 0.0137 * 10.0**-d, d).alias(c) for c, d in (("profit", 6), ("loss", 6), ("vol", 6), ("rv", 6), ("profit_over_sigma3", 8), ("sigma_bps", 6))])


@query("sigma_path", with_parts("""
    , dy AS (SELECT pool, CAST(floor(t_days) AS INTEGER) AS d, avg(sigma_ps) AS sigma, sum(volume) AS volume, sum(arb_loss) AS loss, sum(arb_profit) AS profit FROM pn GROUP BY 1, 2)
    SELECT pool, w AS "window", """ + ", ".join(f"round(avg({c}) FILTER (d >= 0) / avg({c}) FILTER (d < 0), 6) AS {c}_ratio" for c in ("sigma", "volume", "loss", "profit")) + " FROM dy, (VALUES (7), (14), (30)) v(w) WHERE d >= -w AND d < w GROUP BY 1, 2", "pn"))
def sigma_path(spark, sf):
    return rounded(pn.sigma_path(m.panel(spark, sf)))


@query("descriptives", with_parts("""
    SELECT pool, post, count(*) AS hours, round(avg(swaps), 6) AS swaps_per_hour, round(avg(volume), 6) AS volume_per_hour, round(avg(n_arb), 6) AS arbs_per_hour, round(avg(n_arb_strict), 6) AS strict_per_hour,
           round(avg(overshoot_strict_bps), 6) AS overshoot_strict, round(avg(overshoot_bps), 6) AS overshoot_all, round(avg(arb_profit), 6) AS profit_per_hour, round(avg(arb_loss), 6) AS loss_per_hour, round(avg(sigma_ps), 6) AS sigma,
           round(avg(liq_mean), 6) AS liquidity, round(avg(overshoot_strict_bps / (nullif(sigma_ps, 0) * 10000)), 6) AS overshoot_over_sigma, round(quantile_cont(loss_per_arb, 0.5), 6) AS median_loss_per_arb, round(quantile_cont(sigma_ps, 0.5), 6) AS median_sigma
    FROM pn GROUP BY 1, 2""", "pn"))
def descriptives(spark, sf):
    return rounded(es.descriptives(m.panel(spark, sf)))


@query("exposure_table", with_parts("""
    SELECT pool, fee, round(sigma_pre, 8) AS sigma_pre, round(sigma_pre * sqrt(dt) / fee, 8) AS exposure, round(arb_share, 8) AS arb_share FROM (
      SELECT pool, max(fee) AS fee, sqrt(sum(rv) FILTER (post = 0) / (count(*) FILTER (post = 0) * 3600)) AS sigma_pre, max(dt) FILTER (post = 0) AS dt, sum(n_arb) / sum(swaps)::DOUBLE AS arb_share FROM pn GROUP BY pool)""", "pn"))
def exposure_table(spark, sf):
    t = es.exposure(m.panel(spark, sf))
    return t.select("pool", "fee", *[F.round(F.col(c) + 0.0137e-8, 8).alias(c) for c in ("sigma_pre", "exposure", "arb_share")])


@query("levels_two_refs", with_parts("""
    SELECT pool, post, statistic, round(a, 4) AS first, round(b, 4) AS second, round(b / nullif(a, 0), 6) AS ratio FROM (
      SELECT pool, post, statistic, max(v) FILTER (s = 0) AS a, max(v) FILTER (s = 1) AS b FROM (
        SELECT 0 AS s, pool, post, avg(overshoot_bps) AS overshoot, avg(mean_abs_dev_pre) AS deviation, sum(arb_profit) AS profit FROM pn GROUP BY 2, 3
        UNION ALL SELECT 1, pool, post, avg(overshoot_bps), avg(mean_abs_dev_pre), sum(arb_profit) FROM pn1 GROUP BY 2, 3) UNPIVOT (v FOR statistic IN (overshoot, deviation, profit)) GROUP BY 1, 2, 3)""", "pn", "pn1"))
def levels_two_refs(spark, sf):
    level = lambda p: p.groupBy("pool", "post").agg(F.avg("overshoot_bps").alias("overshoot"), F.avg("mean_abs_dev_pre").alias("deviation"), F.sum("arb_profit").alias("profit"))
    t = es.levels_two_references(level(m.panel(spark, sf)), level(m.panel(spark, sf, lag_ms=3_600_000)), ["pool", "post"], ["overshoot", "deviation", "profit"])
    return t.select("pool", "post", "statistic", *[F.round(F.col(c) + 0.0137 * 10.0**-d, d).alias(c) for c, d in (("first", 4), ("second", 4), ("ratio", 6))])


@query("fork_means_ranges", with_parts("SELECT post, " + ", ".join(f"round({f}({c}), 4) AS {c}_{n}" for c in ("arb_loss_bps", "sigma_ps_bps", "overshoot_bps") for n, f in (("mean", "avg"), ("min", "min"), ("max", "max"))) + " FROM pt2 GROUP BY post", "pt2"))
def fork_means_ranges(spark, sf):
    return rounded(es.ranges(pn.panel_regime_table(m.panel(spark, sf)), ["post"], ["arb_loss_bps", "sigma_ps_bps", "overshoot_bps"]), 4)


@query("component_reconstruction", with_parts("""
    SELECT pool, round(sum(weight * coalesce(b, 0)), 6) AS reconstructed, round(sum(CASE WHEN component IN ('cex_jump', 'same_block') THEN 0 ELSE weight * 0.5 * ln(0.75::DOUBLE) END), 6) AS under_law,
           round(sum(CASE WHEN component IN ('cex_jump', 'same_block') THEN weight ELSE 0 END), 6) AS insensitive_share
    FROM (SELECT * FROM (
            SELECT pool, coalesce(sum(jump_bps) FILTER (trigger = 'cex'), 0) / sum(overshoot_bps) AS cex_jump, coalesce(sum(move_bps) FILTER (trigger = 'cex'), 0) / sum(overshoot_bps) AS cex_move,
                   coalesce(sum(overshoot_bps) FILTER (trigger = 'continuation'), 0) / sum(overshoot_bps) AS continuation, coalesce(sum(overshoot_bps) FILTER (trigger = 'same_block'), 0) / sum(overshoot_bps) AS same_block,
                   coalesce(sum(overshoot_bps) FILTER (trigger = 'onchain'), 0) / sum(overshoot_bps) AS onchain FROM sa WHERE regime = 'pre' AND abs(days_from_change) <= 30 GROUP BY pool)
          UNPIVOT (weight FOR component IN (cex_jump, cex_move, continuation, same_block, onchain))) w
    LEFT JOIN (SELECT pool, trigger AS component, ln(avg(overshoot_bps) FILTER (regime = 'post') / avg(overshoot_bps) FILTER (regime = 'pre')) AS b FROM sa GROUP BY 1, 2) USING (pool, component) GROUP BY pool""", "sa"))
def component_reconstruction(spark, sf):
    a = strict_arbs(spark, sf)
    mean = lambda reg: F.avg(F.when(F.col("regime") == reg, F.col("overshoot_bps")))
    responses = a.groupBy("pool", F.col("trigger").alias("component")).agg(F.ln(mean("post") / mean("pre")).alias("b"))
    law = F.lit(0.5) * F.ln(F.lit(0.75))
    return rounded(es.component_reconstruction(rs.component_weights(a, 30), responses, law, ["cex_jump", "same_block"]))


# ----------------------------------------------------------------------------------------------------- latency distributions
STEP, TOP_MS = 60_000, 14_400_000


def _counts(spark, sf):
    a = m.arbs(spark, sf).filter(rs.market_triggered(m.MAX_TAU_MS))
    return latency.counted_intervals(a, ["regime"], "tau_lo_ms", "tau_ms", STEP, TOP_MS)


@query("censored_intervals", with_parts(f"""
    SELECT regime, CAST(lo AS INTEGER) AS lo, CAST(hi AS INTEGER) AS hi, count(*) AS n FROM (
      SELECT regime, least(greatest(tau_lo_ms, 0) // {STEP} + 1, {TOP_MS // STEP + 1}) AS lo, least(greatest(tau_ms, 0) // {STEP} + 1, {TOP_MS // STEP + 1}) AS hi FROM ar WHERE {CEX}) WHERE hi > lo GROUP BY ALL""", "ar"))
def censored_intervals(spark, sf):
    return _counts(spark, sf)


@query("turnbull")
def turnbull(spark, sf):
    return rounded(latency.turnbull(_counts(spark, sf), ["regime"], STEP, TOP_MS))


@query("turnbull_summary")
def turnbull_summary(spark, sf):
    return rounded(latency.mass_summary(latency.turnbull(_counts(spark, sf), ["regime"], STEP, TOP_MS), ["regime"], interval_ms()))


@query("lognormal_interval")
def lognormal_interval(spark, sf):
    a = m.arbs(spark, sf).filter(rs.market_triggered(m.MAX_TAU_MS))
    return rounded(latency.lognormal_fit(a, ["regime"], "tau_lo_ms", "tau_ms"), 4)


@query("grid_losses", with_parts(f"""
    SELECT regime, count(*) AS n, count(*) FILTER (hi <= lo AND lo < {TOP_MS // STEP + 1}) AS within_one_step, count(*) FILTER (hi <= lo AND lo >= {TOP_MS // STEP + 1}) AS beyond_top FROM (
      SELECT regime, least(greatest(tau_lo_ms, 0) // {STEP} + 1, {TOP_MS // STEP + 1}) AS lo, least(greatest(tau_ms, 0) // {STEP} + 1, {TOP_MS // STEP + 1}) AS hi FROM ar WHERE {CEX}) GROUP BY regime""", "ar"))
def grid_losses(spark, sf):
    a = m.arbs(spark, sf).filter(rs.market_triggered(m.MAX_TAU_MS))
    return latency.grid_losses(a, ["regime"], "tau_lo_ms", "tau_ms", STEP, TOP_MS)


@query("fixed_latency_counterfactual", with_parts(f"""
    , ms AS (SELECT regime, least(tau_ms // {STEP}, 200) * {STEP} AS grid_ms, count(*) / sum(count(*)) OVER (PARTITION BY regime) AS mass FROM ar WHERE {CEX} GROUP BY 1, 2)
    SELECT regime, round(sum(mass * root), 6) AS mean_sqrt_s, round(sum(mass * greatest(0, 1 - grid_ms / {float(m.DT_POST_MS * 100)}::DOUBLE)), 6) AS p_first
    FROM (SELECT regime, grid_ms, mass, (SELECT avg(sqrt((ms.grid_ms + (i + 0.5::DOUBLE) / 200 * {m.DT_POST_MS * 100}) / 1000.0::DOUBLE)) FROM range(200) g(i)) AS root FROM ms) GROUP BY regime""", "ar"))
def fixed_latency_counterfactual(spark, sf):
    a = m.arbs(spark, sf).filter(rs.market_triggered(m.MAX_TAU_MS))
    grid = F.least(F.floor(F.col("tau_ms") / STEP), F.lit(200)) * STEP
    n = a.groupBy("regime", grid.cast("bigint").alias("grid_ms")).agg(F.count(F.lit(1)).alias("n"))
    mass = n.join(n.groupBy("regime").agg(F.sum("n").alias("_all")), "regime").withColumn("mass", F.col("n") / F.col("_all"))
    return rounded(latency.fixed_latency_counterfactual(mass, ["regime"], F.lit(float(m.DT_POST_MS * 100))))


@query("latency_band", with_parts(f"""
    , ch(dt_pre, dt_post) AS (VALUES (3.0::DOUBLE, 1.5::DOUBLE), (1.5::DOUBLE, 0.75::DOUBLE), (0.75::DOUBLE, 0.45::DOUBLE)),
    fl AS (SELECT pool, round(0.3 + avg(sqrt(tau_ms / 1000.0::DOUBLE)) / 20, 6) AS ell FROM ar WHERE {CEX} GROUP BY pool)
    SELECT pool, ell, round(avg(x), 6) AS ell_mean, round(min(x), 6) AS ell_min, round(max(x), 6) AS ell_max, bool_or(x <= 0.0001 OR x >= 5) AS at_edge FROM (
      SELECT pool, ell, list_reduce(list_prepend(0.0001::DOUBLE, [5.0::DOUBLE / 2 ** i FOR i IN range(1, 50)]),
        lambda x, w: CASE WHEN ((((x + w + dt_post) ** 1.5 - (x + w) ** 1.5) / dt_post / (((x + w + dt_pre) ** 1.5 - (x + w) ** 1.5) / dt_pre)) ** 2 * dt_pre - dt_post)
          / (1 - (((x + w + dt_post) ** 1.5 - (x + w) ** 1.5) / dt_post / (((x + w + dt_pre) ** 1.5 - (x + w) ** 1.5) / dt_pre)) ** 2) < ell THEN x + w ELSE x END) AS x
      FROM fl, ch) GROUP BY pool, ell""", "ar"))
def latency_band(spark, sf):
    a = m.arbs(spark, sf).filter(rs.market_triggered(m.MAX_TAU_MS))
    floors = a.groupBy("pool").agg(F.round(0.3 + F.avg(F.sqrt(F.col("tau_ms") / 1000.0)) / 20, 6).alias("ell"))
    changes = spark.createDataFrame([(3.0, 1.5), (1.5, 0.75), (0.75, 0.45)], "dt_pre double, dt_post double")
    return rounded(latency.latency_band(floors, changes, ["pool"]))


@query("bootstrap_quantile_se")
def bootstrap_quantile_se(spark, sf):
    a = m.arbs(spark, sf).filter(rs.market_triggered(m.MAX_TAU_MS))
    return rounded(latency.bootstrap_intercept_se(a, ["regime"], interval_ms(), 0.5))


@query("estimate_comparison")
def estimate_comparison(spark, sf):
    a = m.arbs(spark, sf)
    stats = rs.response_stats(a, ["pool", "regime"], interval_ms(), m.MAX_TAU_MS)
    implied = rs.implied_effects(stats, ["pool"])
    # On whole milliseconds every opening is counted, and intervals (a minute wide) hold many points. One answered at once lies in (0, 1].
    opened = a.filter(rs.market_triggered(m.MAX_TAU_MS) & (F.col("regime") == "pre")).withColumn("tau_ms", F.greatest("tau_ms", F.lit(1)))
    sets = latency.turnbull_sets(latency.counted_intervals(opened, ["pool"], "tau_lo_ms", "tau_ms", 1, m.MAX_TAU_MS), ["pool"])
    fixed = latency.fixed_latency_counterfactual(latency.points_of_sets(sets, ["pool"], 1), ["pool"], F.lit(float(m.DT_POST_MS)))
    before = stats.filter("regime = 'pre'").select("pool", F.col("mean_sqrt_s").alias("_s0"))
    counterfactual = fixed.join(before, "pool").select("pool", F.ln(F.col("mean_sqrt_s") / F.col("_s0")).alias("counterfactual"), F.col("p_first").alias("p_k1_counterfactual"))
    estimates = fit(m.panel(spark, sf), [es.panel_spec(p, "overshoot_bps", [p]) for p in POOLS]).filter("term = 'post'").withColumnRenamed("model_name", "pool")
    return rounded(es.estimate_comparison(implied, counterfactual, estimates))


@query("information_share")
def information_share(spark, sf):
    from checks.q_swaps import market_series

    s = market_series(spark, sf).filter("p_pool > 0 AND p_cex > 0 AND pool <> 'view'").select(
        "pool", F.when(F.col("ts_ms") < m.CHANGE_MS, "pre").otherwise("post").alias("regime"), "ts_ms", F.ln("p_pool").alias("a"), F.ln("p_cex").alias("b"))
    return rounded(pd_.information_shares(s, ["pool", "regime"], "ts_ms", "a", "b", m.STEP_MS))
