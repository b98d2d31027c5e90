"""Before/after estimates: model specifications, families of models, and statistics of coefficient tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tideline.functions.tails import chi_square_p, normal_p, student_p
from tideline.operators.gram import Spec, fit, fitted_column
from tideline.operators.quantiles import Quantile, summarise
from tideline.plans.panel import ratio

HOURS = tuple(range(24))
# Fixed value: 95 % point of the chi-square distribution with one degree of freedom, as the interval rule uses it.
PROFILE_DROP = 3.84

LIQUIDITY_CONTROLS = {"log_liq": "ln(liq_mean)", "log_volume": "ln(volume)"}
CONTROL_SETS = {
    "sigma": {},
    "sigma+L+vol": LIQUIDITY_CONTROLS,
    "sigma+L+vol+trend": {**LIQUIDITY_CONTROLS, "t_days": "t_days"},
    "rd": {**LIQUIDITY_CONTROLS, "t_days": "t_days", "post_t": "post * t_days"},
}


def half_open(days: float) -> str:
    return f"t_days >= {-days} AND t_days < {days}"


def positive(columns: list[str]) -> str:
    return " AND ".join(f"{c} > 0" for c in columns)


def clean_positive(panel: DataFrame, outcome: str) -> DataFrame:
    return panel.filter(positive([outcome, "sigma_ps", "liq_mean", "volume"]))


def panel_spec(name: str, outcome: str, pools: list[str] | None = None, controls: str = "sigma", days: float | None = None, log: bool = True, **changes) -> Spec:
    """ln outcome on post and ln volatility with hour-of-day (and, for several pools, pool) effects, clustered by day."""
    extra = CONTROL_SETS[controls]
    needed = [outcome] * log + ["sigma_ps"] + (["liq_mean", "volume"] if extra else [])
    where = positive(needed) + (f" AND {half_open(days)}" if days else "")
    effects: dict[str, tuple[str, tuple]] = {"hod": ("hod", HOURS)}
    if pools and len(pools) > 1:
        effects["pool"] = ("pool", tuple(pools))
    if pools:
        where += " AND pool IN (" + ", ".join(f"'{p}'" for p in pools) + ")"
    terms = {"post": "post", "log_sigma": "ln(sigma_ps)", **extra}
    base = Spec(name, f"ln({outcome})" if log else outcome, terms, effects, "day", where)
    return base.variant(**changes) if changes else base


def without_control(spec: Spec, term: str) -> Spec:
    return spec.variant(terms={k: v for k, v in spec.terms.items() if k != term})


def spec_grid(outcomes: list[str], pools: list[str], windows: list[int], controls: list[str] = ("sigma", "sigma+L+vol", "sigma+L+vol+trend", "rd")) -> list[Spec]:
    """Every outcome, window and control set per pool and pooled; all are estimated from one scan of the panel.

    A control set that contains the outcome is skipped."""
    out = []
    for outcome in outcomes:
        for days in windows:
            for control in controls:
                if f"ln({outcome})" in CONTROL_SETS[control].values():
                    continue
                out += [panel_spec(f"{outcome}|{days}|{control}|{p}", outcome, [p], control, days) for p in pools]
                out.append(panel_spec(f"{outcome}|{days}|{control}|POOLED", outcome, pools, control, days))
    return out


def split_names(coefficients: DataFrame, parts: list[str]) -> DataFrame:
    """Real key columns from the bar-joined model name."""
    pieces = F.split("model_name", r"\|")
    return coefficients.select(*[pieces[i].alias(p) for i, p in enumerate(parts)], *[c for c in coefficients.columns if c != "model_name"])


def placebo(spec: Spec, midpoint_days: float) -> Spec:
    """Same specification on the period before the change, with a false change at ``midpoint_days`` (negative)."""
    fake = f"(CASE WHEN t_days >= {midpoint_days} THEN 1 ELSE 0 END)"
    terms = {}
    for name, expr in spec.terms.items():
        if name == "post":
            terms["post"] = fake
        elif name == "t_days":
            terms["t_days"] = f"t_days - ({midpoint_days})"
        elif name == "post_t":
            terms["post_t"] = f"{fake} * (t_days - ({midpoint_days}))"
        else:
            terms[name] = expr
    return spec.variant(name=f"{spec.name}|placebo", terms=terms, where=f"({spec.where}) AND post = 0")


def did_spec(name: str, outcome: str, pools: list[str], days: float = 30) -> Spec:
    """post x treated with trends of each side of the change and of each group on a stacked panel."""
    base = panel_spec(name, outcome, pools, "rd", days)
    return base.variant(terms={**base.terms, "post_treated": "post * treated", "t_treated": "t_days * treated", "post_t_treated": "post * t_days * treated"})


def stacked_spec(name: str, outcome: str, groups: list[str], pools: list[str], controls: dict[str, str], by_group: bool) -> Spec:
    """ln outcome on ln interval across several changes: slopes of volatility per change, change-by-pool effects,
    change-by-day clusters. ``by_group`` lets the elasticity differ and tests equality."""
    in_group = lambda g, expr: f"(CASE WHEN change = '{g}' THEN {expr} ELSE 0.0 END)"
    terms: dict[str, str] = {f"log_dt:{g}": in_group(g, "ln(dt)") for g in groups} if by_group else {"log_dt": "ln(dt)"}
    terms |= {f"log_sigma:{g}": in_group(g, "ln(sigma_ps)") for g in groups}
    for c, expr in controls.items():
        terms |= {f"t:{g}": in_group(g, expr) for g in groups} if c == "t_days" else {c: expr}
    effects = {"hod": ("hod", HOURS), "fp": ("concat(change, ':', pool)", tuple(f"{g}:{p}" for g in groups for p in pools))}
    pairs = tuple((f"log_dt:{a}", f"log_dt:{b}") for a, b in zip(groups, groups[1:])) if by_group else ()
    return Spec(name, f"ln({outcome})", terms, effects, "concat(change, ':', day)", positive([outcome, "sigma_ps", "liq_mean", "volume"]), wald=pairs)


def with_median_flag(panel: DataFrame, by: list[str], column: str, bounded: bool = False) -> DataFrame:
    """Adds ``high`` (above the group's median) and ``log_demeaned`` (log minus the overall mean log).

    Both statistics are aggregates joined back, not windows over a group."""
    medians = summarise(panel, by, [], [Quantile("_median", F.col(column), 0.5)], bounded)
    mean = panel.agg(F.avg(F.ln(column)).alias("_mean"))
    j = panel.join(medians, by).crossJoin(F.broadcast(mean))
    return j.withColumn("high", F.col(column) > F.col("_median")).withColumn("log_demeaned", F.ln(column) - F.col("_mean")).drop("_median", "_mean")


def heterogeneity_specs(name: str, outcome: str, pools: list[str], controls: str = "sigma+L+vol+trend") -> list[Spec]:
    """Does the effect vary with volatility or with the hours 1-8? Needs ``high`` and ``log_demeaned``.

    Each interaction comes with its main effect: ln volatility is a term already, hours have effects of their own, and
    ``high`` is added, so that a level difference between calm and volatile hours can't pass for an interaction."""
    base = panel_spec(name, outcome, pools, controls)
    high = "CAST(high AS INT)"
    extra = {
        "post_log_sigma": {"post_log_sigma": "post * log_demeaned"},
        "post_high": {"post_high": f"post * {high}", "high": high},
        "post_night": {"post_night": "post * (CASE WHEN hod BETWEEN 1 AND 8 THEN 1 ELSE 0 END)"},
    }
    return [base.variant(name=f"{name}|{k}", terms={**base.terms, **more}) for k, more in extra.items()]


def share_spec(name: str, outcome: str, days: float, min_n: int = 5) -> Spec:
    """Linear probability form: a share on post and ln volatility, hours with at least ``min_n`` observations."""
    where = f"abs(t_days) <= {days} AND n >= {min_n} AND sigma_ps > 0"
    return Spec(name, outcome, {"post": "post", "log_sigma": "ln(sigma_ps)"}, {"hod": ("hod", HOURS)}, "day", where, min_rows=60)


def sigma_elasticity_specs(outcomes: dict[str, str], pools: list[str], where: str = "sigma_ps > 0", use_t: bool = False) -> list[Spec]:
    """Coefficient of ln volatility within each regime, without and with volume and liquidity."""
    out = []
    for name, expr in outcomes.items():
        for post, regime in ((0, "pre"), (1, "post")):
            for label, extra in (("none", {}), ("controls", LIQUIDITY_CONTROLS)):
                test = f"({where}) AND post = {post}" + (" AND volume > 0 AND liq_mean > 0" if extra else "")
                effects = {"hod": ("hod", HOURS), "pool": ("pool", tuple(pools))}
                out.append(Spec(f"{name}|{regime}|{label}", expr, {"log_sigma": "ln(sigma_ps)", **extra}, effects, "day", test, use_t=use_t))
    return out


def wedge_specs(outcomes: list[str], pools: list[str]) -> list[Spec]:
    """Does the difference between two references move at the change? Plain, controlled, RD, and with the gap itself."""
    sets = {"plain": {}, "sigma": {"log_sigma": "ln(sigma_ps)"}, "rd": {"log_sigma": "ln(sigma_ps)", **CONTROL_SETS["rd"]}, "gap": {"log_gap": "ln(ref_gap_bps)"}}
    need = {"plain": "true", "sigma": "sigma_ps > 0", "rd": positive(["sigma_ps", "liq_mean", "volume"]), "gap": "ref_gap_bps > 0"}
    effects = {"hod": ("hod", HOURS), "pool": ("pool", tuple(pools))}
    return [Spec(f"{o}|{k}", f"w_{o}", {"post": "post", **extra}, effects, "day", need[k]) for o in outcomes for k, extra in sets.items()]


def fee_tier_specs(outcomes: list[str] = ("lv", "ll")) -> list[Spec]:
    terms = {"post": "post", "log_sigma": "ln(sigma_ps)", "t_days": "t_days", "post_t": "post * t_days"}
    return [Spec(o, o, terms, {"hod": ("hod", HOURS)}, "day", "sigma_ps > 0") for o in outcomes]


def lp_decomposition_specs(pools: list[str], days: float = 30) -> list[Spec]:
    outcomes = ("arb_loss", "arb_loss_arbs", "loss_per_arb", "n_arb", "n_arb_strict", "arb_profit")
    return [panel_spec(o, o, pools, "rd", days) for o in outcomes]


def event_study(panel: DataFrame, spec: Spec, pre_only: bool = False) -> DataFrame:
    """Mean residual by day relative to the change; with ``pre_only`` the model is fitted before the change and used
    to predict after it."""
    fitted = spec.variant(where=f"({spec.where}) AND post = 0") if pre_only else spec
    rows = fitted_column(panel, spec, fit(panel, [fitted])).filter("residual IS NOT NULL")
    return rows.groupBy(F.floor("t_days").cast("int").alias("dayrel")).agg(F.avg("residual").alias("mean_residual"), F.count(F.lit(1)).alias("n"))


def event_study_levels(path: DataFrame) -> DataFrame:
    pre, post = F.when(F.col("dayrel") < 0, F.col("mean_residual")), F.when(F.col("dayrel") >= 0, F.col("mean_residual"))
    return path.agg(F.avg(pre).alias("pre_mean"), F.avg(post).alias("post_mean"))


def exposure(panel: DataFrame) -> DataFrame:
    """Volatility times root interval over the fee before the change, and arbitrages per swap, per pool."""
    pre = lambda c: F.when(F.col("post") == 0, F.col(c))
    t = panel.groupBy("pool").agg(
        F.sqrt(F.sum(pre("rv")) / (F.count_if(F.col("post") == 0) * 3600.0)).alias("sigma_pre"), F.max(pre("dt")).alias("_dt"), F.max("fee").alias("fee"),
        F.try_divide(F.sum("n_arb"), F.sum("swaps")).alias("arb_share"),
    )
    return t.select("pool", "fee", "sigma_pre", (F.col("sigma_pre") * F.sqrt("_dt") / F.col("fee")).alias("exposure"), "arb_share")


# -------------------------------------------------------------------------------- statistics of coefficient tables


def law_and_elasticity(estimates: DataFrame, changes: DataFrame) -> DataFrame:
    """Root-law prediction, elasticity to the interval and share of the law; ``changes``: change, dt_pre, dt_post."""
    j = estimates.join(changes.select("change", "dt_pre", "dt_post"), "change").withColumn("_log", F.ln(F.col("dt_post") / F.col("dt_pre")))
    out = j.withColumn("law", 0.5 * F.col("_log")).withColumn("elasticity", F.col("b") / F.col("_log")).withColumn("share_of_law", F.col("b") / (0.5 * F.col("_log")))
    if "se" in estimates.columns:
        out = out.withColumn("elasticity_se", F.col("se") / F.abs("_log"))
    return out.drop("_log")


def pool_estimates(estimates: DataFrame, by: list[str], against: float = 0.0, p_values: bool = True) -> DataFrame:
    """Inverse-variance mean of b, its error, heterogeneity Q and t against a constant.

    Q = sum(w b^2) - (sum(w b))^2 / sum(w), so one aggregation suffices."""
    w = 1.0 / (F.col("se") * F.col("se"))
    t = estimates.filter("se > 0").groupBy(*by).agg(
        F.count(F.lit(1)).alias("k"), F.sum(w).alias("_w"), F.sum(w * F.col("b")).alias("_wb"), F.sum(w * F.col("b") * F.col("b")).alias("_wbb")
    )
    mean = F.col("_wb") / F.col("_w")
    out = t.select(
        *by, "k", mean.alias("b"), (1.0 / F.sqrt("_w")).alias("se"), F.greatest(F.col("_wbb") - F.col("_wb") * mean, F.lit(0.0)).alias("q"),
        ((mean - against) * F.sqrt("_w")).alias("t"),
    )
    if not p_values:
        return out
    return out.withColumn("q_p", chi_square_p(F.col("q"), F.col("k") - 1)).withColumn("p", normal_p(F.col("t")))


def merge_estimates(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Two coefficient tables side by side on their keys."""
    tagged = lambda df, i: df.select(*keys, *[F.col(c).alias(f"{c}_{i}") for c in ("b", "se")])
    return tagged(first, 1).join(tagged(second, 2), keys)


def difference_test(pairs: DataFrame, scale: float = 1.0, p_values: bool = True) -> DataFrame:
    """d = b2 - scale * b1 with its error, z and p."""
    d = F.col("b_2") - scale * F.col("b_1")
    se = F.sqrt(F.pow("se_2", F.lit(2.0)) + F.pow(scale * F.col("se_1"), F.lit(2.0)))
    out = pairs.withColumn("d", d).withColumn("d_se", se).withColumn("z", F.try_divide(F.col("d"), F.col("d_se")))
    return out.withColumn("p", normal_p(F.col("z"))) if p_values else out


def cluster_t_pvalues(estimates: DataFrame) -> DataFrame:
    """Two-sided p from Student t with clusters - 1 degrees of freedom."""
    t = F.try_divide(F.col("b"), F.col("se"))
    return estimates.withColumn("p_t", student_p(t, F.col("clusters") - 1))


def weighted_line(points: DataFrame, by: list[str], x: str, y: str, weight: str) -> DataFrame:
    """Weighted slope, intercept, slope error, R2, plain correlation and mean absolute error of y against x."""
    w, X, Y = F.col(weight), F.col(x), F.col(y)
    t = points.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(w).alias("sw"), F.sum(w * X).alias("sx"), F.sum(w * Y).alias("sy"), F.sum(w * X * X).alias("sxx"),
        F.sum(w * X * Y).alias("sxy"), F.sum(w * Y * Y).alias("syy"), F.corr(x, y).alias("corr"), F.avg(F.abs(X - Y)).alias("mae"),
    )
    vxx, vxy, vyy = (F.col("sxx") - F.col("sx") * F.col("sx") / F.col("sw"), F.col("sxy") - F.col("sx") * F.col("sy") / F.col("sw"), F.col("syy") - F.col("sy") * F.col("sy") / F.col("sw"))
    slope = vxy / vxx
    rss = vyy - slope * vxy
    return t.select(
        *by, "n", slope.alias("slope"), (F.col("sy") / F.col("sw") - slope * F.col("sx") / F.col("sw")).alias("intercept"),
        F.sqrt(rss / (F.col("n") - 2) / vxx).alias("slope_se"), (1.0 - rss / vyy).alias("r2"), "corr", "mae",
    )


def latency_floor(estimates: DataFrame, by: list[str], top_s: float = 10.0, points: int = 20_001) -> DataFrame:
    """Fixed latency that best explains the estimates: b = half log of (dt_post + l) over (dt_pre + l).

    Least squares on an even grid. The grid is generated inside each estimate row and summed per (group, grid point),
    so nothing is cross-joined; the 95 % interval holds the points within 3.84 of the minimum."""
    step = top_s / (points - 1)
    tried = estimates.select(*by, "b", "se", "dt_pre", "dt_post", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("_i"))
    ell = F.col("_i") * F.lit(step)
    gap = (F.col("b") - 0.5 * F.ln((F.col("dt_post") + ell) / (F.col("dt_pre") + ell))) / F.col("se")
    curve = tried.groupBy(*by, "_i").agg(F.sum(gap * gap).alias("chi2"), F.count(F.lit(1)).alias("k"))
    best = curve.groupBy(*by).agg(
        F.min_by(F.col("_i"), F.struct("chi2", "_i")).alias("_best"), F.min("chi2").alias("chi2_min"), F.max("k").alias("k"),
        F.max(F.when(F.col("_i") == 0, F.col("chi2"))).alias("chi2_zero"),
    )
    inside = (curve.drop("k").join(best, by) if by else curve.drop("k").crossJoin(best)).filter(F.col("chi2") <= F.col("chi2_min") + PROFILE_DROP)
    t = inside.groupBy(*by).agg(
        F.max("_best").alias("_best"), F.max("chi2_min").alias("chi2_min"), F.max("chi2_zero").alias("chi2_zero"), F.max("k").alias("k"), F.min("_i").alias("_lo"), F.max("_i").alias("_hi")
    )
    return t.select(*by, (F.col("_best") * step).alias("ell"), (F.col("_lo") * step).alias("ell_low"), (F.col("_hi") * step).alias("ell_high"), "chi2_min", "chi2_zero", "k")


def next_halving(floors: DataFrame, dt_now: float) -> DataFrame:
    """Predicted effect of halving the interval once more, and the share of the root law that latency leaves."""
    predicted = lambda c: 0.5 * F.ln((dt_now / 2 + F.col(c)) / (dt_now + F.col(c)))
    out = floors.withColumn("next_halving", predicted("ell")).withColumn("floor_relative", F.sqrt(F.col("ell") / (dt_now + F.col("ell"))))
    return out.withColumn("next_halving_low", F.least(predicted("ell_low"), predicted("ell_high"))).withColumn("next_halving_high", F.greatest(predicted("ell_low"), predicted("ell_high")))


def loglog_slope(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    kept = df.filter((F.col(x) > 0) & (F.col(y) > 0))
    return kept.groupBy(*by).agg(F.regr_slope(F.ln(y), F.ln(x)).alias("slope"), F.count(F.lit(1)).alias("n"))


def matched_pvalues(matched: DataFrame) -> DataFrame:
    return matched.withColumn("p", student_p(F.col("t_stat"), F.col("n") - 1))


def chained_levels(estimates: DataFrame, order: str) -> DataFrame:
    """Cumulative level exp(sum b) and error along consecutive changes (a handful of rows by construction)."""
    along = Window.partitionBy(F.lit(1)).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return estimates.select(
        "*", F.exp(F.sum("b").over(along)).alias("level"), F.sqrt(F.sum(F.col("se") * F.col("se")).over(along)).alias("log_level_se")
    )


def component_reconstruction(weights: DataFrame, coefficients: DataFrame, law: Column, insensitive: list[str]) -> DataFrame:
    """Total effect rebuilt from component weights and responses: estimated, under the law, and the insensitive share."""
    j = weights.join(coefficients.select("pool", "component", "b"), ["pool", "component"], "left")
    fixed = F.col("component").isin(insensitive)
    return j.groupBy("pool").agg(
        F.sum(F.col("weight") * F.coalesce("b", F.lit(0.0))).alias("reconstructed"),
        F.sum(F.when(~fixed, F.col("weight") * law).otherwise(0.0)).alias("under_law"),
        F.sum(F.when(fixed, F.col("weight")).otherwise(0.0)).alias("insensitive_share"),
    )


def estimate_comparison(implied: DataFrame, counterfactual: DataFrame, estimates: DataFrame) -> DataFrame:
    """Effect implied by response times, its fixed-latency part, and the regression estimate, per pool."""
    j = implied.join(counterfactual, "pool", "left").join(estimates.select("pool", F.col("b").alias("estimate"), F.col("se").alias("estimate_se")), "pool", "left")
    return j.select(
        "pool", "law", "implied", "counterfactual", (F.col("implied") - F.col("counterfactual")).alias("latency_change"), "estimate", "estimate_se",
        (F.col("implied") - F.col("estimate")).alias("implied_minus_estimate"), "p_k1_post_actual", "p_k1_counterfactual",
    )


def ranges(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Mean, minimum and maximum of each column over the rows of a group."""
    return df.groupBy(*by).agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))])


def levels_two_references(first: DataFrame, second: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """The same regime statistics under two references, long: (by..., statistic, first, second, ratio)."""
    long = lambda df, name: df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(by, columns, "statistic", name)
    j = long(first, "first").join(long(second, "second"), [*by, "statistic"])
    return j.withColumn("ratio", ratio("second", F.nullif("first", F.lit(0.0))))


def descriptives(panel: DataFrame, bounded: bool = False) -> DataFrame:
    """Level statistics per pool and regime, with volatility-adjusted overshoot."""
    t = summarise(
        panel, ["pool", "post"],
        [F.count(F.lit(1)).alias("hours"), F.avg("swaps").alias("swaps_per_hour"), F.avg("volume").alias("volume_per_hour"), F.avg("n_arb").alias("arbs_per_hour"),
         F.avg("n_arb_strict").alias("strict_per_hour"), F.avg("overshoot_strict_bps").alias("overshoot_strict"), F.avg("overshoot_bps").alias("overshoot_all"),
         F.avg("arb_profit").alias("profit_per_hour"), F.avg("arb_loss").alias("loss_per_hour"), F.avg("sigma_ps").alias("sigma"), F.avg("liq_mean").alias("liquidity"),
         F.avg(F.try_divide(F.col("overshoot_strict_bps"), F.col("sigma_ps") * 1e4)).alias("overshoot_over_sigma")],
        [Quantile("median_loss_per_arb", F.col("loss_per_arb"), 0.5), Quantile("median_sigma", F.col("sigma_ps"), 0.5)], bounded,
    )
    return t
