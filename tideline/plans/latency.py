"""Latency distributions from interval-censored response times, and what a fixed latency would imply.

Openings say only that the latency lies in (lower, upper]. For the free distribution both ends are put on a fixed grid and identical intervals
are counted by Spark first, so a group's task sees at most (grid points)^2 / 2 counted intervals, however many rows there are, and
holds a few numbers for each. The log-normal fit keeps the ends as they are and sums its scores in Spark.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tideline.session import cut_lineage

GRID_STEP_MS, GRID_TOP_MS = 10, 10_000
ROUNDS = 20_000
GAP = 1e-6
_SQRT2, _SQRT_TAU = math.sqrt(2), math.sqrt(2 * math.pi)
_erfc = np.frompyfunc(math.erfc, 1, 1)


def _placed(arbs: DataFrame, by: list[str], lower: str, upper: str, step: int, top: int) -> DataFrame:
    points = top // step + 1
    beyond = lambda c: F.least(F.floor(F.greatest(c, F.lit(0)) / F.lit(step)) + 1, F.lit(points)).cast("int")
    return arbs.select(*by, beyond(F.col(lower)).alias("lo"), beyond(F.col(upper)).alias("hi"))


def counted_intervals(arbs: DataFrame, by: list[str], lower: str, upper: str, step: int = GRID_STEP_MS, top: int = GRID_TOP_MS) -> DataFrame:
    """(by..., lo, hi, n): grid points in (lower, upper] run from position lo to hi - 1. Intervals without a grid point
    can't carry mass on the grid; :func:`grid_losses` counts them."""
    return _placed(arbs, by, lower, upper, step, top).filter("hi > lo").groupBy(*by, "lo", "hi").agg(F.count(F.lit(1)).alias("n"))


def grid_losses(arbs: DataFrame, by: list[str], lower: str, upper: str, step: int = GRID_STEP_MS, top: int = GRID_TOP_MS) -> DataFrame:
    """(by..., n, within_one_step, beyond_top): openings, and how many of them no grid point can represent, by reason."""
    points = top // step + 1
    empty = F.col("hi") <= F.col("lo")
    return _placed(arbs, by, lower, upper, step, top).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum((empty & (F.col("lo") < points)).cast("bigint")).alias("within_one_step"),
        F.sum((empty & (F.col("lo") >= points)).cast("bigint")).alias("beyond_top"),
    )


def innermost(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Turnbull's sets: stretches that begin where some interval begins, end where some interval ends, and hold neither
    in between. The maximum likelihood estimate has no mass elsewhere, and its likelihood only knows their totals."""
    begins, ends = np.unique(lo), np.unique(hi)
    first_end = ends[np.searchsorted(ends, begins, side="right")]
    last_begin = begins[np.searchsorted(begins, first_end, side="left") - 1]
    keep = last_begin == begins
    return begins[keep], first_end[keep]


def _isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The rising sequence next to ``values`` in weighted squares: neighbours out of order are pooled."""
    level, weight, size = [], [], []
    for value, w in zip(values.tolist(), weights.tolist(), strict=True):
        k = 1
        while level and level[-1] >= value:
            before = weight.pop()
            value = (value * w + level.pop() * before) / (w + before)
            w += before
            k += size.pop()
        level.append(value)
        weight.append(w)
        size.append(k)
    return np.repeat(level, size)


def maximum_likelihood(lo: np.ndarray, hi: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """(begin, end, mass, converged) of the innermost sets.

    With A the 0/1 matrix (never formed) of which interval covers which set, p its chances and N the number of rows, g = A'(n / Ap) is the
    gradient of the log-likelihood. p * g / N raises the likelihood (expectation-maximisation on sets), and since the
    likelihood is concave over chances that sum to 1, no other choice can exceed the present one by more than
    max(g) - N: that bound is the stop. Where intervals overlap, that step alone takes very many rounds, so each is followed by one on the
    running sums of p: a Newton step with the diagonal of the curvature, put in rising order (iterative convex minorant) and halved until the
    likelihood doesn't fall."""
    begin, end = innermost(lo, hi)
    # Sets are in order, so an interval covers a run of them: Ap is a difference of running sums, and A'w a running sum of differences.
    first, last = np.searchsorted(begin, lo, side="left"), np.searchsorted(end, hi, side="right")
    runs, run = np.unique(first * (len(begin) + 1) + last, return_inverse=True)  # intervals that cover the same sets are one
    first, last, n = runs // (len(begin) + 1), runs % (len(begin) + 1), np.bincount(run, n)
    total, at = n.sum(), len(begin) + 1
    upto = np.linspace(0.0, 1.0, at)
    for _ in range(ROUNDS):
        weight = n / np.maximum(upto[last] - upto[first], 1e-15)
        gradient = np.cumsum(np.bincount(first, weight, at) - np.bincount(last, weight, at))[:-1]
        if gradient.max() - total <= GAP * total:
            return begin, end, np.diff(upto), True
        upto = np.concatenate([[0.0], np.cumsum(np.diff(upto) * np.maximum(gradient, 0.0))])
        upto /= upto[-1]
        chance = np.maximum(upto[last] - upto[first], 1e-15)
        value, weight = n @ np.log(chance), n / chance
        slope = (np.bincount(last, weight, at) - np.bincount(first, weight, at))[1:-1]
        curve = (np.bincount(last, weight / chance, at) + np.bincount(first, weight / chance, at))[1:-1]
        move = np.zeros(at)
        move[1:-1] = np.clip(_isotonic(upto[1:-1] + slope / curve, curve), 0.0, 1.0) - upto[1:-1]
        size = 1.0
        while size > 1e-6:
            tried = upto + size * move
            chance = tried[last] - tried[first]
            if chance.min() > 0 and n @ np.log(chance) >= value:
                upto = tried
                break
            size /= 2
    return begin, end, np.diff(upto), False


def turnbull(counts: DataFrame, by: list[str], step: int = GRID_STEP_MS, top: int = GRID_TOP_MS) -> DataFrame:
    """(by..., grid_ms, mass, converged): non-parametric maximum likelihood, each set's mass spread evenly over its points."""
    points = top // step + 1

    def estimate(pdf: pd.DataFrame) -> pd.DataFrame:
        begin, end, mass, converged = maximum_likelihood(pdf["lo"].to_numpy(), pdf["hi"].to_numpy(), pdf["n"].to_numpy(dtype=float))
        grid = np.zeros(points)
        for b, e, x in zip(begin, end, mass, strict=True):
            grid[b:e] = x / (e - b)
        out = pd.DataFrame({"grid_ms": np.arange(points, dtype=np.int64) * step, "mass": grid, "converged": converged})
        for c in reversed(by):
            out.insert(0, c, pdf[c].iloc[0])
        return out

    keys = ", ".join(f"{name} {kind}" for name, kind in counts.select(*by).dtypes)
    return counts.groupBy(*by).applyInPandas(estimate, f"{keys}, grid_ms bigint, mass double, converged boolean")


def turnbull_sets(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by..., lo, hi, mass, converged): the same estimate, a row per set that holds mass, on grid points lo to hi - 1, however fine the grid."""

    def estimate(pdf: pd.DataFrame) -> pd.DataFrame:
        begin, end, mass, converged = maximum_likelihood(pdf["lo"].to_numpy(), pdf["hi"].to_numpy(), pdf["n"].to_numpy(dtype=float))
        held = mass > 0
        out = pd.DataFrame({"lo": begin[held], "hi": end[held], "mass": mass[held], "converged": converged})
        for c in reversed(by):
            out.insert(0, c, pdf[c].iloc[0])
        return out

    keys = ", ".join(f"{name} {kind}" for name, kind in counts.select(*by).dtypes)
    return counts.groupBy(*by).applyInPandas(estimate, f"{keys}, lo int, hi int, mass double, converged boolean")


def points_of_sets(sets: DataFrame, by: list[str], step: int = GRID_STEP_MS) -> DataFrame:
    """(by..., grid_ms, mass, converged) of :func:`turnbull_sets`: each set's mass spread evenly over its points; points without mass are left out."""
    even = F.col("mass") / (F.col("hi") - F.col("lo"))
    points = F.explode(F.sequence(F.col("lo"), F.col("hi") - 1))
    dealt = sets.repartition(sets.sparkSession.sparkContext.defaultParallelism)  # few rows that hold many points: all tasks get some
    return dealt.select(*by, points.alias("_at"), even.alias("mass"), "converged").select(*by, (F.col("_at").cast("bigint") * step).alias("grid_ms"), "mass", "converged")


def mass_summary(masses: DataFrame, by: list[str], dt_ms: Column) -> DataFrame:
    """Quartiles, mean and mass up to one interval of a latency distribution (a few hundred grid rows per group)."""
    from pyspark.sql import Window

    along = Window.partitionBy(*by).orderBy("grid_ms").rowsBetween(Window.unboundedPreceding, 0)
    c = masses.withColumn("_dt", dt_ms).withColumn("_cdf", F.sum("mass").over(along))
    reached = lambda q: F.min(F.when(F.col("_cdf") >= q - 1e-12, F.col("grid_ms")))
    return c.groupBy(*by).agg(
        reached(0.25).alias("p25"), reached(0.5).alias("median"), reached(0.75).alias("p75"), F.sum(F.col("mass") * F.col("grid_ms")).alias("mean"),
        F.sum(F.when(F.col("grid_ms") <= F.col("_dt"), F.col("mass")).otherwise(0.0)).alias("p_le_dt"),
    )


def fixed_latency_counterfactual(masses: DataFrame, by: list[str], dt_ms: Column, steps: int = 200) -> DataFrame:
    """Mean root response time and first-block share if the latency stayed and only the interval were ``dt_ms``."""
    u = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: (i + 0.5) / steps)
    d = masses.withColumn("_dt", dt_ms)
    root = F.aggregate(u, F.lit(0.0), lambda acc, x: acc + F.sqrt((F.col("grid_ms") + x * F.col("_dt")) / 1000.0)) / steps
    return d.groupBy(*by).agg(
        F.sum(F.col("mass") * root).alias("mean_sqrt_s"),
        F.sum(F.col("mass") * F.greatest(F.lit(0.0), 1 - F.col("grid_ms") / F.col("_dt"))).alias("p_first"),
    )


def _between(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Standard normal chance of (low, high], taken from the tail that both ends share so that small chances keep digits."""
    flip = low > 0
    a, b = np.where(flip, -high, low), np.where(flip, -low, high)
    return 0.5 * (_erfc(-b / _SQRT2) - _erfc(-a / _SQRT2)).astype(float)


def _scored(left: np.ndarray, right: np.ndarray, n: np.ndarray, mu: np.ndarray, log_sigma: np.ndarray) -> np.ndarray:
    """(rows, 6): each row's log-likelihood, its scores in (mu, ln sigma) and their outer product, times n.

    With z the standardised log ends, the chance of an interval has the derivatives (phi(z_left) - phi(z_right)) / sigma and
    z_left phi(z_left) - z_right phi(z_right); the outer products of the scores stand for the information."""
    s = np.exp(log_sigma)
    z0 = np.where(left > 0, (np.log(np.where(left > 0, left, 1.0)) - mu) / s, -np.inf)
    z1 = (np.log(right) - mu) / s
    chance = np.maximum(_between(z0, z1), 1e-300)
    f0, f1 = np.exp(-z0 * z0 / 2) / _SQRT_TAU, np.exp(-z1 * z1 / 2) / _SQRT_TAU
    by_mu, by_sigma = (f0 - f1) / s / chance, (np.where(np.isinf(z0), 0.0, np.where(np.isinf(z0), 0.0, z0) * f0) - z1 * f1) / chance
    return np.stack([np.log(chance), by_mu, by_sigma, by_mu * by_mu, by_mu * by_sigma, by_sigma * by_sigma], 1) * n[:, None]


class _Ascent:
    """Scoring of one group: what to evaluate next, given the sums at the last point. A step is halved until the likelihood rises."""

    def __init__(self, mu: float, log_sigma: float, n: float):
        self.at, self.n = np.array([mu, log_sigma]), n
        self.tried, self.value = self.at, -math.inf
        self.move, self.size, self.steps, self.converged, self.open = np.zeros(2), 1.0, 0, False, True

    def told(self, sums: np.ndarray) -> None:
        if sums[0] < self.value:
            self.size /= 2
            if self.size <= 1e-6:
                self.open = False
            self.tried = self.at + self.size * self.move
            return
        self.at, self.value = self.tried, sums[0]
        gradient, information = sums[1:3], np.array([[sums[3], sums[4]], [sums[4], sums[5]]])
        self.move = np.linalg.solve(information + 1e-9 * np.trace(information) * np.eye(2) + 1e-12 * np.eye(2), gradient)
        self.steps += 1
        self.converged = bool(abs(gradient @ self.move) < 1e-9 * max(1.0, self.n))
        self.open = not self.converged and self.steps <= 200
        self.size = min(1.0, 2.0 / np.abs(self.move).max()) if np.abs(self.move).max() > 0 else 1.0
        self.tried = self.at + self.size * self.move


def fit_lognormal(left: np.ndarray, right: np.ndarray, n: np.ndarray) -> tuple[float, float, bool]:
    """(mu, sigma, converged) of ln latency for counted intervals (left, right] in milliseconds, at least 1 ms wide; one group at hand."""
    left = np.maximum(left, 0.0)
    right = np.maximum(right, left + 1.0)
    middle = np.log((left + right) / 2)
    mu = np.average(middle, weights=n)
    fit = _Ascent(mu, 0.5 * math.log(max(np.average((middle - mu) ** 2, weights=n), 0.01)), n.sum())
    while fit.open:
        fit.told(_scored(left, right, n, *np.broadcast_to(fit.tried[:, None], (2, len(n)))).sum(0))
    return float(fit.at[0]), math.exp(fit.at[1]), fit.converged


def lognormal_fit(arbs: DataFrame, by: list[str], lower: str, upper: str) -> DataFrame:
    """(by..., median_ms, sigma, mean_ms, n, converged): log-normal fitted to all intervals as they are, without a grid.

    Equal intervals are counted and written once. Every scoring step is one aggregation over that table for all groups that are not done:
    partial sums of likelihood, scores and information in each task, added up by group. The driver sees six numbers a group and step."""
    spark = arbs.sparkSession
    left = F.greatest(F.col(lower).cast("double"), F.lit(0.0))
    pairs = arbs.select(*by, left.alias("_l"), F.greatest(F.col(upper).cast("double"), left + 1.0).alias("_r")).filter("_l IS NOT NULL AND _r IS NOT NULL")
    counted = cut_lineage(pairs.groupBy(*by, "_l", "_r").agg(F.count(F.lit(1)).cast("double").alias("_n")))
    middle = F.log((F.col("_l") + F.col("_r")) / 2)
    starts = counted.groupBy(*by).agg(
        F.sum("_n").alias("_n"), (F.sum(middle * F.col("_n")) / F.sum("_n")).alias("_mu"), (F.sum(middle * middle * F.col("_n")) / F.sum("_n")).alias("_sq")
    ).collect()
    fits = [_Ascent(r["_mu"], 0.5 * math.log(max(r["_sq"] - r["_mu"] ** 2, 0.01)), r["_n"]) for r in starts]
    keys = ", ".join(f"{name} {kind}" for name, kind in arbs.select(*by).dtypes)
    out = f"{keys}, median_ms double, sigma double, mean_ms double, n bigint, converged boolean"
    if not starts:
        return spark.createDataFrame([], out)
    numbers = spark.createDataFrame([(*(r[c] for c in by), i) for i, r in enumerate(starts)], f"{keys}, _group int")
    same = functools.reduce(lambda a, b: a & b, (counted[c].eqNullSafe(numbers[c]) for c in by))
    table = cut_lineage(counted.join(numbers, same).select("_group", "_l", "_r", "_n"))
    names = ["_v", "_a", "_b", "_aa", "_ab", "_bb"]
    while any(f.open for f in fits):
        tried = np.array([f.tried for f in fits])
        still = [i for i, f in enumerate(fits) if f.open]

        def partial(batches: Iterable[pd.DataFrame], tried=tried) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                group = pdf["_group"].to_numpy()
                rows = _scored(pdf["_l"].to_numpy(), pdf["_r"].to_numpy(), pdf["_n"].to_numpy(), tried[group, 0], tried[group, 1])
                found = pd.DataFrame(rows, columns=names).groupby(group).sum()
                yield found.rename_axis("_group").reset_index().astype({"_group": "int32"})

        asked = table if len(still) == len(fits) else table.filter(F.col("_group").isin(still))
        sums = asked.mapInPandas(partial, "_group int, " + ", ".join(f"{c} double" for c in names)).groupBy("_group").agg(*[F.sum(c).alias(c) for c in names])
        for r in sums.collect():
            fits[r["_group"]].told(np.array([r[c] for c in names]))
    rows = []
    for r, f in zip(starts, fits, strict=True):
        sigma = math.exp(f.at[1])
        rows.append((*(r[c] for c in by), math.exp(f.at[0]), sigma, math.exp(f.at[0] + sigma * sigma / 2), int(r["_n"]), f.converged))
    return spark.createDataFrame(rows, out)


def latency_band(floors: DataFrame, changes: DataFrame, by: list[str], low_s: float = 1e-4, high_s: float = 5.0, halvings: int = 60) -> DataFrame:
    """Mechanical latencies that a fitted ``ell`` (seconds) stands for, over changes of the interval (dt_pre, dt_post seconds).

    With a latency x and a wait even over dt the mean root response time is m(x, dt) = 2/(3 dt) ((x + dt)^1.5 - x^1.5). The law
    under which ``ell`` was fitted has ((dt_post + ell) / (dt_pre + ell))^0.5 for the ratio of these means, so x implies
    ell = (r dt_pre - dt_post) / (1 - r) with r the squared ratio. That grows with x and is inverted by bisection in each row.
    Returns (by..., ell, ell_mean, ell_min, ell_max, at_edge); at_edge tells that some answer lies outside [low_s, high_s]."""
    told = changes.agg(F.collect_list(F.struct("dt_pre", "dt_post")).alias("_changes"))  # one row with all of the study's changes
    each = floors.crossJoin(F.broadcast(told)).select("*", F.explode("_changes").alias("_change")).select("*", "_change.dt_pre", "_change.dt_post")

    def implied(x: Column) -> Column:
        mean = lambda dt: (F.pow(x + dt, F.lit(1.5)) - F.pow(x, F.lit(1.5))) / dt
        ratio = F.pow(mean(F.col("dt_post")) / mean(F.col("dt_pre")), F.lit(2.0))
        return (ratio * F.col("dt_pre") - F.col("dt_post")) / (1 - ratio)

    def halve(s: Column, _: Column) -> Column:
        mid = (s["low"] + s["high"]) / 2
        below = implied(mid) < F.col("ell")
        return F.struct(F.when(below, mid).otherwise(s["low"]).alias("low"), F.when(below, s["high"]).otherwise(mid).alias("high"))

    bounds = F.struct(F.lit(low_s).alias("low"), F.lit(high_s).alias("high"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(halvings)), bounds, halve)
    edge = (implied(F.lit(low_s)) > F.col("ell")) | (implied(F.lit(high_s)) < F.col("ell"))
    solved = each.select(*by, "ell", ((found["low"] + found["high"]) / 2).alias("_x"), edge.alias("_edge"))
    return solved.groupBy(*by, "ell").agg(F.avg("_x").alias("ell_mean"), F.min("_x").alias("ell_min"), F.max("_x").alias("ell_max"), F.max("_edge").alias("at_edge"))


def bootstrap_intercept_se(arbs: DataFrame, by: list[str], dt_ms: Column, q: float, draws: int = 300, seed: int = 0) -> DataFrame:
    """Spread of a latency intercept over Poisson bootstrap draws.

    Rows are counted per (group, value) before anything is drawn: the weight of a value in a draw is the sum of its rows'
    Poisson(1) weights, that is Poisson(n). What is expanded by draws is the short table of whole-millisecond values."""
    counted = arbs.withColumn("_dt", dt_ms).groupBy(*by, "tau_ms").agg(F.count(F.lit(1)).alias("_n"), F.max("_dt").alias("_dt"))
    drawn = counted.select("*", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("_draw"))
    uniform = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "_draw", "tau_ms", *by), F.lit(1 << 40)) + 0.5) / F.lit(float(1 << 40))
    weighed = drawn.withColumn("_w", _poisson(F.col("_n"), uniform(1), uniform(2))).filter("_w > 0")
    each = weighed.groupBy(*by, "_draw").agg(F.percentile(F.col("tau_ms").cast("double"), F.lit(q), F.col("_w")).alias("_v"), F.max("_dt").alias("_dt"))
    return each.groupBy(*by).agg(F.stddev_pop(F.col("_v") - q * F.col("_dt")).alias("se"), F.count(F.lit(1)).alias("draws"))


def _poisson(mean: Column, first: Column, second: Column) -> Column:
    """Poisson draws: by inversion up to a mean of 20, by a rounded normal (Box-Muller) beyond."""

    def step(s: Column, k: Column) -> Column:
        mass = s["mass"] * mean / k
        return F.struct((s["value"] + F.when(first >= s["upto"], 1).otherwise(0)).alias("value"), (s["upto"] + mass).alias("upto"), mass.alias("mass"))

    start = F.struct(F.lit(0).alias("value"), F.exp(-mean.cast("double")).alias("upto"), F.exp(-mean.cast("double")).alias("mass"))
    small = F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, step)["value"]
    normal = F.sqrt(-2 * F.log(first)) * F.cos(2 * math.pi * second)
    return F.when(mean <= 20, small).otherwise(F.greatest(F.lit(0), F.round(mean + F.sqrt(mean) * normal))).cast("bigint")
