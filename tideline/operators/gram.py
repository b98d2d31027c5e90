"""Least squares from distributed second moments.

One pass over the rows turns every partition into partial sums of w·x·xᵀ per (model, cluster); those are added up by
a groupBy. Cluster scores follow from the same moments, so cluster-robust fits need no second pass. What remains per
model is a K×K problem per cluster count, solved in a grouped function over (clusters × K²) numbers — never rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tideline.functions.tails import chi_square_upper, normal_two_sided, student_two_sided


@dataclass(frozen=True)
class Spec:
    """One model as data: outcome and regressors are expressions over the panel's columns.

    ``terms`` maps a name to an expression; ``effects`` maps a name to (expression, domain) and becomes one dummy per
    domain value but the first; an intercept is added. ``cluster`` is an expression; ``where`` a filter."""

    name: str
    outcome: str
    terms: dict[str, str]
    effects: dict[str, tuple[str, tuple]] = field(default_factory=dict)
    cluster: str = "day"
    where: str = "true"
    weight: str | None = None
    use_t: bool = False
    min_rows: int = 30
    wald: tuple[tuple[str, str], ...] = ()  # pairs of terms whose coefficients are tested for equality, jointly

    def variant(self, **changes) -> "Spec":
        return replace(self, **changes)


def _sql_literal(value) -> str:
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def _numbers(spec: Spec) -> list[str]:
    return ["1.0", *spec.terms.values(), spec.outcome, spec.weight or "1.0"]


def column_names(spec: Spec) -> list[str]:
    """Order of the regressors: intercept, terms, then one dummy per effect level but the first."""
    dummies = [f"{name}={value}" for name, (_, domain) in spec.effects.items() for value in domain[1:]]
    return ["intercept", *spec.terms, *dummies]


def dummy_sizes(specs: list[Spec]) -> list[list[int]]:
    return [[len(domain) for _, domain in s.effects.values()] for s in specs]


def design_rows(df: DataFrame, specs: list[Spec]) -> DataFrame:
    """(model, cluster, x, levels) for all specs: one scan, each row expanded to the models whose filter it passes.

    x is [intercept, terms..., outcome, weight] and ``levels`` the position of each effect's level, so dummies never
    become Catalyst expressions or shuffle width. Effect levels are looked up once per row, however many models use
    them. Rows with a NULL or NaN in x are left out, as in a formula interface."""
    effects: dict[tuple, str] = {}
    for spec in specs:
        for expr, domain in spec.effects.values():
            effects.setdefault((expr, domain), f"_effect{len(effects)}")
    coded = df
    for (expr, domain), name in effects.items():
        levels = ", ".join(_sql_literal(v) for v in domain)
        coded = coded.withColumn(name, F.expr(f"CAST(coalesce(array_position(array({levels}), {expr}), 0) - 1 AS INT)"))
    entries = []
    for i, spec in enumerate(specs):
        vector = F.expr("array(" + ", ".join(f"CAST({n} AS DOUBLE)" for n in _numbers(spec)) + ")")
        clean = ~F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
        levels = F.array(*[F.col(effects[key]) for key in spec.effects.values()]).cast("array<int>")
        cluster = F.expr(f"CAST({spec.cluster} AS STRING)")
        row = F.struct(F.lit(i).alias("model"), cluster.alias("cluster"), vector.alias("x"), levels.alias("levels"))
        entries.append(F.when(F.expr(spec.where) & clean, row))
    exploded = coded.select(F.explode(F.array_compact(F.array(*entries))).alias("_r"))
    return exploded.select("_r.model", "_r.cluster", "_r.x", "_r.levels")


def _matrix(lists) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and row offsets of an Arrow list column."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    offsets = lists.offsets.to_numpy()
    return flat, offsets - offsets[0]


def gram(rows: DataFrame, sizes: list[list[int]] | None = None) -> DataFrame:
    """(model, cluster, i, j, value): sums of w·xᵢ·xⱼ over regressors and outcome (upper triangle), plus the row
    count at i = j = -1. Partitions are reduced with numpy before anything is shuffled; ``sizes`` gives the number of
    levels of each effect per model."""

    def partial(batches):
        totals: dict[tuple[int, str], list] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            flat, offsets = _matrix(batch.column("x"))
            codes, code_offsets = _matrix(batch.column("levels")) if sizes else (None, None)
            keys = pd.DataFrame({"m": batch.column("model").to_pandas(), "c": batch.column("cluster").to_pandas()})
            for (m, c), where in keys.groupby(["m", "c"], sort=False, dropna=False).indices.items():
                width = int(offsets[where[0] + 1] - offsets[where[0]])
                x = flat[offsets[where][:, None] + np.arange(width)[None, :]]
                parts = [x[:, :-2]]
                for e, size in enumerate(sizes[m] if sizes else ()):
                    level = codes[code_offsets[where] + e]
                    parts.append((level[:, None] == np.arange(1, size)[None, :]).astype(float))
                v = np.hstack([*parts, x[:, -2:-1]])
                moment = (v * x[:, -1:]).T @ v
                if (m, c) in totals:
                    totals[m, c][0] += moment
                    totals[m, c][1] += len(where)
                else:
                    totals[m, c] = [moment, len(where)]
        for (m, c), (moment, n) in totals.items():
            i, j = np.triu_indices(len(moment))
            kept = moment[i, j] != 0.0
            i, j = i[kept], j[kept]
            yield pa.RecordBatch.from_pydict(
                {
                    "model": pa.array(np.full(len(i) + 1, m, dtype=np.int32)),
                    "cluster": pa.array([c] * (len(i) + 1), type=pa.string()),
                    "i": pa.array(np.append(i, -1).astype(np.int32)),
                    "j": pa.array(np.append(j, -1).astype(np.int32)),
                    "value": pa.array(np.append(moment[i, j], float(n))),
                }
            )

    partials = rows.mapInArrow(partial, "model int, cluster string, i int, j int, value double")
    return partials.groupBy("model", "cluster", "i", "j").agg(F.sum("value").alias("value"))


COEFFICIENTS = "model int, term string, b double, se double, p double, n bigint, clusters bigint, r2 double, wald_p double"


def _solve_group(specs: list[Spec]):
    plans = [(column_names(s), s.use_t, s.min_rows, s.wald) for s in specs]

    def solve(moments: pd.DataFrame) -> pd.DataFrame:
        model = int(moments["model"].iloc[0])
        names, use_t, min_rows, wald = plans[model]
        k = len(names)
        codes, labels = pd.factorize(moments["cluster"], use_na_sentinel=False)
        counts = np.zeros(len(labels))
        blocks = np.zeros((len(labels), k + 1, k + 1))
        i, j = moments["i"].to_numpy(), moments["j"].to_numpy()
        value = moments["value"].to_numpy()
        is_count = i < 0
        counts[codes[is_count]] = value[is_count]
        c, i, j, value = codes[~is_count], i[~is_count], j[~is_count], value[~is_count]
        blocks[c, i, j] = value
        blocks[c, j, i] = value
        n, g = float(counts.sum()), len(labels)
        total = blocks.sum(axis=0)
        xx, xy, yy = total[:k, :k], total[:k, k], total[k, k]
        # Columns that never vary (an empty effect level, a regime that is absent) cannot be estimated and drop out.
        spread = np.diag(xx) - xx[0] ** 2 / xx[0, 0]
        used = spread > 1e-12 * np.maximum(np.diag(xx), 1e-300)
        used[0] = True
        index = np.flatnonzero(used)
        if n < min_rows:
            return pd.DataFrame(columns=[c.split()[0] for c in COEFFICIENTS.split(", ")])
        a = xx[np.ix_(index, index)]
        scale = 1.0 / np.sqrt(np.diag(a))
        inverse = np.linalg.pinv(a * scale[:, None] * scale[None, :], rcond=1e-11, hermitian=True) * scale[:, None] * scale[None, :]
        beta = inverse @ xy[index]
        rank = int(np.linalg.matrix_rank(a * scale[:, None] * scale[None, :], tol=1e-10, hermitian=True))
        scores = blocks[:, :k, k][:, index] - blocks[:, :k, :k][:, index][:, :, index] @ beta
        meat = scores.T @ scores
        factor = g / max(g - 1.0, 1.0) * (n - 1.0) / max(n - rank, 1.0)
        cov = factor * inverse @ meat @ inverse
        se = np.sqrt(np.maximum(np.diag(cov), 0.0))
        mean_y = xy[0] / xx[0, 0]
        spread_y = yy - xx[0, 0] * mean_y**2
        residual = yy - beta @ xy[index]
        r2 = 1.0 - residual / spread_y if spread_y > 0 else np.nan
        wald_p = np.nan
        if wald:
            place = {names[col]: pos for pos, col in enumerate(index)}
            contrast = np.zeros((len(wald), len(index)))
            for row, (one, other) in enumerate(wald):
                contrast[row, place[one]], contrast[row, place[other]] = 1.0, -1.0
            gap = contrast @ beta
            wald_p = chi_square_upper(float(gap @ np.linalg.solve(contrast @ cov @ contrast.T, gap)), len(wald))
        out = []
        for pos, col in enumerate(index):
            z = beta[pos] / se[pos] if se[pos] > 0 else np.nan
            p = np.nan if np.isnan(z) else (student_two_sided(z, g - 1) if use_t else normal_two_sided(z))
            out.append((model, names[col], beta[pos], se[pos], p, int(n), g, r2, wald_p))
        return pd.DataFrame(out, columns=[c.split()[0] for c in COEFFICIENTS.split(", ")])

    return solve


def fit(df: DataFrame, specs: list[Spec]) -> DataFrame:
    """Coefficient table (model_name, term, b, se, p, n, clusters, r2, wald_p) of every spec, from one scan."""
    moments = gram(design_rows(df, specs), dummy_sizes(specs))
    solved = moments.groupBy("model").applyInPandas(_solve_group(specs), COEFFICIENTS)
    names = df.sparkSession.createDataFrame([(i, s.name) for i, s in enumerate(specs)], "model int, model_name string")
    cleaned = solved.join(F.broadcast(names), "model").drop("model")
    return cleaned.select(
        "model_name", "term", "b", "se", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("p",)], "n", "clusters",
        *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("r2", "wald_p")],
    )


def fitted_column(df: DataFrame, spec: Spec, coefficients: DataFrame) -> DataFrame:
    """Rows passing the spec's filter with ``fitted`` and ``residual``; coefficients travel as one broadcast row
    (K numbers per model, fixed by the spec)."""
    wanted = coefficients.filter(F.col("model_name") == spec.name)
    packed = wanted.agg(F.map_from_entries(F.collect_list(F.struct("term", "b"))).alias("_b"))
    rows = df.filter(F.expr(spec.where)).crossJoin(F.broadcast(packed))
    weight_of = lambda name: F.coalesce(F.try_element_at("_b", name), F.lit(0.0))
    total: Column = weight_of(F.lit("intercept"))
    for name, expr in spec.terms.items():
        total = total + weight_of(F.lit(name)) * F.expr(f"CAST({expr} AS DOUBLE)")
    for name, (expr, _) in spec.effects.items():
        total = total + weight_of(F.expr(f"concat('{name}=', CAST({expr} AS STRING))"))
    return rows.withColumn("fitted", total).withColumn("residual", F.expr(spec.outcome) - F.col("fitted")).drop("_b")
