"""Rounding for comparison with another engine, whose sums run in another order.

A small shift comes first on both sides: averages of two-decimal inputs often end exactly in a 5, and a last-bit
difference would then round to different sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

SHIFT = 0.0137


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    shift = F.lit(SHIFT * 10.0**-digits)
    return df.select(*[F.round(F.col(n) + shift, digits).alias(n) if t in ("double", "float") else F.col(n) for n, t in df.dtypes])


def sql_round(columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns.split())


def shifted_sql(sql: str) -> str:
    """Adds the shift inside every ``round(expression, digits)`` of a query text."""
    out, at = [], 0
    while (start := sql.find("round(", at)) >= 0:
        depth, stop = 0, start + 5
        while True:
            depth += {"(": 1, ")": -1}.get(sql[stop], 0)
            if depth == 0:
                break
            stop += 1
        expression, digits = sql[start + 6 : stop].rsplit(",", 1)
        out += [sql[at:start], f"round({expression} + {SHIFT * 10.0 ** -int(digits):.6e}, {digits.strip()})"]
        at = stop + 1
    return "".join(out) + sql[at:]
