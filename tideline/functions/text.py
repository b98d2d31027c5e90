"""Small parsers: printed estimates, path tokens, JSON properties, significance marks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Printed-cell layout "b*** (se)", possibly with a Unicode minus, and the significance levels.
CELL_PATTERN = r"([-+]?[0-9.]+)\**\s*\(([0-9.]+)\)"
SIGNIFICANCE = ((0.01, "***"), (0.05, "**"), (0.1, "*"))


def estimate_of(cell: Column) -> Column:
    return _cell_part(cell, 1)


def stderr_of(cell: Column) -> Column:
    return _cell_part(cell, 2)


def _cell_part(cell: Column, part: int) -> Column:
    text = F.regexp_extract(F.translate(cell, "−", "-"), CELL_PATTERN, part)
    return F.when(text != "", text.cast("double"))


def stars(p: Column) -> Column:
    mark = None
    for level, text in SIGNIFICANCE:
        mark = F.when(p < level, text) if mark is None else mark.when(p < level, text)
    return mark.otherwise("")


def path_parts(path: Column) -> tuple[Column, Column, Column]:
    """(pool, first block, last block) from .../<pool>_<first>_<last>.<ext>; NULL where the name differs."""
    pattern = r"([^/]+)_(\d+)_(\d+)\.[a-z]+$"
    pool = F.regexp_extract(path, pattern, 1)
    first, last = F.regexp_extract(path, pattern, 2), F.regexp_extract(path, pattern, 3)
    return F.nullif(pool, F.lit("")), F.nullif(first, F.lit("")).cast("bigint"), F.nullif(last, F.lit("")).cast("bigint")


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)\.[a-z0-9]+$", 1)
