"""Structured Streaming twins of the batch operators.

Windowed aggregates keep Spark's own keyed state. Operators that need the row before (previous price, change point,
as-of) run the batch operator on every micro-batch next to a small carried table, so a hot pool is still cut into
slices instead of living in one state partition.
"""
