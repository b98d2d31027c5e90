"""Exchange-event analytics on PySpark.

Swap logs, block tables and reference price ticks go in; per-trade metrics, hourly panels, reconstructed openings,
operator graphs and before/after estimates come out. Everything is DataFrame work planned by Catalyst.
"""
