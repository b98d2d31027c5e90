"""Imports every query module so that the registry is complete."""

from checks import q_basics, q_estimates, q_operators, q_response, q_sources, q_streams, q_swaps  # noqa: F401
from checks.registry import ORACLES, QUERIES  # noqa: F401
