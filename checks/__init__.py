"""Registered queries: the library run on the test tables, next to equivalent SQL."""
