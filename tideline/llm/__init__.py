"""Training-data operators: mixing, language and quality models, secret scans, duplicates, archives, packing, token counts.

Nothing outside this package imports it. Each module is one operator with a general interface; ``queries`` applies them to
the test tables.
"""
