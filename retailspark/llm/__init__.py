"""Operators for training-data pipelines (search, sharding, tokens, dedup, packing).

Nothing outside this subpackage imports it.  Each module holds one operator
with its general interface; ``queries.py`` derives the registered queries.
"""
