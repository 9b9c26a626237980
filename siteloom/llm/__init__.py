"""Operators for preparing training corpora.

Nothing outside this subpackage imports it. `queries.py` holds the registered
queries and their SQL; the other modules hold one operator each.
"""
