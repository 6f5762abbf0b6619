"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it; see ``queries.py`` for the
registered queries and ``README.md`` for measured figures.
"""
