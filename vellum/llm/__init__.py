"""Operators for preparing training data: near-duplicate joins, scans, filters, mixing.

Each module holds one operator with its own general interface; ``queries`` registers the thin
``opN_*`` queries.  Nothing outside this package imports it.
"""
