"""Operators for large training-data pipelines over text tables.

Nothing outside this package imports it; its queries and their SQL are in
``queries``.
"""
