"""Operators for preparing training text, one module each.

Nothing outside this folder imports it.  ``queries.py`` registers the queries
that apply the operators to the given tables.
"""
