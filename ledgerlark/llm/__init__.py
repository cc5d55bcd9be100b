"""Operators of a training-data pipeline.

Nothing else in the library imports this package. ``queries.QUERIES`` and
``oracle.ORACLE`` hold its registered queries and their SQL.
"""
