"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage.  Queries and their SQL
counterparts are collected in :mod:`xylem.llm.queries`.
"""
