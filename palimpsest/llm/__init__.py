"""Operators for large text corpora: counting, filtering, mixing, sharding.

Nothing else in the library imports this subpackage; ``queries`` holds the
registered queries and their SQL.
"""
