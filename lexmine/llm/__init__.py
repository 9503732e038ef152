"""Operators of a training-data pipeline: scoring, fingerprints, near duplicates, mixing, packing, archives.

Nothing outside this subpackage imports it.  ``queries.REGISTRY`` holds the registered queries and
``queries.ORACLE_SQL`` their DuckDB statements.
"""
