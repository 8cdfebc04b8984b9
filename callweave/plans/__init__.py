"""Registered queries: the operators applied to the given tables, each with its SQL where SQL can say it."""

from . import flows, guards, keys, operations, reads, records, scalars, streams, texts, writes
from .registry import oracle_sql, queries

__all__ = ["flows", "guards", "keys", "operations", "oracle_sql", "queries", "reads", "records", "scalars", "streams", "texts", "writes"]
