"""Where queries are registered: id -> (function of Tables, SQL or None)."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .standins import NOW, WITH, Tables

Query = Callable[[Tables], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; its SQL may name the stand-ins and given tables."""
    def keep(fn: Query) -> Query:
        if name in REGISTRY:
            raise ValueError(f"{name} is registered twice")
        REGISTRY[name] = (fn, None if sql is None else f"{WITH}\n{sql}")
        return fn

    return keep


def at(text: str = NOW) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def hmac_sql(secret: bytes, message: str) -> str:
    """HMAC-SHA-256 of a blob in SQL, in hex."""
    key = secret.ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in key).hex() for pad in (0x36, 0x5C))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || {message})))"


#: Rows that a Python worker gets at once, at most: whole texts, which it holds in several forms.
BATCH = 500
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _run(fn: Query, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query with batches of BATCH rows; Spark reads that setting when it plans, so it stays set for the session. A smaller one is kept."""
    rows = int(spark.conf.get(_ROWS))
    if not 0 < rows <= BATCH:
        spark.conf.set(_ROWS, BATCH)
    return fn(Tables(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: functools.partial(_run, fn) for name, (fn, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql is not None}
