"""Row-level operators: live rows, filters, paging, latest-wins, as-of, semi and anti joins, facets."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable
from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def live(df: DataFrame) -> DataFrame:
    """Rows that retention has not deleted."""
    return df.filter(F.col("soft_deleted_at").isNull() & F.col("hard_deleted_at").isNull())


def both(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def day_bounds(start: str | None = None, end: str | None = None) -> tuple[datetime | None, datetime | None]:
    """[start, end) from date-only or ISO bounds in UTC; a date-only end includes its day. start >= end is an error."""
    def one(x: str | None, last: bool) -> datetime | None:
        if not x:
            return None
        if len(x) == 10:
            day = date.fromisoformat(x)
            return datetime(day.year, day.month, day.day) + timedelta(days=1 if last else 0)
        at = datetime.fromisoformat(x.replace("Z", "+00:00"))
        return at.astimezone(tz=None).replace(tzinfo=None) if at.tzinfo and at.utcoffset() else at.replace(tzinfo=None)

    low, high = one(start, False), one(end, True)
    if low and high and low >= high:
        raise ValueError("the range is empty")
    return low, high


def search_filter(
    equal: dict[str, str | None] | None = None, time_col: str = "created_at", start: str | None = None, end: str | None = None,
    text: str | None = None, text_cols: Iterable[str] = (), array_cols: Iterable[str] = (), null_cols: Iterable[str] = (),
) -> Column:
    """A conjunction of what is set: equalities, a half-open time range, a literal substring in any text or array element."""
    low, high = day_bounds(start, end)
    parts = [F.col(c) == v for c, v in (equal or {}).items() if v not in (None, "")]
    parts += [F.col(c).isNull() for c in null_cols]
    parts += [F.col(time_col) >= F.lit(low).cast("timestamp_ntz")] if low else []
    parts += [F.col(time_col) < F.lit(high).cast("timestamp_ntz")] if high else []
    if text:
        wanted = F.lit(text.lower())
        hits = [F.lower(c).contains(wanted) for c in text_cols] + [F.exists(c, lambda e: F.lower(e).contains(wanted)) for c in array_cols]
        parts.append(reduce(lambda a, b: a | b, hits))
    return both(parts)


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that comes last by `order` (all descending)."""
    w = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order))
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def latest_value(df: DataFrame, keys: list[str], value: str, order: list[str], name: str | None = None) -> DataFrame:
    """Only a value of the last row of each key: an aggregate, so it is combined before the shuffle."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(name or value))


def first_row(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def as_of_before(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, order: list[str], value_cols: list[str]) -> DataFrame:
    """left with the value columns of the latest right row strictly before each left row, by one sorted pass per key.

    Both sides are laid in one ordered stream and the last right values are carried forward, so no pairs arise.
    """
    value = F.struct(*(F.col(c) for c in value_cols))
    a = left.select(*keys, F.col(left_ts).alias("_t"), F.lit(0).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType).alias("_v"), F.lit(None).cast("struct<a:int>").alias("_o"))
    b = right.select(*keys, F.col(right_ts).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), value.alias("_v"), F.struct(*(F.col(c) for c in order)).alias("_o"))
    stream = a.drop("_o").withColumn("_o", F.lit(None).cast(b.schema["_o"].dataType)).unionByName(b)
    w = Window.partitionBy(*keys).orderBy("_t", "_side", "_o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = stream.withColumn("_found", F.last("_v", ignorenulls=True).over(w)).filter("_side = 0")
    return carried.select("_row.*", *(F.col(f"_found.{c}").alias(c) for c in value_cols))


def having(df: DataFrame, other: DataFrame, on: list[str] | Column) -> DataFrame:
    return df.join(other, on, "left_semi")


def lacking(df: DataFrame, other: DataFrame, on: list[str] | Column) -> DataFrame:
    return df.join(other, on, "left_anti")


def page(df: DataFrame, order: list[Column], size: int, number: int = 1) -> DataFrame:
    """One page; sizes below 1 count as 1."""
    size = max(1, size)
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def page_after(df: DataFrame, keys: list[str], cursor: tuple | None, size: int, descending: bool = False) -> DataFrame:
    """Keyset paging: rows beyond the cursor in the order of the keys."""
    order = [F.col(k).desc() if descending else F.col(k).asc() for k in keys]
    if cursor is not None:
        here, there = F.struct(*(F.col(k) for k in keys)), F.struct(*(F.lit(v).cast(df.schema[k].dataType).alias(k) for k, v in zip(keys, cursor)))
        df = df.filter(here < there if descending else here > there)
    return df.orderBy(*order).limit(size)


def pages(count: Column, size: int, least: int = 0) -> Column:
    return F.greatest(F.ceil(count / size), F.lit(least)).cast("long")


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, key, n) of several columns in one scan, by grouping sets; the whole is facet 'all'."""
    grouped = df.select(*columns).groupingSets([[], *([F.col(c)] for c in columns)], *(F.col(c) for c in columns)).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    n = len(columns)
    bit = {c: (1 << n) - 1 - (1 << (n - 1 - i)) for i, c in enumerate(columns)}
    facet = reduce(lambda acc, c: F.when(F.col("g") == bit[c], c).otherwise(acc), columns, F.lit("all"))
    key = reduce(lambda acc, c: F.when(F.col("g") == bit[c], F.col(c).cast("string")).otherwise(acc), columns, F.lit(None).cast("string"))
    return grouped.select(facet.alias("facet"), key.alias("key"), "n")


def counts(df: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def covered_by(spans: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """spans with `covered`: whether one of the others of the same key contains the whole of start to end (inclusive bounds).

    A sweep line: both sides in one order by start, with the furthest end of the others so far. No pairs are made.
    """
    both_ = spans.withColumn("_other", F.lit(False)).unionByName(others.select(*keys, "start", "end").withColumn("_other", F.lit(True)), allowMissingColumns=True)
    sweep = Window.partitionBy(*keys).orderBy("start", F.desc("_other")).rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max(F.when(F.col("_other"), F.col("end"))).over(sweep)
    return both_.withColumn("covered", F.coalesce(reach >= F.col("end"), F.lit(False))).filter("NOT _other").drop("_other")


def rollup(spark: SparkSession, parts: dict[str, tuple[str, Callable[[], DataFrame]]]) -> DataFrame:
    """One row with a column for each part: name -> (type, function of a one-row, one-column DataFrame).

    A part whose source can't be read or whose query fails is null; the others stand. Each part is one scalar.
    """
    values = {}
    for name, (kind, make) in parts.items():
        try:
            values[name] = F.lit(make().first()[0]).cast(kind)
        except Exception as e:  # whatever the source says; the roll-up is there to show it
            logging.getLogger(__name__).warning("%s is unknown: %s", name, str(e).splitlines()[0])
            values[name] = F.lit(None).cast(kind)
    return spark.range(1).select(*(v.alias(k) for k, v in values.items()))
