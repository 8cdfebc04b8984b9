"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import fresh_path
from ..spread import spread

#: Fixed by the result contracts: what separates words, as a Java/RE2/Python character class body.
WORD_BREAKS = r"\x20\x09-\x0D"


#: Spark drops a write's shuffle files as soon as the write is done: the table has made them needless.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; one of a few partitions is dealt over all cores, as every row costs work."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def unused(df: DataFrame, stem: str) -> str:
    """A column name that df does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while stem in taken:
        stem += "_"
    return stem


def without(df: DataFrame, names: Iterable[str]) -> list[str]:
    """The columns of df but those that have one of the names, whatever the case of their letters."""
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with `value` computed once for the row, however often the body names it."""
    return F.transform(F.array(value), body).getItem(0)


def tag_of(text: Column) -> Column:
    """60 bits of the text's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


#: Places that `running` folds at once.
_FOLDED = 1024


def running(values: Column, greatest: bool = False) -> Column:
    """Running sums of an array of numbers that are not negative, or running maxima.

    A fold that appends to an array copies it at every step, so blocks are folded, then the totals of blocks.
    """
    join = F.greatest if greatest else (lambda a, b: a + b)

    def folded(part: Column) -> Column:
        return F.aggregate(part, F.array().cast("array<int>"), lambda done, x: F.array_append(done, join(x, F.coalesce(F.get(done, F.size(done) - 1), F.lit(0)))))

    def whole(blocks: Column) -> Column:
        totals = folded(F.transform(blocks, lambda x: F.coalesce(F.get(x, F.size(x) - 1), F.lit(0))))
        return let(totals, lambda t: F.flatten(F.transform(blocks, lambda x, i: F.transform(x, lambda y: join(y, F.coalesce(F.get(t, i - 1), F.lit(0)))))))

    parts = lambda v: F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / _FOLDED).cast("int")), lambda i: folded(F.slice(v, i * _FOLDED + 1, _FOLDED)))
    return let(let(values, parts), whole)


#: Code points of a block of `in_blocks`.
_BLOCK = 4096


def in_blocks(text: Column) -> Column:
    """The text as an array of blocks, from which `stretch` cuts without walking from the text's start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))


def stretch(blocks: Column, start: Column, end: Column) -> Column:
    """Code points start to end (exclusive) of a text that is given as `in_blocks`."""
    first, last = (F.floor(x / _BLOCK).cast("int") for x in (start, end - 1))
    inside = F.substring(F.get(blocks, first), start - first * _BLOCK + 1, end - start)
    across = F.concat(
        F.substring(F.get(blocks, first), start - first * _BLOCK + 1, F.lit(_BLOCK)),
        F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""),
        F.substring(F.get(blocks, last), F.lit(1), end - last * _BLOCK),
    )
    return F.when(end <= start, F.lit("")).when(first == last, inside).otherwise(across)


def _give_back() -> None:
    """To the system, what this process has freed: Arrow's pool and the C library keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim is not None:
        trim(0)


def tidy(stage: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The stage with its memory given back at the end of each task.

    Spark keeps its Python workers for the tasks of later stages, in which the executor's JVM needs the room.
    """
    @functools.wraps(stage)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from stage(batches)
        _give_back()

    return run


def stored(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: df as a table written in the shared folder and read back.

    A lost executor costs a re-read of shared files, never a recomputation of what led to them.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
