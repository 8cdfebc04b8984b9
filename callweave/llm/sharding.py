"""Sharding by extendible hashing.

A directory maps hash prefixes to shards. It is as deep as the shard count asks for; every entry points to the
shallowest prefix whose documents fit the byte limit, so only oversized buckets split on another bit. Buckets that
still do not fit go on with eight more bits; copies of one row, which no bit of their hash can part, form overflow
pages by a hash of the row's content and its number among its copies, so the result does not depend on partitions.

Built-in expressions only. The documents are read without shuffling texts: their bytes are summed per prefix (combined
before the shuffle, so neither a hot source nor copies matter), and all splitting happens on that histogram, whose size
follows the number of shards, not of documents. Copies are counted, and dealt out again in runs of COPIES. The join with
the directory shuffles ids and sizes, never texts.

Defined cases: null text has 0 bytes; null doc_id hashes by its text; a document that alone exceeds the limit has a
shard to itself; columns beside id and text are not read, so their names don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

KEY_BITS = 60
#: Small, so that small tables split as well; the work grows with the documents and the number of shards alike.
LIMIT_BYTES = 256 << 10
#: Bits of the directory beyond what evenly filled shards need, and bits added where a bucket is still too large.
SPARE, MORE = 4, 8
#: Copies of a row that one task makes at a time.
COPIES = 1 << 16


def hash_bits(value: Column) -> Column:
    """The first 60 bits of the value's MD5, as a long."""
    return F.conv(F.substring(F.md5(value), 1, 15), 16, 10).cast("long")


def _split(rows: DataFrame, limit: int) -> DataFrame:
    """(root, key, n_bytes, ...) with depth and prefix of each row's bucket, under each root by itself."""
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    depth = min(KEY_BITS, max(1, math.ceil(math.log2(max(total / limit, 1)))) + SPARE)
    done: DataFrame | None = None
    while True:
        rows = rows.withColumn("p", F.shiftright("key", KEY_BITS - depth))
        leaves = rows.groupBy("root", "p").agg(F.sum("n_bytes").alias("b"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        leaves = stored(leaves, "shard-histogram")
        ways = leaves.select("*", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("d")).withColumn("q", F.expr(f"shiftright(p, {depth} - d)"))
        nodes = ways.groupBy("root", "d", "q").agg(F.sum("b").alias("b"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        fit = nodes.filter((F.col("b") <= limit) | (F.col("lo") == F.col("hi"))).select("root", "d", "q")
        directory = stored(ways.select("root", "p", "d", "q").join(fit, ["root", "d", "q"]).groupBy("root", "p").agg(F.min("d").alias("depth")), "shard-directory")
        found = rows.join(directory.hint("shuffle_hash"), ["root", "p"], "left").withColumn("prefix", F.expr(f"shiftright(p, {depth} - depth)"))
        if depth >= KEY_BITS or leaves.join(directory, ["root", "p"], "left_anti").isEmpty():
            return found.drop("p") if done is None else done.unionByName(found.drop("p"))
        settled = found.filter(F.col("depth").isNotNull()).drop("p")
        done = settled if done is None else done.unionByName(settled)
        rows = stored(found.filter(F.col("depth").isNull()).drop("p", "depth", "prefix"), "shard-rows")
        depth = min(KEY_BITS, depth + MORE)


def _named(rows: DataFrame) -> Column:
    return F.concat(F.col("root"), F.when(F.col("depth") > 0, F.lpad(F.bin("prefix"), F.col("depth"), F.lit("0"))).otherwise(F.lit("")))


def shards(docs: DataFrame, limit: int = LIMIT_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, shard, depth): shard is the bits of the bucket's prefix, and for overflow pages `+` and more bits."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = hash_bits(F.concat_ws("|", F.col(id_col).cast("string"), F.md5(text)))
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), key.alias("key"), F.lit("").alias("root"))
    first = stored(_split(stored(rows, "shard-rows"), limit), "shards")
    named = first.select("id", "n_bytes", "key", _named(first).alias("shard"), "depth")
    crowded = named.groupBy("shard").agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n")).filter((F.col("b") > limit) & (F.col("n") > 1)).select("shard")
    whole = named.select(F.col("id").alias(id_col), "n_bytes", "shard", "depth")
    if crowded.isEmpty():
        return whole
    copies = named.join(crowded, "shard", "left_semi").groupBy("shard", "depth", "id", "n_bytes", "key").agg(F.count("*").alias("n"))
    runs = stored(copies.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))).alias("run")), "shard-copies")
    place = F.explode(F.sequence(F.col("run") * COPIES, F.least("n", (F.col("run") + 1) * COPIES) - 1)).alias("place")
    pages = runs.repartition("shard", "key", "run").select("id", "n_bytes", "key", F.col("depth").alias("above"), F.concat("shard", F.lit("+")).alias("root"), place)
    own = hash_bits(F.concat_ws("|", F.col("key").cast("string"), F.col("id").cast("string"), F.col("n_bytes").cast("string"), F.col("place").cast("string")))
    pages = stored(pages.select("id", "n_bytes", "above", "root", own.alias("key")), "shard-pages")
    paged = _split(pages, limit)
    paged = paged.select(F.col("id").alias(id_col), "n_bytes", _named(paged).alias("shard"), (F.col("above") + F.col("depth")).alias("depth"))
    return whole.join(crowded, "shard", "left_anti").select(*paged.columns).unionByName(paged)
