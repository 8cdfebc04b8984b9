"""Writes as functions from (table, change) to the new table. Plain files have no MERGE, so each is one join or one rewrite."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import kept
from .rows import both, latest


def append(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows, allowMissingColumns=True)


def insert_absent(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not there yet; of several new rows with one key, the first by all columns."""
    fresh = rows.dropDuplicates(keys).join(table, keys, "left_anti")
    return table.unionByName(fresh, allowMissingColumns=True)


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], keep: Column | None = None, once: list[str] = (), first: list[str] = ()) -> DataFrame:
    """Full-outer upsert.

    keep: predicate over the old row (columns `old.*`) under which it stays as it is.
    once: columns that keep the old value where it is set (stamped once). first: columns of the old row wherever there is one.
    """
    on = both([F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys])
    has_old, has_new = F.col("old._is").isNotNull(), F.col("new._is").isNotNull()
    joined = table.withColumn("_is", F.lit(1)).alias("old").join(rows.withColumn("_is", F.lit(1)).alias("new"), on, "full")
    stays = ~has_new if keep is None else ~has_new | (has_old & F.coalesce(keep, F.lit(False)))

    def value(c: str) -> Column:
        o, n = F.col(f"old.{c}"), F.col(f"new.{c}") if c in rows.columns else F.lit(None)
        if c in once:
            n = F.coalesce(o, n)
        elif c in first:
            n = F.when(has_old, o).otherwise(n)
        return F.when(stays, o).otherwise(n).alias(c)

    return joined.select(*(value(c) for c in table.columns))


def latest_wins(table: DataFrame, rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return latest(table.unionByName(rows), keys, order)


def accumulate(rows: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Additive upsert: amounts are already rounded per row, then summed."""
    return rows.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums))


def stamp_once(table: DataFrame, column: str, when: Column, now: Column) -> DataFrame:
    """column := now where the condition holds and it is not set yet."""
    return table.withColumn(column, F.when(F.col(column).isNull() & F.coalesce(when, F.lit(False)), now).otherwise(F.col(column)))


def transition(table: DataFrame, when: Column, **values: Column) -> DataFrame:
    """A guarded update: new values where the guard holds."""
    guard = table.withColumn("_g", F.coalesce(when, F.lit(False)))
    return guard.select(*(F.when(F.col("_g"), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns))


def update_from(table: DataFrame, source: DataFrame, keys: list[str], when: Column, **values: Column) -> DataFrame:
    """UPDATE ... FROM: new values where a source row with the same key exists and the guard holds."""
    hit = source.select(*keys).distinct().withColumn("_hit", F.lit(True))
    return transition(table.join(hit, keys, "left").withColumn("_hit", F.coalesce("_hit", F.lit(False))), F.col("_hit") & when, **values).drop("_hit").select(*table.columns)


def replace_set(table: DataFrame, rows: DataFrame, keys: list[str], now: Column) -> DataFrame:
    """Soft-delete the live rows of the keys and add the new ones, which inherit the least retention date."""
    touched = rows.select(*keys).distinct()
    alive = F.col("soft_deleted_at").isNull() & F.col("hard_deleted_at").isNull()
    inherited = table.filter(alive).groupBy(*keys).agg(F.min("retention_eligible_at").alias("_eligible"))
    old = update_from(table, touched, keys, alive, soft_deleted_at=now)
    new = rows.join(inherited, keys, "left").withColumn("retention_eligible_at", F.coalesce("_eligible", "retention_eligible_at")).drop("_eligible")
    return old.unionByName(new.select(*table.columns))


def json_export(rows: DataFrame, order: list[str], cap: int | None = None) -> DataFrame:
    """(line, total, truncated): a JSON line a row, in full or the first `cap` in order; the flag says whether rows are left out."""
    total = rows.agg(F.count("*").alias("total"))
    kept = rows if cap is None else rows.orderBy(*order).limit(cap)
    cut = F.lit(False) if cap is None else F.col("total") > cap
    return kept.select(F.to_json(F.struct(*rows.columns)).alias("line")).crossJoin(total).withColumn("truncated", cut)


# -- exported sets ------------------------------------------------------------

#: Where an exported set keeps its versions, and the file that names the one that counts.
_VERSIONS, _CURRENT = "versions", "CURRENT"


def _store(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def current_version(spark: SparkSession, folder: str) -> str | None:
    """The version of an exported set that counts; None before the first."""
    store, at = _store(spark, f"{folder}/{_CURRENT}")
    return spark.read.text(at.toString()).first()[0] if store.exists(at) else None


def exported(spark: SparkSession, folder: str, version: str | None = None) -> DataFrame:
    """(file, body) of an exported set: of the version that counts, or of the given one."""
    version = version or current_version(spark, folder)
    return spark.read.schema("body string, file string").parquet(f"{folder}/{_VERSIONS}/{version}/fixtures").select("file", "body")


def manifest(spark: SparkSession, folder: str, version: str | None = None) -> DataFrame:
    """(file, sha256) of an exported set."""
    version = version or current_version(spark, folder)
    schema = "file string, sha256 string"
    return spark.createDataFrame([], schema) if version is None else spark.read.schema(schema).json(f"{folder}/{_VERSIONS}/{version}/manifest")


def stage_export(rows: DataFrame, folder: str) -> str:
    """Phase one: write (file, body) and its manifest as a new version, which counts for nothing yet; its name."""
    version = uuid.uuid4().hex
    path = f"{folder}/{_VERSIONS}/{version}"
    rows.select("body", "file").write.parquet(f"{path}/fixtures")
    written = rows.sparkSession.read.schema("body string, file string").parquet(f"{path}/fixtures")
    if not written.groupBy("file").count().filter("count > 1").isEmpty():
        raise ValueError("two bodies of one file")
    written.select("file", F.sha2(F.coalesce("body", F.lit("")), 256).alias("sha256")).write.json(f"{path}/manifest")
    return version


def commit_export(spark: SparkSession, folder: str, version: str) -> None:
    """Phase two: one rename makes the staged version the one that counts; then what no longer counts is deleted.

    A run that is lost before the rename leaves the old set as it was; one lost behind it leaves at most stale versions, which
    the next commit deletes.
    """
    staged = f"{folder}/{_CURRENT}-{version}"
    spark.createDataFrame([(version,)], "value string").coalesce(1).write.mode("overwrite").text(staged)
    store, at = _store(spark, staged)
    part = next(f.getPath() for f in store.listStatus(at) if f.getPath().getName().startswith("part-"))
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(part, _store(spark, f"{folder}/{_CURRENT}")[1], options)
    for f in store.listStatus(_store(spark, folder)[1]):
        if f.getPath().getName().startswith(f"{_CURRENT}-"):
            store.delete(f.getPath(), True)
    for f in store.listStatus(_store(spark, f"{folder}/{_VERSIONS}")[1]):
        if f.getPath().getName() != version:
            store.delete(f.getPath(), True)


def export_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file, change): added, removed, changed or kept, from two manifests."""
    both_ = before.select("file", F.col("sha256").alias("old")).join(after.select("file", F.col("sha256").alias("new")), "file", "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed").otherwise("kept")
    return both_.select("file", change.alias("change"))


def export_fixtures(rows: DataFrame, folder: str) -> DataFrame:
    """Put (file, body) in the place of an exported set; (file, change) against the set before. Stale files are gone with their version."""
    spark = rows.sparkSession
    old = manifest(spark, folder)
    version = stage_export(rows, folder)
    diff = kept(export_diff(old, manifest(spark, folder, version)), "export-diff")
    commit_export(spark, folder, version)
    return diff
