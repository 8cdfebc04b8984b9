"""The folder that driver and executors share, and the tables written into it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where that is unset, a new local folder, but only if all runs on one machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("callweave.scratch", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="callweave-")
        spark.conf.set("callweave.scratch", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def kept(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: what led to it is not computed again, whichever executor is lost."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Delete every table that this process has written there; DataFrames that read one can't be used any more."""
    done = 0
    while _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        done += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return done
