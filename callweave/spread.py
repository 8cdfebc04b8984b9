"""Small tables over all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


#: Partitions up to which a table is small: some 2 GB at Spark's usual size of a partition.
FEW = 16


def spread(df: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """df over all cores, where its files (or those of `of`, the table that df is made of) make but a few partitions and fewer than there are cores.

    For tables whose rows cost much work. A table with more partitions stays as it lies, so nothing large is shuffled.
    """
    cores, parts = df.sparkSession.sparkContext.defaultParallelism, (df if of is None else of).rdd.getNumPartitions()
    return df.repartition(min(cores, 4 * FEW)) if parts < cores and parts <= FEW else df
