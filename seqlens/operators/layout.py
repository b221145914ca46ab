"""How rows lie in partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Inputs up to this many bytes of file may sit in one row group, and so in one task.
SMALL_BYTES = 24 << 20


def spread(rows: DataFrame, small_bytes: int = SMALL_BYTES) -> DataFrame:
    """Small inputs dealt evenly over the cores before heavy work on each row; others lie in enough splits already and
    are left where they are, without a shuffle."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism) if size <= small_bytes else rows
