"""Continuous ingestion: new records are merged into a table as they come, each accession once."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from seqlens.operators import relational

#: Parts that a table's keys are dealt to by a hash; one for every few million keys.
BUCKETS = 64
BUCKET, BATCH = "_bucket", "_batch"


def merged(session: SparkSession, table: str, schema: StructType) -> DataFrame | None:
    """What has been merged into a table of these columns, with the bucket and the batch of each row; None before anything has."""
    try:
        return session.read.schema(StructType([*schema.fields, StructField(BUCKET, LongType()), StructField(BATCH, LongType())])).parquet(table)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def known_keys(target: DataFrame, key: str, buckets: list[int], before: int) -> DataFrame:
    """The keys that batches before this one have merged, of these buckets: other buckets and other columns are not read."""
    return target.where(F.col(BUCKET).isin(buckets) & (F.col(BATCH) < before)).select(key)


def merge_stream(stream: DataFrame, table: str, checkpoint: str, key: str = "accession", available_now: bool = True, buckets: int = BUCKETS) -> StreamingQuery:
    """Adds to a Parquet table the rows of a stream whose key it lacks; within a batch the first by `ord` stays. Rows with a null key go by the key null.

    The table lies in folders by bucket, a hash of the key, and batch. A batch reads the keys of its own buckets alone, so a small one reads a share of the table, and it
    writes its own folders anew: one that runs again after a failure leaves the rows it would have left at once. Table and checkpoint belong together; the number of buckets stays as it is."""
    session, schema = stream.sparkSession, stream.schema

    def upsert(batch: DataFrame, number: int) -> None:
        first = relational.first_per_key(batch, [key], ["ord"]).withColumn(BUCKET, F.pmod(F.xxhash64(key), F.lit(buckets)))
        target = merged(session, table, schema)
        if target is not None:
            own = [r[0] for r in batch.select(F.pmod(F.xxhash64(key), F.lit(buckets))).distinct().collect()]  # as many as buckets at most
            known = known_keys(target, key, own, number).withColumnRenamed(key, "_known")
            first = first.join(known, F.col(key).eqNullSafe(F.col("_known")), "left_anti")
        rows = first.select(*stream.columns, BUCKET, F.lit(number).cast("long").alias(BATCH)).hint("rebalance", BUCKET)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET, BATCH).parquet(table)

    writer = stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
