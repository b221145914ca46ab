"""Grows a curated collection: takes the record files that are new since the last run, and decides on every record once.

    python jobs/grow_collection.py --records DIR --output DIR --checkpoint DIR [--config FILE]

A file stream with availableNow reads what its checkpoint hasn't seen, and ends. Every distinct record (id, label, text) of a batch gets one
decision: no_id, no_content, too_short or too_long by its length class; duplicate, if a record with the same content is kept already
or comes first in this batch (by id, then by label), with the id of the one kept; else kept. Earlier batches win over later ones.

    output/records  id, label, md5, length, times (deliveries in the batch), kept_id, text (of kept records only); by decision, bucket and batch
    output/summary  label, records, deliveries, characters; by decision

records is the index of contents too: a batch reads only the kept records' ids and hashes, only of the buckets (first digits of
the hash) that it has itself, and only of earlier batches. A batch that runs again after a failure overwrites its own partitions with the
same rows, so each record is there once. Output and checkpoint belong together: a new checkpoint asks for a new output.
"""

from __future__ import annotations

import logging
import os
import sys
from dataclasses import dataclass

if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs.common import main
from seqlens.functions import metadata

log = logging.getLogger("seqlens.jobs.grow_collection")
DECISIONS = ("kept", "duplicate", "no_id", "no_content", "too_short", "too_long")
#: Columns of records; id is of the type that the record files have.
COLUMNS = "id {id}, label string, md5 string, length long, times long, kept_id {id}, text string, decision string, bucket string, batch long"


@dataclass
class Settings:
    """records: a folder of Parquet files, or a pattern of paths, with the columns id, text and label. Lengths are in characters. digits: of the hash
    that make a bucket (1: 16 buckets). files_per_batch: 0 takes all new files at once."""

    records: str
    output: str
    checkpoint: str
    id: str = "id"
    text: str = "text"
    label: str = "label"
    min_length: int = 200
    max_length: int = 100_000
    digits: int = 1
    files_per_batch: int = 0


def distinct_records(batch: DataFrame, s: Settings) -> DataFrame:
    """id, label, md5, length, text, times, class: a row for each record, however often it was delivered."""
    rows = batch.select(F.col(s.id).alias("id"), F.col(s.label).cast("string").alias("label"), F.col(s.text).cast("string").alias("text"))
    length = F.length("text").cast("long")
    kind = F.when(F.col("id").isNull(), "no_id").when(F.coalesce(length, F.lit(0)) == 0, "no_content").otherwise(metadata.length_class(length, s.min_length, s.max_length, s.max_length))
    told = rows.select("*", metadata.content_hash(F.col("text")).alias("md5"), length.alias("length"), kind.alias("class"))
    return told.groupBy("id", "label", "md5", "length", "class").agg(F.count(F.lit(1)).alias("times"), F.min("text").alias("text"))


def collection(spark: SparkSession, s: Settings) -> DataFrame | None:
    """The records that have been written; None before any has."""
    kind = spark.read.parquet(s.records).schema[s.id].dataType.simpleString()
    try:
        return spark.read.schema(COLUMNS.format(id=kind)).parquet(f"{s.output}/records")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def known_contents(records: DataFrame | None, buckets: list[str], batch: int) -> DataFrame | None:
    """md5, known_id of what earlier batches have kept in these buckets."""
    earlier = (F.col("decision") == "kept") & F.col("bucket").isin(buckets) & (F.col("batch") < batch)
    return records.where(earlier).select("md5", F.col("id").alias("known_id")) if records is not None else None


def decide(each: DataFrame, known: DataFrame | None) -> DataFrame:
    """each with its decision and kept_id. A content that very many records share is cut down to its first before the shuffle; the join with
    those firsts has one row a content on one side, so adaptive execution can split the other."""
    sound = ~F.col("class").isin("no_id", "no_content", "too_short", "too_long")
    first = each.where(sound).groupBy("md5").agg(F.min(F.struct("id", "label")).alias("first"))
    out = each.join(first, "md5", "left")
    out = out.join(known, "md5", "left") if known is not None else out.withColumn("known_id", F.lit(None).cast(each.schema["id"].dataType))
    own = F.struct("id", "label").eqNullSafe(F.col("first"))
    decision = F.when(~sound, F.col("class")).when(F.col("known_id").isNotNull() | ~own, "duplicate").otherwise("kept")
    return out.withColumn("decision", decision).withColumn("kept_id", F.when(F.col("decision") == "duplicate", F.coalesce("known_id", "first.id")))


def run(spark: SparkSession, s: Settings) -> dict[str, int]:
    """Takes the new record files into the collection. Returns how many batches ran, and the records of each decision that they wrote."""
    path = f"{s.output}/records"
    done = {"batches": 0} | dict.fromkeys(DECISIONS, 0)

    def take(batch: DataFrame, number: int) -> None:
        each = distinct_records(batch, s).withColumn("bucket", F.coalesce(F.substring("md5", 1, s.digits), F.lit("none")))
        buckets = [r[0] for r in batch.select(F.substring(metadata.content_hash(F.col(s.text).cast("string")), 1, s.digits).alias("b")).where("b IS NOT NULL").distinct().collect()]  # 16 to the power of digits at most
        decided = decide(each, known_contents(collection(batch.sparkSession, s), buckets, number))
        seen = Observation(f"batch {number}")
        counts = [F.count_if(F.col("decision") == d).alias(d) for d in DECISIONS]
        rows = decided.select("id", "label", "md5", "length", "times", "kept_id", F.when(F.col("decision") == "kept", F.col("text")).alias("text"), "decision", "bucket", F.lit(number).cast("long").alias("batch"))
        rows.observe(seen, *counts).hint("rebalance", "decision", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("decision", "bucket", "batch").parquet(path)
        found = seen.get
        log.info("batch %d: read %s, wrote %s: %s", number, s.records, path, found)
        done["batches"] += 1
        for d in DECISIONS:
            done[d] += found[d]

    reader = spark.readStream.schema(spark.read.parquet(s.records).schema)
    if s.files_per_batch:
        reader = reader.option("maxFilesPerTrigger", s.files_per_batch)
    stream = reader.parquet(s.records).writeStream.foreachBatch(take).option("checkpointLocation", s.checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    summarise(spark, s)
    return done


def summarise(spark: SparkSession, s: Settings) -> None:
    """Writes the summary of the whole collection anew."""
    records = collection(spark, s)
    if records is None:
        log.info("no record has come yet")
        return
    by = records.groupBy("label", "decision").agg(F.count(F.lit(1)).alias("records"), F.sum("times").alias("deliveries"), F.sum("length").alias("characters"))
    by.coalesce(1).write.mode("overwrite").partitionBy("decision").parquet(f"{s.output}/summary")
    log.info("wrote %s/summary", s.output)


if __name__ == "__main__":
    main("grow_collection", Settings, ["records", "output", "checkpoint"], run)
