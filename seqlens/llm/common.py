"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seqlens.operators.components import checkpointed
from seqlens.operators.layout import spread

__all__ = ["BATCH_ROWS", "bounded_batches", "by_verdict", "checkpointed", "id_text", "lower_ascii", "map_batches", "spread", "table", "text_bytes"]

#: Rows of one Arrow batch: bounds what a Python worker and the JVM hold at once.
BATCH_ROWS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Lower Spark's Arrow batch size where it is above BATCH_ROWS (texts may be long)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def release() -> None:
    """Gives memory that a finished task no longer uses back to the system: idle Python workers stay beside the JVM."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)(0)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow with bounded batches; a small input in one row group is spread over the cores first."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        release()

    return spread(df).mapInArrow(run, schema)


def id_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads, under names that no other column shares."""
    return df.select(df[id_col].alias("doc_id"), df[text_col].cast("string").alias("text"))


def text_bytes(df: DataFrame, text_col: str) -> int:
    """UTF-8 bytes of all texts: sets partition counts in proportion to the data."""
    return int(df.agg(F.sum(F.octet_length(df[text_col]).cast("long")).alias("b")).first()["b"] or 0)


def by_verdict(docs: DataFrame, verdicts: DataFrame, chosen: Callable[[DataFrame], DataFrame], id_col: str) -> DataFrame:
    """The rows of docs that stay, all columns as they are. verdicts: doc_id and a verdict for each id of docs, null among them: its rows
    stay, go, or are told apart ("rows"; null ids always are). chosen: from such rows, numbered by a column row, the numbers of those that stay.

    Ids that stay are found by an anti-join with the others; only rows that share an id with others or have none are
    written and looked at one by one."""
    other = checkpointed(verdicts.where("verdict <> 'stays'"))
    key = lambda df: df.where("doc_id IS NOT NULL").select(F.col("doc_id").alias(id_col))
    kept = docs.where(docs[id_col].isNotNull()).join(key(other), id_col, "left_anti").select(*docs.columns)
    apart = other.where("verdict = 'rows'")
    if apart.isEmpty():
        return kept
    rows = docs.join(key(apart), id_col, "left_semi").select(*docs.columns).unionByName(docs.where(docs[id_col].isNull()))
    numbered = checkpointed(rows.select(F.monotonically_increasing_id().alias("row"), F.struct(*rows.columns).alias("all")))
    flat = numbered.select("row", *[F.col("all").getField(c).alias(c) for c in docs.columns if c != "row"])
    stay = numbered.join(checkpointed(chosen(flat).select("row")), "row", "left_semi")
    return kept.unionByName(stay.select(*[F.col("all").getField(c).alias(c) for c in docs.columns]))


def lower_ascii(col: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
