"""The two jobs as queries: each runs twice over the whole tables into a new folder, and its output is read back."""

from __future__ import annotations

import os
from dataclasses import fields
from uuid import uuid4

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

import jobs
from jobs import grow_collection, map_fragments
from jobs.common import settings_of
from seqlens.operators.components import shared_folder
from seqlens.plans.catalog import query
from seqlens.plans.similarity_queries import MAPPED, TOP5, rounded, six


def configured(module, spark: SparkSession, name: str, **paths: str):
    """The job's own config file with these paths, and a new folder that all machines share for what it writes."""
    folder = f"{shared_folder(spark)}/{name}-{uuid4().hex}"
    wanted = {f.name for f in fields(module.Settings)}
    made = {"output": f"{folder}/output"} | ({"checkpoint": f"{folder}/checkpoint"} if "checkpoint" in wanted else {})
    return settings_of(module.Settings, os.path.join(os.path.dirname(jobs.__file__), f"{name}.json"), made | paths)


GROWN = """WITH e AS (SELECT doc_id AS id, source AS label, md5(upper(replace(text, 'ß', 'SS'))) AS md5, length(text) AS length, count(*) AS times FROM documents GROUP BY 1, 2, 3, 4),
c AS (SELECT *, CASE WHEN id IS NULL THEN 'no_id' WHEN coalesce(length, 0) = 0 THEN 'no_content' WHEN length < 200 THEN 'too_short' WHEN length > 20000 THEN 'too_long' ELSE 'sound' END AS class FROM e),
d AS (SELECT *, first_value(id) OVER w AS first_id, row_number() OVER w AS o FROM c WINDOW w AS (PARTITION BY md5, class ORDER BY id, label)),
r AS (SELECT id, label, md5, length, times, CASE WHEN class <> 'sound' THEN class WHEN o > 1 THEN 'duplicate' ELSE 'kept' END AS decision, CASE WHEN class = 'sound' AND o > 1 THEN first_id END AS kept_id FROM d)
SELECT *, 0 AS batch, count(*) OVER (PARTITION BY label, decision) AS label_records FROM r"""


@query("job1_grow_collection", GROWN)
def job1(spark, sf):
    # a pattern, as the table may be a single file and a file stream takes folders or patterns
    settings = configured(grow_collection, spark, "grow_collection", records=f"{sf}/documents.parque[t]")
    for _ in range(2):  # the second finds nothing new
        grow_collection.run(spark, settings)
    records = grow_collection.collection(spark, settings).select("id", "label", "md5", "length", "times", "decision", "kept_id", "batch")
    summary = spark.read.parquet(f"{settings.output}/summary").select("label", "decision", F.col("records").alias("label_records"))
    return records.join(summary, ["label", "decision"]).select(*records.columns, "label_records")


MAPPING = MAPPED + TOP5 + f""", called AS (SELECT * FROM m WHERE confidence NOT IN ('unmapped', 'ambiguous')),
s AS (SELECT assigned, count(*) AS calls, count(*) FILTER (confidence = 'high') AS high, 100.0::DOUBLE * count(*) / (SELECT count(*) FROM called) AS pct, {rounded('median(d)')} AS median_dist FROM called GROUP BY 1)
SELECT id, m.assigned, {rounded('d')} AS d, confidence, top5, calls, high, {rounded('pct')} AS pct, median_dist FROM m JOIN five ON id = qid LEFT JOIN s ON s.assigned = m.assigned AND confidence NOT IN ('unmapped', 'ambiguous')"""


@query("job2_map_fragments", MAPPING)
def job2(spark, sf):
    settings = configured(map_fragments, spark, "map_fragments", fragments=f"{sf}/benchmark.parquet", references=f"{sf}/documents.parquet")
    for _ in range(2):  # the second writes the same anew
        map_fragments.run(spark, settings)
    mapping = spark.read.parquet(f"{settings.output}/mapping")
    summary = spark.read.parquet(f"{settings.output}/summary").select(F.col("label").alias("assigned"), "calls", "high", six(F.col("pct")).alias("pct"), six(F.col("median_dist")).alias("median_dist"))
    called = F.when(~F.col("confidence").isin("unmapped", "ambiguous"), F.col("assigned"))
    rows = mapping.select("id", "assigned", six(F.col("containment_dist")).alias("d"), "confidence", "top5", called.alias("called"))
    return rows.join(summary.withColumnRenamed("assigned", "called"), "called", "left").drop("called")
