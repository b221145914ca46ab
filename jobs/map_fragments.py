"""Maps short records onto labelled references and sums the calls up by label.

    python jobs/map_fragments.py --fragments PATH --references PATH --output DIR [--config FILE]

Each fragment gets the label of the reference that holds most of its k-mers (either strand), a grade by how many, and its five nearest
references in order. Whole output is written anew, so a run again gives the same files' rows.

    output/mapping  id, assigned, containment_dist, top5; by confidence
    output/summary  label, calls, high, medium, low, pct (of all calls), median_dist; by label_kind (novel or known)
"""

from __future__ import annotations

import logging
import os
import sys
from dataclasses import dataclass

if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs.common import main
from seqlens.functions import fixed
from seqlens.operators import relational, similarity

log = logging.getLogger("seqlens.jobs.map_fragments")
GRADES = ("high", "medium", "low", "ambiguous", "unmapped")


@dataclass
class Settings:
    """fragments, references: Parquet. The other settings but k are SQL expressions over their columns."""

    fragments: str
    references: str
    output: str
    fragment_id: str = "id"
    fragment_seq: str = "seq"
    reference_id: str = "id"
    reference_seq: str = "seq"
    reference_label: str = "label"
    k: int = fixed.KMER


def summary(mapping: DataFrame) -> DataFrame:
    """label, calls, high, medium, low, pct, median_dist, label_kind of the fragments that were called."""
    called = mapping.where(~F.col("confidence").isin("unmapped", "ambiguous"))
    counted = called.groupBy(F.col("assigned").alias("label")).agg(*[F.count_if(F.col("confidence") == g).alias(g) for g in GRADES[:3]])
    own = called.select(F.col("assigned").alias("label"), "containment_dist")
    median = relational.quantiles(own, ["label"], "containment_dist", {"median_dist": 0.5}).drop("n")
    kind = F.when(F.col("label").startswith("novel"), "novel").otherwise("known")
    return relational.shares(own, "label", name="calls").join(counted, "label").join(median, "label").withColumn("label_kind", kind)


def run(spark: SparkSession, s: Settings) -> dict[str, int]:
    """Writes mapping and summary. Returns the fragments of each grade."""
    fragments = spark.read.parquet(s.fragments).select(F.expr(s.fragment_id).alias("id"), F.expr(s.fragment_seq).alias("seq"))
    references = spark.read.parquet(s.references).select(F.expr(s.reference_id).alias("id"), F.expr(s.reference_seq).alias("seq"), F.expr(s.reference_label).alias("label"))
    seen = Observation("mapping")
    mapping = similarity.map_fragments(fragments, references, s.k).observe(seen, *[F.count_if(F.col("confidence") == g).alias(g) for g in GRADES])
    mapping.write.mode("overwrite").partitionBy("confidence").parquet(f"{s.output}/mapping")
    log.info("read %s and %s, wrote %s/mapping: %s", s.fragments, s.references, s.output, seen.get)
    written = spark.read.schema(mapping.schema).parquet(f"{s.output}/mapping")
    summary(written).coalesce(1).write.mode("overwrite").partitionBy("label_kind").parquet(f"{s.output}/summary")
    log.info("wrote %s/summary", s.output)
    return seen.get


if __name__ == "__main__":
    main("map_fragments", Settings, ["fragments", "references", "output"], run)
