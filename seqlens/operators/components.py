"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which the driver and all executors share.

    Where the session sets no such folder, one on this machine is made if all tasks run here too (a local master); on a cluster
    that is an error."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not shared:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="seqlens-checkpoint-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
        sc.setCheckpointDir(shared)
    return shared


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to and read from the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = shared_folder(df.sparkSession)
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(folder)
    return df.checkpoint()


def _pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 50) -> DataFrame:
    """node, component (the least node of its component) for every node that an edge names.

    Edges with a null end and loops join nothing; a node with loops only is absent. Every round hangs each node under the
    least of its neighbours, first for larger neighbours, then for smaller ones, until no edge changes: about
    log(nodes) rounds. A node with very many edges is pre-aggregated for its minimum, and its edges are an
    ordinary join side, which adaptive execution splits."""
    now = checkpointed(_pairs(edges.select(F.col(u).alias("a"), F.col(v).alias("b")).dropna(), "a", "b"))
    seen = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        hung = _pairs(large, "a", "b")
        least = hung.groupBy("u").agg(F.min("v").alias("m"))
        small = hung.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        now = checkpointed(_pairs(small, "a", "b"))
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == seen or not state[0]:
            break
        seen = state
    else:
        raise RuntimeError(f"no end after {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
