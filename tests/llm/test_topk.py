"""Exact nearest vectors against all scores."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from seqlens.llm import queries, topk

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, every=20, k=20):
    sound = [(i, [max(-(1 << 63), min((1 << 63) - 1, math.floor(64 * x))) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(64 * x) for x in v)]
    out = []
    for at, (i, v) in enumerate(sound):
        if i is not None and i % every == 0:
            scores = [(max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(v, w, strict=False)))), j) for other, (j, w) in enumerate(sound) if other != at]
            best = sorted(scores, key=lambda s: (-s[0], s[1] is None, s[1] or 0))[:k]
            out += [(i, rank, j, s) for rank, (s, j) in enumerate(best, 1)]
    return sorted(out, key=repr)


def found_by(df, **how):
    return sorted((tuple(r) for r in topk.nearest(df, **how).collect()), key=repr)


def vectors(seed, size, dim, draw):
    rng = random.Random(seed)
    return [(i, [draw(rng) for _ in range(dim)]) for i in range(size)]


KINDS = {
    "even": lambda r: r.uniform(-1, 1),
    "many ties": lambda r: r.choice([0.0, 1 / 64]),
    "all alike": lambda r: 0.5,
    "wide": lambda r: r.choice([-1, 1]) * 10 ** r.uniform(0, 5),
    "beyond doubles": lambda r: r.uniform(-1, 1) * 10 ** r.uniform(6, 8),
    "beyond longs": lambda r: r.uniform(-1, 1) * 10 ** r.uniform(8, 30),
    "nothing": lambda r: 0.0,
}


@pytest.mark.parametrize("kind", KINDS)
def test_all_scores(spark, kind):
    rows = vectors(len(kind), 300, 5, KINDS[kind])
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert found_by(df, query_rows=4, lane_rows=30) == brute(rows)


def test_many_blocks(spark):
    rows = vectors(1, 400, 3, lambda r: r.gauss(0, 1))
    assert found_by(spark.createDataFrame(rows, SCHEMA).repartition(3), every=7, k=3, lane_rows=50, block_rows=8) == brute(rows, 7, 3)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (20, [1.0, -2.0]), (20, [0.5, 0.25]), (None, [1.0, 2.0]), (None, [1.0, 2.0]), (40, None), (60, [1.0, None]), (80, [nan, 1.0]), (100, [inf, 1.0]), (120, [1e307, 1.0]), (3, []), (140, []), (5, [1.0]), (7, [1.0, 2.0, 3.0]), (-20, [1.0, 1.0]), (11, [-0.001, 0.0])]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("x").alias(c) for c in ("id", "rank", "score", "query_id", "qb", "lane", "block", "m", "v")])
    found = found_by(df)
    assert found == brute(rows)
    assert {r[0] for r in found} == {0, 20, 140, -20}
    assert found_by(df.limit(0)) == found_by(df.where("embedding IS NULL")) == found_by(df.where("vec_id = 3")) == []
    assert topk.nearest(df.limit(0)).dtypes == topk.nearest(df).dtypes


def test_query_by_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.execute(topk.ORACLE_SQL)
    found = queries.op12_exact_topk(spark, SF)
    assert found.columns == [c[0] for c in want.description]
    assert sorted(tuple(r) for r in found.collect()) == sorted(want.fetchall())
