"""What grows with the tables: copies, pairs that don't count, values in one task, inputs read twice."""

import random

import pytest
from pyspark.sql import functions as F

from seqlens.operators import nearest as kernel
from seqlens.operators import relational, similarity
from seqlens.plans import bindings, relational_queries


def drawn(seed, n, length=40):
    draw = random.Random(seed)
    return [(i, "".join(draw.choices("ACGTN", [8, 8, 8, 8, 1], k=length))) for i in range(n)]


@pytest.mark.parametrize("contained", [False, True])
def test_copies_are_searched_once(spark, monkeypatch, contained):
    contents = [s for _, s in drawn(1, 6)]
    queries = spark.createDataFrame([(i, contents[i % 3]) for i in range(40)], "id long, seq string")
    refs = spark.createDataFrame([(i, contents[2 + i % 4], f"l{i % 7}") for i in range(60)], "id long, seq string, label string")
    want = {tuple(r) for r in similarity.neighbours(queries, refs, 4, contained).collect()}  # in one pass over refs
    seen = []
    in_blocks = kernel.nearest_in_blocks

    def counted(asked, held, *rest):
        seen.append((asked.count(), held.count()))
        return in_blocks(asked, held, *rest)

    monkeypatch.setattr(kernel, "bounded", lambda *_: None)
    monkeypatch.setattr(kernel, "nearest_in_blocks", counted)
    assert {tuple(r) for r in similarity.neighbours(queries, refs, 4, contained).collect()} == want
    assert seen == [(3, 4 * similarity.TOP)]


def test_codes_are_the_strict_kmers():
    for _, s in [*drawn(2, 20), (0, ""), (0, "ACGTACG"), (0, "ACGTACGT"), (0, "ACGTéACGTACGTA"), (0, "acgtACGTACGTa")]:
        want = sorted({s[i : i + 8] for i in range(len(s) - 7) if set(s[i : i + 8]) <= set("ACGT")})
        code = [int(w.translate(str.maketrans("ACGT", "0123")), 4) for w in want]
        assert kernel.strict_codes(s, 8).tolist() == code and len(kernel.strict_kmers(s, 8)) == len(code)


@pytest.mark.parametrize("k", range(1, 9))
def test_codes_of_any_case_and_length(k):
    draw = random.Random(k)
    for n in [*range(12), 40, kernel.SORTED - 1, kernel.SORTED + k]:
        for letters in ("ACGT", "ACGTacgtACGTacgtN-", "ACGTacgt\u00e9\u1e97\ufb06\u00dfACGTacgtACGT"):
            s = "".join(draw.choices(letters, k=n))
            for any_case, text in ((False, s), (True, s.upper())):
                want = sorted({text[i : i + k] for i in range(len(text) - k + 1) if set(text[i : i + k]) <= set("ACGT")})
                assert kernel.strict_codes(s, k, any_case).tolist() == [int(w.translate(str.maketrans("ACGT", "0123")), 4) for w in want]


def test_refs_of_any_case_are_mapped_as_by_the_join(spark):
    queries = spark.createDataFrame([(i, s.lower() if i % 2 else s) for i, s in drawn(7, 12, 30)], "id long, seq string")
    refs = spark.createDataFrame([(i, s.lower() if i % 3 else s + "\u1e97") for i, s in drawn(8, 30, 200)], "id long, seq string")
    want = {tuple(r) for r in similarity.containment(queries, refs, 5).collect()}
    assert {tuple(r) for r in similarity.contained(queries, refs, 0.0, 5).collect()} == want


@pytest.mark.parametrize("kind", ["long", "int", "string"])
def test_names_of_queries_start_no_python(spark, kind):
    # rows of a list went through Python workers of their own, which stayed beside the kernel's
    ids = [None, *(str(i) if kind == "string" else i for i in range(3))]
    queries = spark.createDataFrame([(i, "ACGTACGT") for i in ids], f"id {kind}, seq string")
    for q in (queries, queries.limit(0)):
        rows = kernel.bounded(q, True)
        names = similarity.names_of(rows, q)
        assert names.dtypes == [("query", "bigint"), ("query_id", dict(q.dtypes)["id"])]
        assert [tuple(r) for r in names.orderBy("query").collect()] == [(i, r["id"]) for i, r in enumerate(rows)]
        assert "ExistingRDD" not in names._jdf.queryExecution().executedPlan().toString()


def test_contained_pairs_without_a_join(spark):
    queries = spark.createDataFrame([*drawn(3, 12, 30), (50, None), (51, ""), (52, "ACGT")], "id long, seq string")
    refs = spark.createDataFrame([*drawn(4, 30, 200), *[(100 + i, s[:20] + "T" * i) for i, s in drawn(3, 12, 30)], (200, None)], "id long, seq string")
    for share in (0.0, 0.3, 0.5, 1.0):
        found = similarity.contained(queries, refs, share, 5)
        want = similarity.containment(queries, refs, 5).where(F.col("shared") >= share * F.col("nq"))
        assert {tuple(r) for r in found.collect()} == {tuple(r) for r in want.collect()}
    assert "Join" not in kernel.within(kernel.bounded(queries, True), refs, 5, 0.5)._jdf.queryExecution().executedPlan().toString()


def test_quantiles_of_all_without_one_buffer(spark, tmp_path):
    draw = random.Random(6)
    rows = [(draw.choice("AB"), draw.choice("FO"), draw.choice([None, draw.random(), 3.5])) for _ in range(400)]
    frame = spark.createDataFrame(rows, "l_returnflag string, l_linestatus string, l_extendedprice double")
    for name, part in (("some", frame), ("none", frame.limit(0))):
        part.write.parquet(f"{tmp_path}/{name}/lineitem.parquet")
        found = relational_queries.a17k(spark, f"{tmp_path}/{name}")
        assert "percentile(" not in found._jdf.queryExecution().analyzed().toString()
        want = part.agg(F.percentile("l_extendedprice", F.array(F.lit(0.95), F.lit(0.99), F.lit(0.5))).alias("p")).first()["p"]
        assert list(found.first()) == (pytest.approx(want) if want else [None] * 3)


def test_grid_of_counts_reads_its_rows_once(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", None), (None, "y"), ("c", "y")], "label string, tech string")
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    got = {tuple(r) for r in relational.counted_grid(rows.mapInArrow(run, rows.schema), "label", "tech").collect()}
    assert got == {("a", "x", 2), ("a", "y", 0), ("b", "x", 0), ("b", "y", 0), ("c", "x", 0), ("c", "y", 1), (None, "x", 0), (None, "y", 1)}
    assert seen.value == 5


def test_records_are_dealt_over_the_cores(spark, tmp_path):
    """A file of one row group, which is one split, is worked on by all cores."""
    spark.range(2000).selectExpr("id AS c_custkey", "'n' AS c_name", "'BUILDING' AS c_mktsegment", "0L AS c_nationkey", "1.0D AS c_acctbal").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.sql("SELECT 0L AS n_nationkey, 'N' AS n_name, 0L AS n_regionkey").write.parquet(f"{tmp_path}/nation.parquet")
    spark.sql("SELECT 0L AS r_regionkey, 'R' AS r_name").write.parquet(f"{tmp_path}/region.parquet")
    parts = bindings.records(spark, str(tmp_path)).select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(parts) == spark.sparkContext.defaultParallelism and sum(r["count"] for r in parts) == 2000
