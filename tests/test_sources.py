import json

import pytest
from pyspark.sql import functions as F

from seqlens.functions import metadata
from seqlens.sources import readers, sinks
from tests import services
from seqlens.streaming import ingest
from seqlens.streaming.ingest import merge_stream

FLAT = """LOCUS       AB000001                 20 bp    DNA     linear   INV 01-JAN-2020
DEFINITION  Examplea sp. gene for small subunit ribosomal RNA,
            isolate: ST3.
ACCESSION   AB000001
VERSION     AB000001.2
SOURCE      Examplea sp.
  ORGANISM  Examplea sp.
            Eukaryota; Things.
REFERENCE   1  (bases 1 to 20)
  TITLE     A study of
            healthy people
COMMENT     Some words.
            ##Assembly-Data-START##
            Sequencing Technology :: Sanger dideoxy
            ##Assembly-Data-END##
FEATURES             Location/Qualifiers
     source          1..20
                     /organism="Examplea sp."
                     /host="Homo
                     sapiens"
                     /note="a ""quoted"" note"
                     /note="ST3"
     gene            1..20
                     /pseudo
ORIGIN
        1 acgtacgtac gtacgtacgt
//
LOCUS       AB000002                  4 bp    DNA
VERSION     AB000002.1
ORIGIN
        1 aaaa
//
"""


def test_flat_files(spark, tmp_path):
    (tmp_path / "a.gb").write_text(FLAT)
    rows = {r["accession"]: r for r in readers.read_flat_files(spark, str(tmp_path)).collect()}
    r = rows["AB000001.2"]
    assert r["description"] == "Examplea sp. gene for small subunit ribosomal RNA, isolate: ST3" and r["organism"] == "Examplea sp."
    assert r["seq"] == "ACGTACGTACGTACGTACGT" and r["reference_titles"] == ["A study of healthy people"] and r["comment"] == "Some words."
    assert r["structured_comment"] == {"Assembly-Data": {"Sequencing Technology": "Sanger dideoxy"}}
    source = r["features"][0]
    assert source["qualifiers"]["host"] == ["Homo sapiens"] and source["qualifiers"]["note"] == ['a "quoted" note', "ST3"]
    assert r["features"][1]["qualifiers"] == {"pseudo": [""]} and rows["AB000002.1"]["seq"] == "AAAA"
    df = readers.read_flat_files(spark, str(tmp_path)).where("accession = 'AB000001.2'")
    text = metadata.technology_text({n: F.col(n) for n in ("structured_comment", "comment", "features", "description", "name")})
    assert df.select(metadata.technology(text)).first()[0] == "Sanger"


def test_fasta_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("s1 [host=x]", "ACGT" * 40, "ST1"), ("s2", "AC", "ST_unassigned"), ("s3 y", "GGT" * 20, "ST1")], "header string, seq string, label string")
    sinks.write_fasta(rows, f"{tmp_path}/all")
    got = {r["description"]: r["seq"] for r in readers.read_fasta(spark, f"{tmp_path}/all").collect()}
    assert got == {r["header"]: r["seq"] for r in rows.collect()}
    sinks.write_fasta_by_label(rows, f"{tmp_path}/by")
    sinks.write_fasta_by_label(rows.where("label = 'ST1'"), f"{tmp_path}/by")
    assert {r["id"] for r in readers.read_fasta(spark, f"{tmp_path}/by/label=*").collect()} == {"s1", "s3"}
    (tmp_path / "refs").mkdir()
    for name, text in (("ST1_filtered", ">a d\nAC\nGT\n>b\nTT\n"), ("ST_unassigned_filtered", ">c\nA\n"), ("other", ">d\nA\n")):
        (tmp_path / "refs" / f"{name}.fasta").write_text(text)
    assert sorted(map(tuple, readers.read_labelled_folder(spark, f"{tmp_path}/refs").collect())) == [("a", "a d", "ACGT", "ST1"), ("b", "b", "TT", "ST1")]


def test_tables_and_config(spark, tmp_path):
    rows = spark.createDataFrame([("a", 'say "x",\nthen y', 1.5), ("b", "", None)], "accession string, note string, d double")
    sinks.write_table(rows, f"{tmp_path}/t", "csv")
    back = readers.read_table(spark, f"{tmp_path}/t", rows.schema)
    assert sorted((r["accession"], r["note"] or "", r["d"]) for r in back.collect()) == [("a", 'say "x",\nthen y', 1.5), ("b", "", None)]
    config = json.loads(sinks.run_config(rows.withColumn("subtype", F.lit("x")), "1", {"k": 8}, "now").first()["config"])
    assert config == {"version": "1", "args": {"k": "8"}, "n_sequences": 2, "n_subtypes": 1, "started": "now"}
    sinks.write_distances(spark.createDataFrame([(1, 2, 0.1234567)], "id_a long, id_b long, d double"), f"{tmp_path}/d")
    assert spark.read.parquet(f"{tmp_path}/d").first()["d"] == 0.12346


@pytest.fixture
def paged(spark, tmp_path):
    """A reader of the pages of a service over a file of JSON lines, which Python's workers import from this folder, and the requests that it was sent."""
    log = tmp_path / "asked"
    with open(f"{tmp_path}/rows.jsonl", "w") as f:
        f.writelines(json.dumps({"accession": f"A{i}", "description": "d" if i % 2 else "even", "seq": "AC"}) + "\n" for i in range(25))
    spark.dataSource.register(readers.PagedRecords)
    options = {"service": "tests.services:JsonLines", "file": f"{tmp_path}/rows.jsonl", "log": str(log), "batchsize": "10", "interval": "0"}
    read = lambda **more: spark.read.format("paged").options(**options, **more).load()
    read.asked = lambda: log.read_text().split("\n")[:-1] if log.exists() else []
    return read


def test_paged_source(paged):
    df = paged()
    assert df.count() == 25 and df.rdd.getNumPartitions() == 1  # requests are made one after the other
    assert paged(parallel="2").rdd.getNumPartitions() == 2
    assert paged(maxrecords="12").count() == 12


def test_filters_go_to_the_service(spark, paged):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        found = paged(pushfilters="true").where("description = 'even' AND accession LIKE '%1%' AND length(seq) = 2")
        assert sorted(r["accession"] for r in found.collect()) == ["A10", "A12", "A14", "A16", "A18"]
        assert paged.asked() == ["count 13", "fetch 0", "fetch 10"]  # 13 match what the service answers: two pages of three
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Contains(accession" in plan and "= even" not in plan
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_turns_of_requests():
    assert [readers.next_turn(1, 3, passed, 0.5) for passed in (0.0, 0.5, 0.6, 2.0, 2.1, 9.0)] == [1, 1, 4, 4, 7, 19]
    assert readers.next_turn(2, 4, 100.0, 0.0) == 2
    for passed in (0.0, 0.7, 3.3, 11.0):  # tasks have turns of their own, whenever they start
        assert len({readers.next_turn(i, 5, passed + i / 7, 0.4) % 5 for i in range(5)}) == 5


def test_lost_pages(spark):
    """A page of which all tries fail is an error, or skipped where that is asked for."""
    options = {"service": "tests.services:Numbered", "records": "30", "batchsize": "10", "interval": "0", "retries": "0"}
    reader = readers.PagedReader(options, spark.createDataFrame([], "accession string").schema)
    (pages,) = reader.partitions()
    broken = type("Broken", (), {"fetch": lambda self, start, size: 1 / 0 if start == 10 else services.Numbered(options).fetch(start, size)})
    reader.service = broken
    with pytest.raises(OSError, match="from 10 on"):
        list(reader.read(pages))
    reader.options["onlost"] = "skip"
    assert len(list(reader.read(pages))) == 20


def test_pages_of_a_search(spark):
    rows = spark.range(95).repartition(7).where("id % 3 <> 1")
    found = sorted((r["id"], r["place"], r["page"]) for r in readers.pages(rows, [F.desc("id")], 10).collect())
    want = sorted((i, n, (n - 1) // 10 + 1) for n, i in enumerate([i for i in range(94, -1, -1) if i % 3 != 1], 1))
    assert found == want and readers.pages(rows, [F.desc("id")], 10, 25).count() == 25
    assert "SinglePartition" not in readers.pages(rows, [F.desc("id")], 10)._jdf.queryExecution().executedPlan().toString()


def test_retries():
    waits, tries = [], iter([OSError(), OSError(), [1]])

    def fetch():
        x = next(tries)
        if isinstance(x, Exception):
            raise x
        return x

    assert readers.with_retries(fetch, 3, waits.append) == [1] and waits == [1.0, 2.0]
    assert readers.with_retries(lambda: 1 / 0, 1, waits.append) is None
    assert readers.request_interval("k") < readers.request_interval(None)


def test_search_text():
    q = readers.broad_query("Examplea")
    assert q.startswith('Examplea[Organism] AND ("18S"[All Fields] OR ') and '"mitochondrion"[Title])' in q
    assert '"NMAST3"[Title] OR "non-mammalian avian ST3"[Title]' in readers.narrow_query("Examplea", "NMAST3")
    assert '("subtype 4"[Title] OR "ST4"[Title] OR "ST 4"[Title])' in readers.narrow_query("Examplea", "ST4")


def test_merge_stream(spark, tmp_path):
    source, table, checkpoint = (f"{tmp_path}/{x}" for x in ("in", "table", "checkpoint"))
    schema = "accession string, ord long, seq string"
    for i, rows in enumerate([[("a", 1, "A"), ("b", 2, "C"), ("a", 3, "G")], [("b", 4, "T"), ("c", 5, "T")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        merge_stream(stream, table, checkpoint).awaitTermination(60)
        assert spark.read.parquet(table).count() == 2 + i
    assert {(r["accession"], r["seq"]) for r in spark.read.parquet(table).collect()} == {("a", "A"), ("b", "C"), ("c", "T")}


def test_a_batch_reads_its_own_buckets(spark, tmp_path):
    """Of a table of 64 buckets a batch of one key reads the keys of one, and a second run of the same batch changes nothing."""
    source, table = f"{tmp_path}/in", f"{tmp_path}/table"
    schema = spark.createDataFrame([], "accession string, ord long, seq string").schema
    spark.range(500).selectExpr("concat('k', id) AS accession", "id AS ord", "'ACGT' AS seq").write.parquet(source)
    run = lambda mark: merge_stream(spark.readStream.schema(schema).parquet(source), table, f"{tmp_path}/{mark}").awaitTermination(60)
    run("one")
    target = ingest.merged(spark, table, schema)
    assert target.count() == 500 and target.select(ingest.BUCKET).distinct().count() == 64
    known = ingest.known_keys(target, "accession", [3], 1)
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_bucket" in plan and "seq" not in plan.split("ReadSchema")[1]
    assert known.count() < 30 and ingest.known_keys(target, "accession", [3], 0).count() == 0
    run("two")  # a lost checkpoint: the same batch again
    assert ingest.merged(spark, table, schema).count() == 500
