"""Sources and sinks: what is written is read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlens.operators.components import shared_folder
from seqlens.plans.bindings import FRAGMENT_LABELS, SEQ, SPECIMENS, fragments, pick, specimens, table
from seqlens.plans.catalog import query
from seqlens.sources import readers, sinks

FRAGMENTS = f"f AS (SELECT item_id AS id, {SEQ} AS seq FROM benchmark), lab AS (SELECT id, seq, {pick('id', FRAGMENT_LABELS)} AS label FROM f)"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def headed(spark: SparkSession, sf: str) -> DataFrame:
    return fragments(spark, sf).withColumn("header", F.concat_ws(" ", F.col("id").cast("string"), "label"))


@query("s8_fasta", f"WITH {FRAGMENTS} SELECT CAST(id AS VARCHAR) AS id, concat(id, ' ', label) AS description, seq FROM lab")
def s8(spark, sf):
    path = scratch(spark, "fasta")
    sinks.write_fasta(headed(spark, sf), path)
    return readers.read_fasta(spark, path).select("id", "description", "seq")


@query("k1_fasta_by_label", f"WITH {FRAGMENTS} SELECT label, count(*) AS n, sum(length(seq)) AS letters FROM lab GROUP BY label")
def k1(spark, sf):
    path = scratch(spark, "labels")
    sinks.write_fasta_by_label(headed(spark, sf), path)
    return readers.read_fasta(spark, path).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("seq")).alias("letters"))


TABLE = "ord, accession, concat('a \"quoted\", ', coalesce(titles, 'none'), chr(10), 'second line') AS note, c_acctbal AS balance"


@query("s9_csv", f"SELECT {TABLE} FROM ({SPECIMENS})")
def s9(spark, sf):
    """A CSV with quotes, commas and line ends in its values (sinks K3, K5 and K7 write alike)."""
    path = scratch(spark, "csv")
    sinks.write_table(specimens(spark, sf).selectExpr(*[c.strip() for c in ("ord", "accession", "concat('a \"quoted\", ', coalesce(titles, 'none'), chr(10), 'second line') AS note", "c_acctbal AS balance")]), path, "csv")
    return readers.read_table(spark, path, "ord long, accession string, note string, balance double")


@query("k3_manifest", f"SELECT ord, accession, label, confidence FROM ({SPECIMENS})")
def k3(spark, sf):
    path = scratch(spark, "manifest")
    sinks.write_table(specimens(spark, sf).select("ord", "accession", "label", "confidence"), path)
    return spark.read.parquet(path)


@query("s7_flat_files", f"SELECT accession, name, description, organism, upper(seq) AS seq FROM (SELECT accession, name, concat('isolate ', label) AS description, organism, repeat({pick('ord', ['acgt', 'ggcat', 'ttaa'])}, 3) AS seq FROM ({SPECIMENS}))")
def s7(spark, sf):
    path = scratch(spark, "flat")
    line = lambda key, value: F.concat(F.lit(key.ljust(12)), value, F.lit("\n"))
    seq = F.repeat(F.expr(pick("ord", ["acgt", "ggcat", "ttaa"])), 3)
    entry = F.concat(line("LOCUS", F.col("name")), line("DEFINITION", F.concat(F.lit("isolate "), F.col("label"), F.lit("."))), line("VERSION", F.col("accession")), line("  ORGANISM", F.col("organism")), F.lit("ORIGIN\n        1 "), seq, F.lit("\n//"))
    specimens(spark, sf).select(entry.alias("value")).write.text(path)
    return readers.read_flat_files(spark, path).select("accession", "name", "description", "organism", "seq")


@query("s1_paged", "WITH f AS (SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) AS place FROM documents WHERE contains(lower(text), 'the') OR contains(lower(text), 'und')) SELECT doc_id, source, place, (place - 1) // 40 + 1 AS page FROM f WHERE place <= 600")
def s1(spark, sf):
    """A search by terms over documents, its hits page by page up to a cap (S1, S6); the filter is part of the scan."""
    found = table(spark, sf, "documents").where(readers.contains_any(F.col("text"), ["the", "und"])).select("doc_id", "source")
    return readers.pages(found, [F.col("doc_id")], 40, 600)


@query("s6_page_sizes", "WITH f AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS place FROM documents WHERE lang = 'de' AND contains(text, 'e')) SELECT (place - 1) // 100 + 1 AS page, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM f GROUP BY 1")
def s6(spark, sf):
    """Pages of all that a search finds, with what each holds."""
    found = table(spark, sf, "documents").where("lang = 'de' AND contains(text, 'e')").select("doc_id")
    return readers.pages(found, [F.col("doc_id")], 100).groupBy("page").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


@query("s10_labelled_folder", f"WITH {FRAGMENTS} SELECT CAST(id AS VARCHAR) AS id, seq, label FROM lab WHERE label <> 'ST_unassigned' AND seq <> ''")
def s10(spark, sf):
    """Labelled files of sequences, a file for each label, read back without the unassigned ones."""
    path = scratch(spark, "labelled")
    rows = fragments(spark, sf).where("label <> 'ST_unassigned'").select("id", "seq", F.concat_ws(" ", F.col("id").cast("string"), "label").alias("header"), "label")
    sinks.write_fasta_by_label(rows, path)
    return readers.read_fasta(spark, path).select("id", "seq", "label")


@query("s5_by_accession", f"SELECT accession, ord FROM ({SPECIMENS}) WHERE accession IN (SELECT accession FROM ({SPECIMENS}) WHERE ord IN (3, 8, 21))")
def s5(spark, sf):
    rows = specimens(spark, sf).select("accession", "ord", "label")
    wanted = [r["accession"] for r in rows.where("ord IN (3, 8, 21)").collect()]
    return readers.by_accession(rows, [*wanted, wanted[0], "none"]).select("accession", "ord")


@query("k8_text", f"WITH {FRAGMENTS} SELECT concat('>', id, ' ', label) AS line, count(*) AS n FROM lab GROUP BY 1")
def k8(spark, sf):
    path = scratch(spark, "text")
    sinks.write_text(headed(spark, sf).select(F.concat(F.lit(">"), "header").alias("value")), path)
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))
