"""Views over the test tables in the shapes that the operators take.

A view's SQL is written in what Spark and DuckDB share, so that a query and its oracle start from the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlens.operators.layout import spread

GENUS = "Examplea"
#: Records are short and the work on each is long, so files up to this size, which have few splits, are dealt out over the cores.
RECORD_BYTES = 1 << 28


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(number: str, values: list[str | None]) -> str:
    """SQL: one of the values by a number's remainder. A value that starts with = is an expression."""
    shown = ["NULL" if v is None else v[1:] if v.startswith("=") else "'" + v.replace("'", "''") + "'" for v in values]
    return f"CASE {number} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(shown)) + " END"


LABELS = ["ST1", "ST10", "ST2", "NMAST3", "novel_2", "ST_unassigned", "Unknown", "novel_11", "ST5", "ST1", "ST2", "ST3"]

SPECIMENS = f"""SELECT c_custkey AS ord,
  concat({pick("c_custkey", ["XM_", "AC", "AC", "NR_", "AC", "AB", "AC", "U"])}, c_custkey, {pick("c_custkey", [".1", ".2", ""])}) AS accession,
  c_name AS name,
  concat('isolate ', {pick("c_custkey", ["ST1", "ST10 and ST2 mixed", "subtype 7", "st4-clone", "ST03", "no label", "Subtype 12 / ST12"])}, ' ', c_mktsegment) AS description,
  {pick("c_custkey", [f"{GENUS} hominis", f"{GENUS} ratti isolate", f"{GENUS} sp.", "other thing", f"{GENUS} galli"])} AS organism,
  concat(c_name, '-', c_mktsegment) AS seq,
  {pick("c_custkey", ["human", "Homo sapiens", " Cow ", "unknown", None, "PIG", "Crab-eating macaque", "N/A", "chicken", "", "dog", f"{GENUS} sp.", "goat"])} AS host_q,
  {pick("c_custkey", ["stool", "cattle feces", "wild boar", "bat", "Macaca mulatta", "soil", None, "human", "sewage water", "Bird cage", "unknown"])} AS isolation_q,
  {pick("c_custkey", ["isolated from a goat kept in pens", "from human", "human stool", None, "isolate from Homo sapiens", "ST3; subtype 3", "no data", "from a child with diarrhoea", "colorectal cancer patient, human"])} AS note,
  {pick("c_custkey", ["=concat(n_name, ': ', r_name)", "=n_name", None, ""])} AS geo_q,
  {pick("c_custkey", ["=concat(n_name, ', ', c_mktsegment)", None, "Unknown"])} AS country_q,
  {pick("c_custkey", ["2019", "24-Sep-2022", "2024-06", "1998/2021", "Unknown", None, "12/1987", "abc 1899"])} AS date_q,
  {pick("c_custkey", ["genomic DNA", "mRNA", "rRNA", "protein", "other", "", None, "transcribed RNA", "viral cRNA"])} AS mol_q,
  {pick("c_custkey", ["Sanger dideoxy", "Illumina MiSeq v3", "Oxford Nanopore MinION", "PacBio Sequel II", None, "454 GS FLX", "BGISEQ-500", "ion torrent PGM", "direct  sequencing", "unknown"])} AS technology_q,
  {pick("c_custkey", ["asymptomatic patient", "Patients with colorectal cancer", "HIV and diarrhea", "healthy control group", "irritable bowel", "CRC adenoma and tumour", None, "", "urticaria rash", "anaemia in children", "chronic diarrhoea, abdominal pain", "IBD (Crohn)", "nothing known"])} AS titles,
  {pick("c_custkey", LABELS)} AS label,
  {pick("c_custkey", ["high", "medium", "low", "high", "novel_cluster", "unplaced", "high"])} AS confidence,
  {pick("c_custkey", ["broad_query", "broad_query", "curated_reference", "broad_query", "narrow_coverage_check"])} AS source,
  n_name, r_name, c_mktsegment, c_acctbal
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""

#: DuckDB's view of text as a sequence of ACGT.
SEQ = "regexp_replace(translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC'), '[^ACGT]', '', 'g')"


def specimens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat records with raw qualifiers, a row for each customer."""
    names = ("customer", "nation", "region")
    sql = SPECIMENS
    for n in names:
        sql = sql.replace(f" {n} ", f" {{{n}}} ") if f" {n} " in sql else sql.replace(f" {n}\n", f" {{{n}}}\n")
    found = {n: table(spark, sf_dir, n) for n in names}
    found["customer"] = spread(found["customer"], RECORD_BYTES)
    return spark.sql(sql.replace("FROM customer", "FROM {customer}"), **found)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested records over the same rows."""
    one = lambda c: F.when(F.col(c).isNotNull(), F.array(c))
    keys = {"host": "host_q", "isolation_source": "isolation_q", "note": "note", "geo_loc_name": "geo_q", "country": "country_q", "collection_date": "date_q", "mol_type": "mol_q"}
    every = F.create_map(*[x for k, c in keys.items() for x in (F.lit(k), one(c))])
    source = F.struct(F.lit("source").alias("type"), F.map_filter(every, lambda _, v: v.isNotNull()).alias("qualifiers"))
    gene = F.struct(F.lit("gene").alias("type"), F.create_map().cast("map<string,array<string>>").alias("qualifiers"))
    told = F.when(F.col("technology_q").isNotNull(), F.create_map(F.lit("Assembly-Data"), F.create_map(F.lit("Sequencing Technology"), "technology_q"))).otherwise(F.create_map().cast("map<string,map<string,string>>"))
    return specimens(spark, sf_dir).withColumns({"features": F.array(gene, source), "structured_comment": told, "comment": F.lit(None).cast("string"), "query": F.lit("all")})


def sequence(text: str = "text") -> F.Column:
    """Letters as ACGT, all else left out."""
    return F.regexp_replace(F.translate(F.lower(text), "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"), "[^ACGT]", "")


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, seq, label: documents as labelled sequences."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), sequence().alias("seq"), F.col("source").alias("label"), "lang")


FRAGMENT_LABELS = ["ST1", "ST2", "ST3", "novel_1", "ST_unassigned", "Unknown", "ST1", "novel_1"]


FRAGMENT_COLUMNS = {
    "host": ["Homo sapiens", "Sus scrofa", "Unknown", "Homo sapiens", "Bos taurus"],
    "country": ["China: Hainan", "Spain", None, "China", "Spain", "Egypt", "China: Hainan"],
    "technology": ["Sanger", "Illumina", "Unknown"],
    "confidence": ["high", "high", "medium", "low"],
}
FRAGMENT_VALUES = ", ".join(f"{pick('id', v)} AS {k}" for k, v in FRAGMENT_COLUMNS.items())


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, seq, label, host, country, technology, confidence: benchmark items as short sequences."""
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), sequence().alias("seq"))
    return rows.select("*", F.expr(pick("id", FRAGMENT_LABELS)).alias("label"), *[F.expr(pick("id", v)).alias(k) for k, v in FRAGMENT_COLUMNS.items()])
