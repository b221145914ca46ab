"""Queries over record metadata: filters, scalar functions, text mining."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from seqlens.functions import fixed, metadata
from seqlens.operators import acquisition, curation, relational
from seqlens.operators.components import shared_folder
from seqlens.operators.layout import spread
from seqlens.plans.bindings import GENUS, SPECIMENS, records, specimens, table
from seqlens.plans.catalog import query
from seqlens.sources import readers

S = f"WITH s AS ({SPECIMENS}) "


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def among(x: str, words: list[str]) -> str:
    return f"{x} IN ({', '.join(map(q, words))})"


GENERIC = [*fixed.GENERIC_HOSTS, f"{GENUS.lower()} sp.", f"{GENUS.lower()} hominis"]


def host_name(x: str) -> str:
    low = f"lower({strip(x)})"
    return f"CASE WHEN {x} IS NULL OR {among(low, GENERIC)} THEN 'Unknown' ELSE coalesce(CASE {low} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in fixed.HOSTS.items()) + f" END, {strip(x)}) END"


def shows(x: str, patterns: list[str]) -> str:
    return f"regexp_matches({x}, {q('(?i)(?:' + '|'.join(patterns) + ')')})"


KIND = f"lower(coalesce({strip('mol_q')}, ''))"
BAD = f"(NOT {among(KIND, fixed.MOLECULE_TYPES)} AND (contains({KIND}, 'protein') OR {KIND} = 'mrna'))"
PREDICTED = among("substr(accession, 1, 3)", fixed.PREDICTED_PREFIXES)
REASON = f"CASE WHEN {PREDICTED} THEN 'predicted' WHEN {BAD} THEN 'molecule_type' END"


@query("f1_predicted_records", S + f"SELECT accession FROM s WHERE {PREDICTED}")
def f1(spark, sf):
    return specimens(spark, sf).where(metadata.is_predicted(F.col("accession"))).select("accession")


@query("f2_bad_molecule_types", S + f"SELECT accession, {KIND} AS mol_type FROM s WHERE {BAD}")
def f2(spark, sf):
    return records(spark, sf).select("accession", metadata.bad_molecule(F.col("features")).alias("mol_type")).where("mol_type IS NOT NULL")


@query("f3_quality_filter", S + f"SELECT accession FROM s WHERE {REASON} IS NULL")
def f3(spark, sf):
    return curation.quality_filter(records(spark, sf)).select("accession")


@query("f3_drop_report", S + f"SELECT reason, count(*) AS n, array_to_string(list(accession ORDER BY ord)[1:5], ' ') AS examples FROM (SELECT *, {REASON} AS reason FROM s) WHERE reason IS NOT NULL GROUP BY reason")
def f3_report(spark, sf):
    return curation.drop_report(records(spark, sf)).select("reason", "n", F.array_join("examples", " ").alias("examples"))


@query("f4_length_filter", "SELECT doc_id, length(text) AS n FROM documents WHERE length(text) BETWEEN 1000 AND 2500")
def f4(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("seq"))
    return curation.length_filter(docs).select("doc_id", F.length("seq").cast("bigint").alias("n"))


@query("f5_lockstep_filter", "SELECT l.doc_id, l.quality FROM labels l SEMI JOIN (SELECT doc_id FROM documents WHERE length(text) BETWEEN 1000 AND 2500) d USING (doc_id)")
def f5(spark, sf):
    docs = curation.length_filter(table(spark, sf, "documents").select("doc_id", F.col("text").alias("seq")))
    return table(spark, sf, "labels").join(docs, "doc_id", "left_semi").select("doc_id", "quality")


@query("f6_length_classes", "SELECT CASE WHEN length(text) < 100 THEN 'too_short' WHEN length(text) <= 999 THEN 'short' WHEN length(text) <= 2500 THEN 'full_length' ELSE 'too_long' END AS class, count(*) AS n FROM documents GROUP BY 1")
def f6(spark, sf):
    return relational.counts(table(spark, sf, "documents").select(metadata.length_class(F.length("text")).alias("class")), "class")


@query("f7_known_metadata", S + f"SELECT ord, {host_name('host_q')} AS host, list_max(list_transform(regexp_extract_all(coalesce(date_q, ''), '(19[0-9]{{2}}|20[0-9]{{2}})'), lambda y: CAST(y AS INTEGER))) AS year FROM s WHERE {host_name('host_q')} <> 'Unknown' AND len(regexp_extract_all(coalesce(date_q, ''), '(19[0-9]{{2}}|20[0-9]{{2}})')) > 0")
def f7(spark, sf):
    rows = specimens(spark, sf).select("ord", metadata.normalise_host(F.col("host_q"), GENUS).alias("host"), metadata.year(F.col("date_q")).alias("year"))
    return rows.where("host <> 'Unknown' AND year IS NOT NULL")


@query("f8_known_labels", S + "SELECT ord, label FROM s WHERE label NOT LIKE 'novel\\_%' ESCAPE '\\' AND label <> 'ST_unassigned' AND (label LIKE 'ST%' OR label LIKE 'NMAST%')")
def f8(spark, sf):
    return specimens(spark, sf).where(metadata.is_known_label(F.col("label"))).select("ord", "label")


@query("f9_novel_labels", S + "SELECT ord, label FROM s WHERE starts_with(label, 'novel_')")
def f9(spark, sf):
    return specimens(spark, sf).where(F.col("label").startswith("novel_")).select("ord", "label")


@query("f10_not_in", S + "SELECT ord, confidence FROM s WHERE confidence NOT IN ('unplaced', 'low')")
def f10(spark, sf):
    return specimens(spark, sf).where(~F.col("confidence").isin("unplaced", "low")).select("ord", "confidence")


@query("f11_contains", S + "SELECT ord, titles FROM s WHERE coalesce(contains(titles, 'colorectal'), false)")
def f11(spark, sf):
    return specimens(spark, sf).where(F.coalesce(F.contains("titles", F.lit("colorectal")), F.lit(False))).select("ord", "titles")


@query("f12_human_with_label", S + f"SELECT ord FROM s WHERE {host_name('host_q')} = 'Homo sapiens' AND label <> 'Unknown'")
def f12(spark, sf):
    return specimens(spark, sf).where((metadata.normalise_host(F.col("host_q"), GENUS) == "Homo sapiens") & (F.col("label") != "Unknown")).select("ord")


REGISTRY_VALUES = "(VALUES " + ", ".join(f"({q(a)}, {q(b)}, {c == 'yes'}, {q(d)})" for a, b, c, d in fixed.REGISTRY) + ") AS r(label, status, human, note)"


@query("f13_label_selection", f"SELECT label, status FROM {REGISTRY_VALUES} WHERE NOT starts_with(label, 'NMAST') AND status IN ('accepted', 'tentative')")
def f13(spark, sf):
    return curation.registry(spark).where(F.col("label").isin(curation.selected_labels(statuses="accepted, tentative"))).select("label", "status")


@query("f14_nonzero_rows", "SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') AS r, count(*) FILTER (l_returnflag = 'A') AS a FROM lineitem GROUP BY l_suppkey HAVING greatest(count(*) FILTER (l_returnflag = 'R'), count(*) FILTER (l_returnflag = 'A')) > 0")
def f14(spark, sf):
    rows = relational.pivot_counts(table(spark, sf, "lineitem"), "l_suppkey", "l_returnflag", ["R", "A"]).where(F.greatest("R", "A") > 0)
    return rows.select("l_suppkey", F.col("R").alias("r"), F.col("A").alias("a"))


TOLD = "lower(concat_ws(' ', technology_q, note, mol_q, isolation_q, description, name))"
TECHNOLOGY = "CASE " + " ".join(f"WHEN {shows(TOLD, p)} THEN {q(n)}" for n, p in fixed.TECHNOLOGIES) + " ELSE 'Unknown' END"


@query("s4_narrow_search", S + "SELECT ord FROM s WHERE contains(lower(description), 'subtype 7') OR contains(lower(description), 'st7') OR contains(lower(description), 'st 7')")
def s4(spark, sf):
    return specimens(spark, sf).where(readers.contains_any(F.col("description"), readers.label_titles("ST7"))).select("ord")


@query("x1_technology", S + f"SELECT ord, {TECHNOLOGY} AS seq_tech FROM s")
def x1(spark, sf):
    return records(spark, sf).select("ord", curation.metadata_columns(GENUS)["seq_tech"].alias("seq_tech"))


@query("x2_normalise_host", S + f"SELECT ord, {host_name('host_q')} AS host FROM s")
def x2(spark, sf):
    return specimens(spark, sf).select("ord", metadata.normalise_host(F.col("host_q"), GENUS).alias("host"))


LOW = f"lower({strip('isolation_q')})"
ANIMAL = f"({among(LOW, list(fixed.HOSTS))} OR regexp_matches({LOW}, {q(chr(92) + 'b(?:' + '|'.join(fixed.ANIMAL_WORDS) + ')' + chr(92) + 'b')}) OR regexp_matches({LOW}, '^[a-z]+\\s+[a-z]+$'))"
SAMPLE = f"regexp_matches({LOW}, {q(chr(92) + 'b(?:' + '|'.join(fixed.SAMPLE_WORDS) + ')' + chr(92) + 'b')})"
CAPTURED = f"regexp_extract(note, {q('(?i)' + fixed.NOTE_HOSTS[0])}, 1)"
NOTED = f"""CASE WHEN {shows('note', fixed.NOTE_HOSTS[:1])} AND NOT {among(f'lower(trim({CAPTURED}))', GENERIC)} THEN concat(upper(substr(trim({CAPTURED}), 1, 1)), lower(substr(trim({CAPTURED}), 2)))
 WHEN {shows('note', fixed.NOTE_HOSTS[1:])} THEN 'Human' END"""
SPECIES = "CASE " + " ".join(f"WHEN contains(lower(organism), {q(f'{GENUS.lower()} {s}')}) THEN {q(h)}" for s, h in fixed.SPECIES_HOSTS.items()) + " END"
HOST_SOURCE = f"""CASE WHEN nullif({strip('host_q')}, '') IS NOT NULL AND NOT {among(f'lower({strip("host_q")})', GENERIC)} THEN 'host_qualifier'
 WHEN nullif({LOW}, '') IS NOT NULL AND NOT {among(LOW, GENERIC)} AND {ANIMAL} AND NOT {SAMPLE} THEN 'isolation_source'
 WHEN {NOTED} IS NOT NULL THEN 'note' WHEN {SPECIES} IS NOT NULL THEN 'organism' ELSE 'unknown' END"""
RAW_HOST = f"CASE {HOST_SOURCE} WHEN 'host_qualifier' THEN {strip('host_q')} WHEN 'isolation_source' THEN {strip('isolation_q')} WHEN 'note' THEN {NOTED} WHEN 'organism' THEN {SPECIES} ELSE 'Unknown' END"


@query("x3_coalesce_host", S + f"SELECT ord, {RAW_HOST} AS host, {HOST_SOURCE} AS host_source FROM s")
def x3(spark, sf):
    return records(spark, sf).select("ord", metadata.coalesce_host(F.col("features"), F.col("organism"), GENUS).alias("h")).select("ord", "h.host", "h.host_source")


COUNTRY = f"coalesce(nullif({strip('geo_q')}, ''), nullif({strip('country_q')}, ''), 'Unknown')"
H = S + f", h AS (SELECT *, {RAW_HOST} AS raw_host, {HOST_SOURCE} AS raw_source, {TECHNOLOGY} AS tech FROM s) "
BLOCK = f"{host_name('raw_host')} AS host, raw_source AS host_source, {COUNTRY} AS country, coalesce(date_q, 'Unknown') AS collection_date, coalesce(isolation_q, 'Unknown') AS isolation_source, tech AS seq_tech, md5(upper(seq)) AS md5, length(seq) AS length"


@query("x4_metadata_block", H + f"SELECT ord, {BLOCK} FROM h")
def x4(spark, sf):
    return records(spark, sf).select("ord", *[c.alias(n) for n, c in curation.metadata_columns(GENUS).items()])


LABEL_TEXT = "concat_ws(' ', note, name, substr(description, 1, 120))"
DECLARED = f"list_sort(list_distinct(list_transform(list_concat(list_concat(regexp_extract_all({LABEL_TEXT}, '(?i)\\bsubtype\\s*(\\d+)\\b', 1), regexp_extract_all({LABEL_TEXT}, '\\bST\\s*(\\d+)\\b', 1)), regexp_extract_all({LABEL_TEXT}, '(?i)\\b(?:{GENUS}\\s+sp\\.?\\s*)?ST(\\d+)[-_]', 1)), lambda x: concat('ST', CAST(x AS BIGINT)))))"


@query("x5_declared_labels", S + f"SELECT ord, array_to_string({DECLARED}, ',') AS declared FROM s")
def x5(spark, sf):
    declared = metadata.declared_labels(F.col("features"), F.col("name"), F.col("description"), GENUS)
    return records(spark, sf).select("ord", F.array_join(declared, ",").alias("declared"))


@query("x6_validate_claim", S + f"""SELECT ord, CASE WHEN starts_with(label, 'NMAST') OR len(d) = 0 THEN 'low' WHEN list_contains(d, label) AND len(d) = 1 THEN 'high' WHEN list_contains(d, label) THEN 'medium' ELSE 'rejected' END AS confidence,
 starts_with(label, 'NMAST') OR len(d) = 0 OR list_contains(d, label) AS keep FROM (SELECT ord, label, {DECLARED} AS d FROM s)""")
def x6(spark, sf):
    declared = metadata.declared_labels(F.col("features"), F.col("name"), F.col("description"), GENUS)
    return records(spark, sf).select("ord", metadata.validate_claim(declared, F.col("label")).alias("v")).select("ord", "v.confidence", "v.keep")


HEADER = "concat(description, ' [subtype=', label, '] [host=', coalesce(host_q, 'Unknown'), '] [country=', " + COUNTRY + ", '] [date=', coalesce(date_q, 'Unknown'), '] [isolation_source=', coalesce(isolation_q, 'Unknown'), '] [seq_tech=', coalesce(technology_q, 'Unknown'), '] [confidence=', confidence, '] [host_source=', source, ']')"


def headers(spark, sf):
    f = F.col("features")
    s = metadata.first_source(f)
    tags = {"subtype": F.col("label"), "host": F.col("host_q"), "country": metadata.country(metadata.qualifier(s, "geo_loc_name"), metadata.qualifier(s, "country")), "date": F.col("date_q"), "isolation_source": F.col("isolation_q"), "seq_tech": F.col("technology_q"), "confidence": F.col("confidence"), "host_source": F.col("source")}
    return records(spark, sf).withColumn("header", metadata.header(F.col("description"), tags))


@query("x7_parse_tags", S + f", h AS (SELECT ord, {HEADER} AS header FROM s) SELECT ord, " + ", ".join(f"coalesce(nullif(trim(regexp_extract(header, '\\[{t}=([^\\]]+)\\]', 1)), ''), 'Unknown') AS {t}" for t in ("subtype", "country", "confidence")) + " FROM h")
def x7(spark, sf):
    return headers(spark, sf).select("ord", *[metadata.tag(F.col("header"), t).alias(t) for t in ("subtype", "country", "confidence")])


@query("x8_header", S + f"SELECT ord, {HEADER} AS header FROM s")
def x8(spark, sf):
    return headers(spark, sf).select("ord", "header")


NUMBER = "coalesce(TRY_CAST(nullif(regexp_extract(label, '\\d+'), '') AS BIGINT), 0)"
GROUP = "CASE WHEN starts_with(label, 'NMAST') THEN 1 WHEN starts_with(label, 'novel') THEN 2 WHEN label = 'ST_unassigned' THEN 8 WHEN starts_with(label, 'ST') THEN 0 ELSE 9 END"


@query("x9_natural_order", S + f"SELECT label, {GROUP} AS grp, CASE WHEN {GROUP} < 8 THEN {NUMBER} ELSE 0 END AS num, row_number() OVER (ORDER BY {GROUP}, CASE WHEN {GROUP} < 8 THEN {NUMBER} ELSE 0 END, label) AS place FROM (SELECT DISTINCT label FROM s)")
def x9(spark, sf):
    g, n, t = metadata.natural_order(F.col("label"))
    rows = specimens(spark, sf).select("label").distinct()
    return relational.ranked(rows, [g, n, t], "place").select("label", g.alias("grp"), n.alias("num"), "place")


HEAD = f"{strip('split_part(' + strip('split_part(' + COUNTRY + ', chr(58), 1)') + ', chr(44), 1)')}"
NATION = f"coalesce(nullif({HEAD}, ''), 'Unknown')"


@query("x10_normalise_country", S + f"SELECT ord, {NATION} AS country FROM s")
def x10(spark, sf):
    raw = metadata.country(F.col("geo_q"), F.col("country_q"))
    return specimens(spark, sf).select("ord", metadata.normalise_country(raw).alias("country"))


YEAR = "list_max(list_transform(regexp_extract_all(coalesce(date_q, ''), '(19[0-9]{2}|20[0-9]{2})'), lambda y: CAST(y AS INTEGER)))"


@query("x11_year", S + f"SELECT ord, coalesce({YEAR}, 0) AS year FROM s")
def x11(spark, sf):
    return specimens(spark, sf).select("ord", F.coalesce(metadata.year(F.col("date_q")), F.lit(0)).alias("year"))


LABEL_GROUP = "CASE WHEN starts_with(label, 'novel_') THEN 'novel candidates' WHEN label = 'ST_unassigned' THEN 'ST_unassigned' WHEN label IN ('ST1', 'ST2', 'ST3') THEN 'ST1-ST3 (dominant human)' WHEN label IN ('ST4', 'ST5', 'ST6', 'ST7', 'ST8', 'ST9') THEN 'ST4-ST9 (frequent)' ELSE 'other STs' END"


@query("x12_label_group", S + f"SELECT {LABEL_GROUP} AS grp, count(*) AS n FROM s GROUP BY 1")
def x12(spark, sf):
    return relational.counts(specimens(spark, sf).select(metadata.label_group(F.col("label")).alias("grp")), "grp")


STATUS = "CASE WHEN starts_with(s.label, 'novel_') THEN 'novel' WHEN s.label = 'ST_unassigned' THEN 'unassigned' ELSE coalesce(status, 'unknown') END"


@query("x13_registry_status", S + f"SELECT ord, {STATUS} AS st_status, coalesce(human, false) AS human_report, coalesce(r.note, '') AS st_note FROM s LEFT JOIN {REGISTRY_VALUES} ON s.label = r.label")
def x13(spark, sf):
    rows = specimens(spark, sf).select("ord", F.col("label").alias("subtype"))
    return curation.enriched(rows).select("ord", "st_status", "human_report", "st_note")


@query("x14_bare_accession", S + "SELECT ord, split_part(accession, '.', 1) AS bare FROM s")
def x14(spark, sf):
    return specimens(spark, sf).select("ord", metadata.bare_accession(F.col("accession")).alias("bare"))


def hits(x: str) -> dict[str, str]:
    """DuckDB: whether each category stays after the two rules."""
    raw = {c: f"regexp_matches({x}, {q('(?i)' + p)})" for c, p in fixed.DISEASES.items()}
    number = " + ".join(f"CAST({r} AS INTEGER)" for r in raw.values())
    kept = dict(raw)
    kept[fixed.WEAK_DISEASE] = f"({raw[fixed.WEAK_DISEASE]} AND {number} = 1)"
    kept[fixed.GENERAL_DISEASE] = f"({raw[fixed.GENERAL_DISEASE]} AND NOT {raw[fixed.SPECIAL_DISEASE]})"
    return kept


def listed(x: str, evidence: bool = False) -> str:
    parts = [f"CASE WHEN {k} THEN " + (f"concat('{c}=', regexp_extract({x}, {q('(?i)' + fixed.DISEASES[c])}))" if evidence else f"'{c}'") + " END" for c, k in hits(x).items()]
    return f"concat_ws(';', {', '.join(parts)})"


TITLES = "coalesce(titles, '')"
RECORD_TEXT = "concat_ws(' | ', description, note, isolation_q, host_q)"


@query("x15_classify", S + f"SELECT ord, {listed(TITLES)} AS categories, {listed(TITLES, True)} AS evidence FROM s")
def x15(spark, sf):
    found = specimens(spark, sf).select("ord", metadata.classify(F.coalesce("titles", F.lit(""))).alias("h"))
    return found.select("ord", metadata.categories(F.col("h")).alias("categories"), metadata.evidence(F.col("h")).alias("evidence"))


@query("x15_classify_documents", f"SELECT {listed('text')} AS categories, count(*) AS n FROM documents GROUP BY 1")
def x15_documents(spark, sf):
    return relational.counts(spread(table(spark, sf, "documents").select("text")).select(metadata.categories(metadata.classify(F.col("text"), evidence=False)).alias("categories")), "categories")


@query("x16_join_lists", "SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def x16(spark, sf):
    return table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ";").alias("names"))


@query("x17_record_text", S + f"SELECT ord, {RECORD_TEXT} AS record_text FROM s")
def x17(spark, sf):
    return specimens(spark, sf).select("ord", metadata.joined_text(*map(F.col, ("description", "note", "isolation_q", "host_q"))).alias("record_text"))


@query("x18_hover", S + "SELECT ord, concat('Accession: ', accession, '<br>Subtype: ', label, '<br>Host: ', coalesce(host_q, 'Unknown')) AS hover FROM s")
def x18(spark, sf):
    return specimens(spark, sf).select("ord", metadata.hover([("Accession", F.col("accession")), ("Subtype", F.col("label")), ("Host", F.col("host_q"))]).alias("hover"))


@query("x20_content_hash", "SELECT doc_id, md5(upper(replace(text, 'ß', 'SS'))) AS md5 FROM documents")
def x20(spark, sf):
    return table(spark, sf, "documents").select("doc_id", metadata.content_hash(F.col("text")).alias("md5"))


@query("x22_normal_forms", S + f"SELECT ord, lower({strip('host_q')}) AS low, upper({strip('host_q')}) AS up FROM s")
def x22(spark, sf):
    host = metadata.strip(F.col("host_q"))
    return specimens(spark, sf).select("ord", F.lower(host).alias("low"), F.upper(host).alias("up"))


@query("x23_rounding", "SELECT l_orderkey, l_linenumber, floor(l_extendedprice * (1 - l_discount) * 100 + 0.5) / 100 AS net FROM lineitem")
def x23(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100 + 0.5) / 100).alias("net"))


@query("c1_label_records", S + f"""SELECT ord, label, confidence FROM (SELECT ord, CASE WHEN source = 'curated_reference' THEN CASE split_part(accession, '.', 1) WHEN 'AB070987' THEN 'ST1' WHEN 'U51151' THEN 'ST1' END WHEN len(d) > 0 THEN list_min(d) END AS label,
 CASE WHEN source = 'curated_reference' THEN source WHEN len(d) = 1 THEN 'high' WHEN len(d) > 1 THEN 'medium' END AS confidence, source FROM (SELECT ord, source, accession, {DECLARED} AS d FROM s)) WHERE source <> 'curated_reference' OR label IS NOT NULL""")
def c1(spark, sf):
    return curation.labelled(records(spark, sf).drop("label", "confidence"), GENUS).select("ord", "label", "confidence")


@query("c2_seeds", S + f"SELECT ord, list_min(d) AS label FROM (SELECT ord, source, {DECLARED} AS d FROM s) WHERE source <> 'curated_reference' AND len(d) = 1")
def c2(spark, sf):
    return curation.seeds(curation.labelled(records(spark, sf).drop("label", "confidence"), GENUS)).select("ord", "label")


@query("c15_manifest", H + f"SELECT accession, label AS subtype, confidence AS st_confidence, source AS acquisition_pass, '' AS st_validation, 'all' AS ncbi_query, {BLOCK} FROM h")
def c15(spark, sf):
    row = curation.manifest_row(GENUS, F.col("label"), F.col("confidence"), F.lit(""), F.lit(""))
    return records(spark, sf).select(*row).drop("retrieved_at_utc")


GENE = S + ", t AS (SELECT * REPLACE (concat(description, ' 18S rRNA gene') AS description) FROM s)"
#: The steps of a run over records of 28 to 31 letters, each with what it drops or finds.
STEPS = S + f""", r AS (SELECT *, {REASON} AS reason, {DECLARED} AS d FROM s), g AS (SELECT * FROM r WHERE reason IS NULL), k AS (SELECT * FROM g WHERE length(seq) BETWEEN 28 AND 31),
l AS (SELECT d, source, CASE WHEN source = 'curated_reference' THEN split_part(accession, '.', 1) IN ('AB070987', 'U51151') ELSE len(d) > 0 END AS known FROM k), m AS (SELECT * FROM l WHERE known OR source <> 'curated_reference')
SELECT * FROM (SELECT 'read' AS step, unnest([('n', count(*)), ('predicted', count(*) FILTER (reason = 'predicted')), ('molecule_type', count(*) FILTER (reason = 'molecule_type'))]) AS x FROM r
UNION ALL SELECT 'quality', unnest([('n', count(*)), ('too_short', count(*) FILTER (length(seq) < 28)), ('too_long', count(*) FILTER (length(seq) > 31))]) FROM g
UNION ALL SELECT 'length', unnest([('n', count(*)), ('curated', count(*) FILTER (source = 'curated_reference'))]) FROM k
UNION ALL SELECT 'labelled', unnest([('n', count(*)), ('declared', count(*) FILTER (known)), ('undeclared', count(*) FILTER (NOT known)), ('seeds', count(*) FILTER (source = 'curated_reference' OR len(d) = 1))]) FROM m)"""
K10 = f"SELECT step, x[1] AS what, CAST(x[2] AS BIGINT) AS n FROM ({STEPS})"


@query("k10_step_counts", K10)
def k10(spark, sf):
    """What each step of a run saw and dropped, observed while its rows were written."""
    counts = curation.StepCounts()
    rows = curation.prepared(records(spark, sf).drop("label", "confidence"), GENUS, 28, 31, counts)
    rows.select("accession", "label", "confidence").write.parquet(f"{shared_folder(spark)}/labelled-{uuid.uuid4().hex}")
    return counts.table(spark)


NAMED = GENE + f""", h AS (SELECT *, {RAW_HOST} AS raw_host, {HOST_SOURCE} AS raw_source, {TECHNOLOGY} AS tech, {DECLARED} AS d FROM t WHERE contains(lower(description), 'subtype 7') OR contains(lower(description), 'st7') OR contains(lower(description), 'st 7'))"""
NARROW = NAMED + f"""
SELECT accession, 'ST7' AS subtype, CASE WHEN len(d) = 0 THEN 'low' WHEN len(d) = 1 THEN 'high' ELSE 'medium' END AS st_confidence, 'pass1_narrow' AS acquisition_pass, {q(readers.narrow_query(GENUS, "ST7"))} AS ncbi_query, {BLOCK} FROM h WHERE len(d) = 0 OR list_contains(d, 'ST7')"""
PLAIN = "replace(replace(upper(seq), '-', ''), 'N', '')"
#: What a broad search adds to NARROW: new records placed among it by their nearest, the first of each content.
SECOND = NAMED + f""", first AS MATERIALIZED (SELECT accession, seq, md5(upper(seq)) AS md5 FROM h WHERE len(d) = 0 OR list_contains(d, 'ST7')),
rest AS MATERIALIZED (SELECT ord, accession, seq, md5(upper(seq)) AS md5 FROM t WHERE source = 'broad_query' AND length(seq) BETWEEN 1 AND {fixed.MAX_LENGTH} AND accession NOT IN (SELECT accession FROM first) AND split_part(accession, '.', 1) NOT IN (SELECT split_part(accession, '.', 1) FROM first)
  AND NOT {among("split_part(accession, '.', 1)", sorted({a.split(".")[0] for a in fixed.CURATED_LABELS}))}),
k AS (SELECT accession, unnest(list_distinct([substr({PLAIN}, i, 8) FOR i IN range(1, length({PLAIN}) - 6)])) AS kmer FROM (SELECT accession, seq FROM first UNION ALL SELECT accession, seq FROM rest)),
n AS (SELECT accession, count(*) AS n FROM k GROUP BY 1),
c AS (SELECT a.accession AS x, b.accession AS y, count(*) AS s FROM k a JOIN k b USING (kmer) WHERE a.accession IN (SELECT accession FROM rest) AND b.accession IN (SELECT accession FROM first) GROUP BY 1, 2),
p AS (SELECT x AS accession, min(1.0::DOUBLE - s::DOUBLE / (u.n + v.n - s)) AS d FROM c JOIN n u ON u.accession = x JOIN n v ON v.accession = y GROUP BY 1),
g AS (SELECT rest.*, d, CASE WHEN d > 0.15 THEN 'low' WHEN d > 0.08 THEN 'medium' ELSE 'high' END AS st_confidence FROM rest JOIN p USING (accession) WHERE d <= 0.9 AND md5 NOT IN (SELECT md5 FROM first))
SELECT accession, 'ST7' AS subtype, st_confidence, 'pass2_placement' AS acquisition_pass, concat('placement_', st_confidence, ' (d=', printf('%.3f', floor(d * 1000 + 0.5) / 1000), ')') AS st_validation, {q(readers.broad_query(GENUS))} AS ncbi_query, md5 FROM g QUALIFY row_number() OVER (PARTITION BY md5 ORDER BY ord) = 1"""


def gene_records(spark, sf):
    return records(spark, sf).withColumn("description", F.concat("description", F.lit(" 18S rRNA gene")))


@query("c10_narrow_pass", NARROW)
def c10(spark, sf):
    return acquisition.narrow_pass(gene_records(spark, sf), "ST7", GENUS).drop("ord", "seq", "st_validation", "retrieved_at_utc")


@query("c11_second_pass", SECOND)
def c11(spark, sf):
    """What references and the broad search add to a first pass for ST7."""
    own = gene_records(spark, sf)
    first = acquisition.narrow_pass(own, "ST7", GENUS)
    return acquisition.second_pass(first, own.where("source = 'curated_reference'"), own.where("source = 'broad_query'"), GENUS, min_length=1, max_dist=0.9).select("accession", "subtype", "st_confidence", "acquisition_pass", "st_validation", "ncbi_query", "md5")


@query("s12_resumed_run", S + "SELECT ord, accession FROM s WHERE confidence = 'high'")
def s12(spark, sf):
    """A step that is entered twice: the second time its table is read."""
    path = f"{shared_folder(spark)}/step-{uuid.uuid4().hex}"
    step = lambda: specimens(spark, sf).where("confidence = 'high'").select("ord", "accession")
    acquisition.resumed(spark, path, step)
    return acquisition.resumed(spark, path, lambda: step().limit(0))
