"""The report panels, each as one query."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqlens.functions import metadata
from seqlens.operators import relational
from seqlens.plans import metadata_queries as m
from seqlens.plans.bindings import GENUS, SPECIMENS, records
from seqlens.plans.catalog import query

S = f"WITH s0 AS ({SPECIMENS}), s AS (SELECT ord, label, confidence, source, titles, {m.host_name('host_q')} AS host, {m.NATION} AS country, {m.YEAR} AS year, {m.LABEL_GROUP} AS grp, {m.TECHNOLOGY} AS tech, {m.RECORD_TEXT} AS record_text, coalesce(titles, '') AS study_text FROM s0) "
KNOWN = "(label NOT LIKE 'novel%' AND label <> 'ST_unassigned' AND (label LIKE 'ST%' OR label LIKE 'NMAST%'))"


def rows(spark, sf):
    """Records with the columns of reports."""
    raw = metadata.country(F.col("geo_q"), F.col("country_q"))
    tech = metadata.technology(metadata.technology_text({n: F.col(n) for n in ("structured_comment", "comment", "features", "description", "name")}))
    return records(spark, sf).select(
        "ord", "accession", "label", "confidence", "source", metadata.normalise_host(F.col("host_q"), GENUS).alias("host"), metadata.normalise_country(raw).alias("country"), metadata.year(F.col("date_q")).alias("year"), metadata.label_group(F.col("label")).alias("grp"), tech.alias("tech"),
        metadata.coalesce_host(F.col("features"), F.col("organism"), GENUS)["host_source"].alias("host_source"), metadata.joined_text(*map(F.col, ("description", "note", "isolation_q", "host_q"))).alias("record_text"), F.coalesce("titles", F.lit("")).alias("study_text"),
    )


def known(spark, sf):
    return rows(spark, sf).where(metadata.is_known_label(F.col("label")))


def novel(spark, sf):
    return rows(spark, sf).where(F.col("label").startswith("novel_"))


def top(key: str, n: int, where: str = "true") -> str:
    return f"(SELECT {key} FROM (SELECT {key}, count(*) AS n FROM s WHERE {where} GROUP BY 1 ORDER BY n DESC, {key} LIMIT {n}))"


@query("q6_novel_sizes", S + "SELECT label, count(*) AS n FROM s WHERE label LIKE 'novel%' GROUP BY label")
def q6(spark, sf):
    return relational.counts(novel(spark, sf), "label")


NOVEL = ["novel_11", "novel_2"]


def by_novel(key: str, keep: str) -> str:
    w = f"label LIKE 'novel%' AND {keep}"
    return S + f"SELECT {key}, count(*) FILTER (label = 'novel_11') AS novel_11, count(*) FILTER (label = 'novel_2') AS novel_2 FROM s WHERE {w} AND {key} IN {top(key, 12, w)} GROUP BY {key}"


@query("q7_host_by_novel", by_novel("host", "host <> 'Unknown'"))
def q7(spark, sf):
    return relational.pivot_counts(relational.in_top(novel(spark, sf).where("host <> 'Unknown'"), "host", 12), "host", "label", NOVEL)


@query("q8_country_by_novel", by_novel("country", "country <> 'Unknown'"))
def q8(spark, sf):
    return relational.pivot_counts(relational.in_top(novel(spark, sf).where("country <> 'Unknown'"), "country", 12), "country", "label", NOVEL)


@query("q9_technology_by_novel", S + "SELECT label, tech, count(*) AS n FROM s WHERE label LIKE 'novel%' GROUP BY label, tech")
def q9(spark, sf):
    return relational.counts(novel(spark, sf), "label", "tech")


@query("q10_technology_share", S + "SELECT tech, count(*) AS n, 100.0::DOUBLE * count(*) / (SELECT count(*) FROM s) AS pct FROM s GROUP BY tech")
def q10(spark, sf):
    return relational.shares(rows(spark, sf).select("tech"), "tech")


@query("q11_technology_by_label", S + f"SELECT tech, label, count(*) AS n FROM s WHERE {KNOWN} GROUP BY tech, label")
def q11(spark, sf):
    return relational.counts(known(spark, sf), "tech", "label")


@query("q12_hosts_and_other", S + f"SELECT CASE WHEN host IN {top('host', 15, KNOWN)} THEN host ELSE 'Other' END AS host, count(*) AS n FROM s WHERE {KNOWN} AND host <> 'Unknown' GROUP BY 1")
def q12(spark, sf):
    return relational.top_with_other(known(spark, sf).where("host <> 'Unknown'").select("host"), "host", 15)


@query("q13_host_by_label", S + f"SELECT host, label, count(*) AS n FROM s WHERE {KNOWN} AND host <> 'Unknown' AND host IN {top('host', 12, KNOWN + ' AND host <> ' + chr(39) + 'Unknown' + chr(39))} GROUP BY host, label")
def q13(spark, sf):
    return relational.counts(relational.in_top(known(spark, sf).where("host <> 'Unknown'"), "host", 12), "host", "label")


@query("q14_top_countries", S + "SELECT country, count(*) AS n FROM s WHERE country <> 'Unknown' GROUP BY country ORDER BY n DESC, country LIMIT 15")
def q14(spark, sf):
    return relational.top_keys(rows(spark, sf).where("country <> 'Unknown'"), "country", 15)


@query("q15_country_by_label", S + f"SELECT country, label, count(*) AS n FROM s WHERE country <> 'Unknown' AND country IN {top('country', 12, 'country <> ' + chr(39) + 'Unknown' + chr(39))} GROUP BY country, label")
def q15(spark, sf):
    return relational.counts(relational.in_top(rows(spark, sf).where("country <> 'Unknown'"), "country", 12), "country", "label")


@query("q16_years_by_group", S + ", g AS (SELECT y::INTEGER AS year, grp FROM (SELECT unnest(range(min(year), max(year) + 1)) AS y FROM s), (SELECT DISTINCT grp FROM s WHERE year IS NOT NULL)), c AS (SELECT g.year, g.grp, count(s.ord) AS n FROM g LEFT JOIN s ON s.year = g.year AND s.grp = g.grp GROUP BY ALL) SELECT year, grp, n, coalesce(sum(n) OVER (PARTITION BY year ORDER BY grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM c")
def q16(spark, sf):
    own = relational.dense_counts(rows(spark, sf).where("year IS NOT NULL").select("year", "grp"), "year", "grp")
    return relational.stacked(own, "year", "grp", "n").select("year", "grp", "n", "base")


@query("q17_country_by_year", S + f", t AS (SELECT * FROM s WHERE year IS NOT NULL AND country <> 'Unknown' AND country IN {top('country', 10, 'year IS NOT NULL AND country <> ' + chr(39) + 'Unknown' + chr(39))}), g AS (SELECT y::INTEGER AS year, country FROM (SELECT unnest(range(min(year), max(year) + 1)) AS y FROM t), (SELECT DISTINCT country FROM t)) SELECT g.year, g.country, count(t.ord) AS n FROM g LEFT JOIN t ON t.year = g.year AND t.country = g.country GROUP BY ALL")
def q17(spark, sf):
    own = relational.in_top(rows(spark, sf).where("year IS NOT NULL AND country <> 'Unknown'"), "country", 10)
    return relational.dense_counts(own.select("year", "country"), "year", "country").select("year", "country", "n")


@query("q18_unknown_rates", S + "SELECT count(*) AS n, count(*) FILTER (country = 'Unknown') AS no_country, count(*) FILTER (year IS NULL) AS no_year, count(*) FILTER (host = 'Unknown') AS no_host, 100.0::DOUBLE * count(*) FILTER (country = 'Unknown') / count(*) AS no_country_pct FROM s")
def q18(spark, sf):
    missing = F.count_if(F.col("country") == "Unknown")
    return rows(spark, sf).agg(F.count(F.lit(1)).alias("n"), missing.alias("no_country"), F.count_if(F.col("year").isNull()).alias("no_year"), F.count_if(F.col("host") == "Unknown").alias("no_host"), (F.lit(100.0) * missing / F.count(F.lit(1))).alias("no_country_pct"))


CONFIDENCES = ["high", "low", "medium", "novel_cluster", "unplaced"]


@query("q19_pass_by_confidence", S + "SELECT source, " + ", ".join(f"count(*) FILTER (confidence = '{c}') AS {c}" for c in CONFIDENCES) + " FROM s GROUP BY source")
def q19(spark, sf):
    return relational.pivot_counts(rows(spark, sf).select("source", "confidence"), "source", "confidence", CONFIDENCES)


@query("q11_label_by_technology", S + f"SELECT l.label, t.tech, count(s.ord) AS n FROM (SELECT DISTINCT label FROM s WHERE {KNOWN}) l CROSS JOIN (SELECT DISTINCT tech FROM s WHERE {KNOWN}) t LEFT JOIN s ON s.label = l.label AND s.tech = t.tech GROUP BY ALL")
def q11_transposed(spark, sf):
    """The same the other way round, with a row for each pair, zeros too."""
    return relational.counted_grid(known(spark, sf), "label", "tech")


@query("q20_technology_long", S + "SELECT label, tech, count(*) AS n FROM s GROUP BY label, tech")
def q20(spark, sf):
    return relational.counts(rows(spark, sf), "label", "tech")


RUN_SQL = " UNION ALL ".join(f"SELECT '{c}' AS facet, {c} AS what, count(*) AS n, 100.0::DOUBLE * count(*) / (SELECT count(*) FROM s) AS pct, NULL AS top_hosts FROM s GROUP BY {c}" for c in ("confidence", "host_source", "tech"))
NOVEL_SQL = "SELECT 'novel' AS facet, label AS what, count(*) AS n, 100.0::DOUBLE * count(*) / (SELECT count(*) FROM s) AS pct, first(v) AS top_hosts FROM s JOIN (SELECT label, string_agg(host, ', ' ORDER BY n DESC, host) AS v FROM (SELECT label, host, count(*) AS n, row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, host) AS o FROM s GROUP BY label, host) WHERE o <= 2 GROUP BY label) USING (label) WHERE label LIKE 'novel%' GROUP BY label"


@query("q22_run_summary", S.replace(f"{m.TECHNOLOGY} AS tech", f"{m.TECHNOLOGY} AS tech, {m.HOST_SOURCE} AS host_source") + f"{RUN_SQL} UNION ALL {NOVEL_SQL} UNION ALL SELECT 'total', k, v, 100.0::DOUBLE, NULL FROM (SELECT unnest(['sequences', 'labels']) AS k, unnest([count(*), count(DISTINCT label)]) AS v FROM s)")
def q22(spark, sf):
    """What a run says at its end: shares by confidence, origin of hosts and technology, novel groups with their two foremost hosts, totals."""
    own = rows(spark, sf)
    facets = [relational.shares(own.select(F.col(c).alias("what")), "what").withColumn("facet", F.lit(c)) for c in ("confidence", "host_source", "tech")]
    facets.append(relational.shares(own.select(F.col("label").alias("what")), "what").where(F.col("what").startswith("novel_")).withColumn("facet", F.lit("novel")))
    foremost = relational.top_values(own.where(F.col("label").startswith("novel_")), "label", "host", 2, "hosts").select(F.lit("novel").alias("facet"), F.col("label").alias("what"), F.regexp_replace(F.regexp_replace("hosts", r":\d+; ", ", "), r":\d+$", "").alias("top_hosts"))
    total = own.agg(F.count(F.lit(1)).alias("sequences"), F.countDistinct("label").alias("labels")).unpivot([], ["sequences", "labels"], "what", "n").select("what", "n", F.lit(100.0).alias("pct"), F.lit("total").alias("facet"))
    out = facets[0]
    for part in (*facets[1:], total):
        out = out.unionByName(part)
    return out.join(foremost, ["facet", "what"], "left").select("facet", "what", "n", "pct", "top_hosts")


HUMAN = "host = 'Homo sapiens' AND label <> 'Unknown'"


def human(spark, sf, level: str):
    own = rows(spark, sf).where((F.col("host") == "Homo sapiens") & (F.col("label") != "Unknown"))
    return own.select("ord", "label", metadata.categories(metadata.classify(F.col(f"{level}_text"), evidence=False)).alias("cats"))


def crosstab_sql(level: str) -> str:
    return S + f", h AS (SELECT label, {m.listed(level + '_text')} AS cats FROM s WHERE {HUMAN}) SELECT label, cat, count(*) AS n FROM (SELECT label, unnest(string_split(cats, ';')) AS cat FROM h WHERE cats <> '') GROUP BY label, cat"


def crosstab(spark, sf, level: str):
    found = human(spark, sf, level).where("cats <> ''").select("label", F.explode(F.split("cats", ";")).alias("cat"))
    return relational.counts(found, "label", "cat")


@query("q27_context_by_label_record", crosstab_sql("record"))
def q27_record(spark, sf):
    return crosstab(spark, sf, "record")


@query("q27_context_by_label_study", crosstab_sql("study"))
def q27_study(spark, sf):
    return crosstab(spark, sf, "study")


@query("q28_annotated_rate", S + f", h AS (SELECT {m.listed('study_text')} AS cats FROM s WHERE {HUMAN}) SELECT count(*) AS n, count(*) FILTER (cats <> '') AS annotated, 100.0::DOUBLE * count(*) FILTER (cats <> '') / greatest(count(*), 1) AS pct FROM h")
def q28(spark, sf):
    hit = F.count_if(F.col("cats") != "")
    n = F.count(F.lit(1))
    return human(spark, sf, "study").agg(n.alias("n"), hit.alias("annotated"), (F.lit(100.0) * hit / F.greatest(n, F.lit(1))).alias("pct"))


@query("q29_drill_down", S + f", h AS (SELECT ord, label, {m.listed('study_text')} AS cats FROM s WHERE {HUMAN}) SELECT ord, label, cats FROM h WHERE contains(cats, 'colorectal_cancer')")
def q29(spark, sf):
    return human(spark, sf, "study").where(F.contains("cats", F.lit("colorectal_cancer")))


