"""Queries over joins, aggregates, reshaping, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seqlens.functions import fixed, metadata
from seqlens.operators import curation, relational
from seqlens.plans.bindings import SPECIMENS, specimens, table
from seqlens.plans.catalog import query

S = f"WITH s AS ({SPECIMENS}) "
BIG = "bigint"


@query("j1_inner_join", "SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id)")
def j1(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")


@query("j2_left_join", "SELECT doc_id, coalesce(toxic, -1) AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def j2(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left").select("doc_id", F.coalesce("toxic", F.lit(-1)).alias("toxic"))


@query("j3_lookup_with_default", "SELECT o_orderkey, coalesce(c_mktsegment, '?') AS segment FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def j3(spark, sf):
    rich = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"))
    return relational.lookup(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), rich, "o_custkey", "segment", "?").select("o_orderkey", "segment")


@query("j4_dimension_join", "SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def j4(spark, sf):
    nation = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "n_name", "r_name")


@query("j6_either_key", S + ", m AS (SELECT DISTINCT split_part(accession, '.', 1) AS k FROM s WHERE ord % 3 = 0) SELECT ord FROM s WHERE accession IN (SELECT k FROM m) OR split_part(accession, '.', 1) IN (SELECT k FROM m)")
def j6(spark, sf):
    rows = specimens(spark, sf)
    known = rows.where("ord % 3 = 0").select(metadata.bare_accession(F.col("accession")).alias("k")).distinct()
    full, bare = known.withColumn("f", F.lit(1)), known.select(F.col("k").alias("kb"), F.lit(1).alias("b"))
    joined = rows.join(full, rows["accession"] == F.col("k"), "left").join(bare, metadata.bare_accession(rows["accession"]) == F.col("kb"), "left")
    return joined.where(F.coalesce("f", "b").isNotNull()).select("ord")


@query("j7_first_containing", S + "SELECT ord, CASE WHEN contains(lower(organism), 'hominis') THEN 'a' WHEN contains(lower(organism), 'ratti') THEN 'b' WHEN contains(lower(organism), 'sp.') THEN 'c' ELSE 'none' END AS found FROM s")
def j7(spark, sf):
    name = F.lower("organism")
    found = F.coalesce(*[F.when(F.contains(name, F.lit(k)), F.lit(v)) for k, v in (("hominis", "a"), ("ratti", "b"), ("sp.", "c"))], F.lit("none"))
    return specimens(spark, sf).select("ord", found.alias("found"))


@query("j8_anti_join_known", S + ", k AS (SELECT accession FROM s WHERE confidence = 'high') SELECT ord FROM s WHERE accession NOT IN (SELECT accession FROM k) AND split_part(accession, '.', 1) NOT IN (SELECT split_part(accession, '.', 1) FROM k)")
def j8(spark, sf):
    rows = specimens(spark, sf)
    return relational.without_known(rows, rows.where("confidence = 'high'").select("accession"), "accession").select("ord")


@query("j9_customers_without_open_orders", "SELECT c_custkey FROM customer ANTI JOIN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') ON c_custkey = o_custkey")
def j9(spark, sf):
    pending = table(spark, sf, "orders").where("o_orderstatus = 'P'")
    return table(spark, sf, "customer").join(pending, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("j10_semi_join", "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey")
def j10(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


TOP5 = "SELECT source FROM (SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 5)"


@query("j11_in_top_keys", f"SELECT doc_id FROM documents WHERE source IN ({TOP5})")
def j11(spark, sf):
    return relational.in_top(table(spark, sf, "documents").select("doc_id", "source"), "source", 5).select("doc_id")


@query("j16_newest_wins", "WITH p AS (SELECT l_orderkey AS k, sum(l_quantity) AS v FROM lineitem GROUP BY 1), n AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderstatus = 'F') SELECT k, v FROM n UNION ALL SELECT k, v FROM p WHERE k NOT IN (SELECT k FROM n)")
def j16(spark, sf):
    prior = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_quantity").alias("v"))
    new = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    return relational.merge_newest(prior, new, "k")


@query("c14_prior_wins", S + ", p AS (SELECT * FROM s WHERE confidence = 'high') SELECT accession, label FROM p UNION ALL SELECT accession, concat(label, '!') FROM s WHERE accession NOT IN (SELECT accession FROM p)")
def c14(spark, sf):
    rows = specimens(spark, sf)
    prior = rows.where("confidence = 'high'").select("accession", "label")
    return relational.merge_prior(prior, rows.select("accession", F.concat("label", F.lit("!")).alias("label")), "accession")


@query("j17_join_on_id", "SELECT vec_id, label, len(embedding) AS n FROM embeddings JOIN documents ON vec_id = doc_id")
def j17(spark, sf):
    return table(spark, sf, "embeddings").join(table(spark, sf, "documents"), F.col("vec_id") == F.col("doc_id")).select("vec_id", "label", F.size("embedding").cast(BIG).alias("n"))


@query("g1_value_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def g1(spark, sf):
    return relational.counts(table(spark, sf, "events"), "event_type")


@query("g2_two_keys", "SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source")
def g2(spark, sf):
    return relational.counts(table(spark, sf, "documents"), "lang", "source")


@query("g3_named_aggregates", "SELECT l_returnflag, count(*) AS n, median(l_extendedprice) AS median_price, count(*) FILTER (l_linestatus = 'F') AS f FROM lineitem GROUP BY l_returnflag")
def g3(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.percentile("l_extendedprice", 0.5).alias("median_price"), F.count_if(F.col("l_linestatus") == "F").alias("f"))


@query("g6_distinct_counts", "SELECT count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderpriority) AS priorities FROM orders")
def g6(spark, sf):
    return table(spark, sf, "orders").agg(F.count_distinct("o_custkey").alias("customers"), F.count_distinct("o_orderpriority").alias("priorities"))


@query("g7_conditional_counts", "SELECT quality, count(*) FILTER (toxic = 1) AS toxic, count(*) FILTER (toxic = 0) AS clean FROM labels GROUP BY quality")
def g7(spark, sf):
    return table(spark, sf, "labels").groupBy("quality").agg(F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("toxic") == 0).alias("clean"))


@query("g8_shared_hashes", "SELECT md5(text) AS h, string_agg(DISTINCT source, ',' ORDER BY source) AS labels FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1")
def g8(spark, sf):
    rows = table(spark, sf, "documents").select(F.md5("text").alias("h"), "source")
    return relational.shared_keys(rows, "h", "source").select("h", F.array_join("labels", ",").alias("labels"))


@query("g9_top_values", "SELECT lang, string_agg(concat(source, ':', n), '; ' ORDER BY n DESC, source) AS top FROM (SELECT lang, source, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, source) AS r FROM documents GROUP BY lang, source) WHERE r <= 3 GROUP BY lang")
def g9(spark, sf):
    return relational.top_values(table(spark, sf, "documents"), "lang", "source", 3, "top")


PAIRS = "SELECT a.source AS label_a, b.source AS label_b, count(DISTINCT a.h) AS shared FROM (SELECT DISTINCT md5(text) AS h, source FROM documents) a JOIN (SELECT DISTINCT md5(text) AS h, source FROM documents) b ON a.h = b.h AND a.source < b.source GROUP BY 1, 2"


@query("g10_label_pairs", PAIRS)
def g10(spark, sf):
    return relational.shared_pairs(table(spark, sf, "documents").select(F.md5("text").alias("h"), "source"), "h", "source")


@query("q30_duplicate_report", PAIRS + " ORDER BY shared DESC, label_a, label_b LIMIT 10")
def q30(spark, sf):
    return relational.shared_pairs(table(spark, sf, "documents").select(F.md5("text").alias("h"), "source"), "h", "source", 10)


@query("g11_shares", "SELECT event_type, count(*) AS n, 100.0::DOUBLE * count(*) / (SELECT count(*) FROM events) AS pct FROM events GROUP BY event_type")
def g11(spark, sf):
    return relational.shares(table(spark, sf, "events"), "event_type")


@query("g14_dominant", "SELECT source, max_by(lang, n * 1000 - ascii(lang)) AS dominant, max(n)::DOUBLE / sum(n)::DOUBLE AS share FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang) GROUP BY source")
def g14(spark, sf):
    own = relational.counts(table(spark, sf, "documents"), "source", "lang")
    order = F.struct(F.col("n") * 1000 - F.ascii("lang"))
    return own.groupBy("source").agg(F.max_by("lang", order).alias("dominant"), (F.max("n") / F.sum("n")).alias("share"))


@query("g15_first_per_key", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def g15(spark, sf):
    return relational.first_per_key(table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query("g16_range", "SELECT min(year(o_orderdate)) AS first, max(year(o_orderdate)) AS last FROM orders")
def g16(spark, sf):
    y = F.year("o_orderdate").cast(BIG)
    return table(spark, sf, "orders").agg(F.min(y).alias("first"), F.max(y).alias("last"))


@query("g17_row_sums", "SELECT c_nationkey, sum(n)::BIGINT AS n FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL) GROUP BY c_nationkey")
def g17(spark, sf):
    return relational.counts(table(spark, sf, "customer"), "c_nationkey", "c_mktsegment").groupBy("c_nationkey").agg(F.sum("n").alias("n"))


@query("g18_confidence_counters", S + "SELECT source, confidence, count(*) AS n FROM s GROUP BY source, confidence")
def g18(spark, sf):
    return relational.counts(specimens(spark, sf), "source", "confidence")


@query("g19_five_numbers", "SELECT l_returnflag, count(*) AS n, min(l_quantity) AS low, quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.5) AS median, quantile_cont(l_quantity, 0.75) AS q3, max(l_quantity) AS high FROM lineitem GROUP BY l_returnflag")
def g19(spark, sf):
    return relational.five_numbers(table(spark, sf, "lineitem"), "l_returnflag", "l_quantity")


@query("a17k_quantiles", "SELECT quantile_cont(l_extendedprice, 0.95) AS p95, quantile_cont(l_extendedprice, 0.99) AS p99, median(l_extendedprice) AS p50 FROM lineitem")
def a17k(spark, sf):
    found = relational.quantiles(table(spark, sf, "lineitem").select("l_extendedprice"), [], "l_extendedprice", {"p95": 0.95, "p99": 0.99, "p50": 0.5})
    return found.agg(*[F.max(c).alias(c) for c in ("p95", "p99", "p50")])  # one row, of nulls if there are no prices


STATUS, PRIORITY = ["F", "O", "P"], ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("r1_pivot", "SELECT o_orderpriority, " + ", ".join(f"count(*) FILTER (o_orderstatus = '{x}') AS \"{x}\"" for x in STATUS) + " FROM orders GROUP BY o_orderpriority")
def r1(spark, sf):
    return relational.pivot_counts(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", STATUS)


@query("r2_crosstab", "SELECT source, " + ", ".join(f"count(*) FILTER (lang = '{x}') AS {x}" for x in ("de", "en", "es", "fr")) + " FROM documents GROUP BY source")
def r2(spark, sf):
    return relational.crosstab(table(spark, sf, "documents"), "source", "lang")


@query("r3_split_explode", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def r3(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))


@query("r4_reindex", "SELECT n_name, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > 5000 GROUP BY n_name")
def r4(spark, sf):
    rich = table(spark, sf, "supplier").where("s_acctbal > 5000").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return relational.reindexed(relational.counts(rich, "n_name"), table(spark, sf, "nation"), "n_name", "n")


@query("r5_dense_days", "WITH d AS (SELECT datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS day, event_type FROM events), g AS (SELECT day, event_type FROM (SELECT unnest(range(min(day), max(day) + 1)) AS day FROM d), (SELECT DISTINCT event_type FROM d)) SELECT g.day, g.event_type, count(d.day) AS n FROM g LEFT JOIN d ON g.day = d.day AND g.event_type = d.event_type GROUP BY ALL")
def r5(spark, sf):
    rows = table(spark, sf, "events").select(F.unix_date(F.to_date("ts")).cast(BIG).alias("day"), "event_type")
    return relational.dense_counts(rows, "day", "event_type").select("day", "event_type", "n")


@query("r6_transpose", "SELECT o_orderstatus, " + ", ".join(f"count(*) FILTER (o_orderpriority = '{x}') AS \"{x}\"" for x in PRIORITY) + " FROM orders GROUP BY o_orderstatus")
def r6(spark, sf):
    return relational.pivot_counts(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority", PRIORITY)


@query("r8_rename_and_constant", "SELECT doc_id AS accession, lang AS subtype, 'curated' AS st_source FROM documents")
def r8(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("accession"), F.col("lang").alias("subtype"), F.lit("curated").alias("st_source"))


@query("w1_top_per_key", "SELECT l_orderkey, l_linenumber, r FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS r FROM lineitem) WHERE r <= 2")
def w1(spark, sf):
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber")
    return table(spark, sf, "lineitem").withColumn("r", F.row_number().over(w).cast(BIG)).where("r <= 2").select("l_orderkey", "l_linenumber", "r")


@query("w2_first_per_hash", "SELECT md5(text) AS h, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def w2(spark, sf):
    return relational.first_per_key(table(spark, sf, "documents").select("doc_id", F.md5("text").alias("h")), ["h"], ["doc_id"])


@query("c12_deduplicate", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY md5(upper(replace(text, 'ß', 'SS'))) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def c12(spark, sf):
    from seqlens.operators import curation

    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), "source", metadata.content_hash(F.col("text")).alias("md5"))
    return curation.deduplicated(rows).select(F.col("ord").alias("doc_id"), "source")


@query("c13_deduplicate_within", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source, replace(upper(replace(text, 'ß', 'SS')), '-', '') ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def c13(spark, sf):
    from seqlens.operators import curation

    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), F.col("source").alias("label"), F.col("text").alias("seq"))
    return curation.deduplicated_within(rows).select(F.col("ord").alias("doc_id"))


@query("w3_rank_by_size", "SELECT source, n, row_number() OVER (ORDER BY n DESC, source) AS place FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)")
def w3(spark, sf):
    return relational.ranked(relational.counts(table(spark, sf, "documents"), "source"), [F.desc("n"), F.asc("source")], "place")


@query("w4_runs", "WITH e AS (SELECT user_id, ts, event_id, event_type, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, run, event_type, count(*) AS n FROM (SELECT user_id, event_type, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS run FROM e) GROUP BY ALL")
def w4(spark, sf):
    return relational.runs(table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], "event_type")


@query("w5_group_size_on_rows", "SELECT doc_id, count(*) OVER (PARTITION BY source) AS n FROM documents")
def w5(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "source")
    return rows.join(relational.counts(rows, "source"), "source").select("doc_id", "n")  # counts first, so that a hot source is no window


@query("w6_stacked_base", "SELECT y, o_orderstatus, n, coalesce(sum(n) OVER (PARTITION BY y ORDER BY o_orderstatus ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM (SELECT year(o_orderdate)::INTEGER AS y, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL)")
def w6(spark, sf):
    own = relational.counts(table(spark, sf, "orders").select(F.year("o_orderdate").alias("y"), "o_orderstatus"), "y", "o_orderstatus")
    return relational.stacked(own, "y", "o_orderstatus", "n")


@query("w8_median_on_rows", "SELECT l_orderkey, l_linenumber, median(l_quantity) OVER (PARTITION BY l_orderkey) AS m FROM lineitem")
def w8(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return rows.join(rows.groupBy("l_orderkey").agg(F.percentile("l_quantity", 0.5).alias("m")), "l_orderkey").select("l_orderkey", "l_linenumber", "m")


@query("o5_top_n", "SELECT l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY l_partkey ORDER BY q DESC, l_partkey LIMIT 10")
def o5(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("q")).orderBy(F.desc("q"), "l_partkey").limit(10)


@query("o6_top_with_other", "WITH c AS (SELECT c_nationkey::VARCHAR AS k, count(*) AS n FROM customer GROUP BY 1), t AS (SELECT k FROM c ORDER BY n DESC, k LIMIT 15) SELECT CASE WHEN k IN (SELECT k FROM t) THEN k ELSE 'Other' END AS k, sum(n)::BIGINT AS n FROM c GROUP BY 1")
def o6(spark, sf):
    return relational.top_with_other(table(spark, sf, "customer").select(F.col("c_nationkey").cast("string").alias("k")), "k", 15)


@query("o9_least_label", S + "SELECT source, min(label) AS label FROM s GROUP BY source")
def o9(spark, sf):
    return specimens(spark, sf).groupBy("source").agg(F.array_min(F.collect_set("label")).alias("label"))


@query("o12_examples", "SELECT source, array_to_string(list(doc_id ORDER BY doc_id)[1:5], ',') AS examples FROM documents GROUP BY source")
def o12(spark, sf):
    w = Window.partitionBy("source").orderBy("doc_id")
    first = table(spark, sf, "documents").select("source", "doc_id", F.row_number().over(w).alias("r")).where("r <= 5")
    return first.groupBy("source").agg(F.array_join(F.sort_array(F.collect_list("doc_id")), ",").alias("examples"))


@query("o1_natural_top", S + "SELECT label, n FROM (SELECT label, count(*) AS n FROM s GROUP BY label) ORDER BY CASE WHEN starts_with(label, 'NMAST') THEN 1 WHEN starts_with(label, 'novel') THEN 2 WHEN label = 'ST_unassigned' THEN 8 WHEN starts_with(label, 'ST') THEN 0 ELSE 9 END, coalesce(TRY_CAST(nullif(regexp_extract(label, '\\d+'), '') AS BIGINT), 0), label LIMIT 5")
def o1(spark, sf):
    return relational.counts(specimens(spark, sf), "label").orderBy(*metadata.natural_order(F.col("label"))).limit(5)


@query("o2_sorted_places", "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_type, p_partkey) AS place FROM part")
def o2(spark, sf):
    w = Window.partitionBy("p_brand").orderBy("p_size", "p_type", "p_partkey")
    return table(spark, sf, "part").select("p_partkey", F.row_number().over(w).cast(BIG).alias("place"))


@query("o10_capped_scan", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100")
def o10(spark, sf):
    return table(spark, sf, "documents").select("doc_id").orderBy("doc_id").limit(100)


@query("o7_most_common", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 3")
def o7(spark, sf):
    return relational.top_keys(table(spark, sf, "events"), "event_type", 3)


@query("w7_share_of_total", "SELECT l_returnflag, count(*) AS n, 100.0::DOUBLE * count(*) / (SELECT count(*) FROM lineitem) AS pct FROM lineitem GROUP BY l_returnflag")
def w7(spark, sf):
    return relational.shares(table(spark, sf, "lineitem").select("l_returnflag"), "l_returnflag")


@query("u1_union_all", "SELECT doc_id AS id, 'd' AS kind FROM documents UNION ALL SELECT item_id, 'b' FROM benchmark")
def u1(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit("d").alias("kind")).unionByName(table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.lit("b").alias("kind")))


@query("u2_union_keep_first", "SELECT id, coalesce(a.kind, b.kind) AS kind FROM (SELECT doc_id AS id, 'document' AS kind FROM documents WHERE lang <> 'en') a FULL JOIN (SELECT doc_id AS id, 'label' AS kind FROM labels) b USING (id)")
def u2(spark, sf):
    first = table(spark, sf, "documents").where("lang <> 'en'").select(F.col("doc_id").alias("id"), F.lit("document").alias("kind"), F.lit(0).alias("p"))
    second = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.lit("label").alias("kind"), F.lit(1).alias("p"))
    return relational.first_per_key(first.unionByName(second), ["id"], ["p"]).drop("p")


@query("u3_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def u3(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti").distinct()


@query("u4_set_sizes", "SELECT a.c_nationkey AS k, len(list_intersect(a.s, b.s)) AS both, len(list_distinct(list_concat(a.s, b.s))) AS any FROM (SELECT c_nationkey, list(DISTINCT c_mktsegment) AS s FROM customer WHERE c_acctbal > 5000 GROUP BY 1) a JOIN (SELECT c_nationkey, list(DISTINCT c_mktsegment) AS s FROM customer WHERE c_acctbal <= 2000 GROUP BY 1) b USING (c_nationkey)")
def u4(spark, sf):
    c = table(spark, sf, "customer")
    a = c.where("c_acctbal > 5000").groupBy("c_nationkey").agg(F.collect_set("c_mktsegment").alias("a"))
    b = c.where("c_acctbal <= 2000").groupBy("c_nationkey").agg(F.collect_set("c_mktsegment").alias("b"))
    return a.join(b, "c_nationkey").select(F.col("c_nationkey").alias("k"), F.size(F.array_intersect("a", "b")).cast(BIG).alias("both"), F.size(F.array_union("a", "b")).cast(BIG).alias("any"))


@query("u5_ordered_distinct", "SELECT event_type, min(event_id) AS first FROM events GROUP BY event_type")
def u5(spark, sf):
    return relational.first_per_key(table(spark, sf, "events").select("event_type", F.col("event_id").alias("first")), ["event_type"], ["first"])


@query("u6_full_and_bare_ids", S + "SELECT accession AS id FROM s UNION SELECT split_part(accession, '.', 1) FROM s")
def u6(spark, sf):
    rows = specimens(spark, sf)
    return rows.select(F.col("accession").alias("id")).union(rows.select(metadata.bare_accession(F.col("accession")))).distinct()


@query("s3_broad_search", "SELECT doc_id FROM documents WHERE (contains(lower(text), 'ssu') OR contains(lower(text), 'the ') OR contains(lower(text), 'lyre')) AND NOT (contains(lower(source), 'src1') OR contains(lower(source), 'src3'))")
def s3(spark, sf):
    from seqlens.sources import readers

    keep = readers.matches_broad(F.col("text"), F.col("source"), ["SSU", "the ", "lyre"], ["src1", "src3"])
    return table(spark, sf, "documents").where(keep).select("doc_id")


@query("s2_point_lookup", "SELECT doc_id, lang FROM documents WHERE doc_id IN (3, 5, 8, 13, 21)")
def s2(spark, sf):
    from seqlens.sources import readers

    rows = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("accession"), F.col("doc_id").alias("ord"), "lang")
    return readers.by_accession(rows, ["3", "5", "3", "8", "13", "21"]).select(F.col("ord").alias("doc_id"), "lang")


@query("k2_fasta_text", "SELECT doc_id, concat('>', doc_id, chr(10), regexp_replace(regexp_replace(regexp_replace(text, '\\s', '', 'g'), '(.{60})', '\\1' || chr(10), 'g'), chr(10) || '$', '')) AS fasta FROM documents")
def k2(spark, sf):
    from seqlens.sources import sinks

    return table(spark, sf, "documents").select("doc_id", sinks.fasta_text(F.col("doc_id").cast("string"), F.regexp_replace("text", "\\s", "")).alias("fasta"))


@query("k6_run_config", "SELECT count(*) AS n_sequences, count(DISTINCT lang) AS n_subtypes FROM documents")
def k6(spark, sf):
    from seqlens.sources import sinks

    config = sinks.run_config(table(spark, sf, "documents"), "1", {"k": "8"}, "", "lang")
    return config.select(F.get_json_object("config", "$.n_sequences").cast(BIG).alias("n_sequences"), F.get_json_object("config", "$.n_subtypes").cast(BIG).alias("n_subtypes"))


REGISTRY = "(VALUES " + ", ".join("('{}', '{}', {}, '{}')".format(a, b, c == "yes", d.replace("'", "''")) for a, b, c, d in fixed.REGISTRY) + ") AS r(label, status, human, note)"


@query("s11_dimension_scan", f"SELECT label, status, human, note, n FROM {REGISTRY} JOIN (SELECT label, count(*) AS n FROM ({SPECIMENS}) GROUP BY label) USING (label)")
def s11(spark, sf):
    """The registry's rows of the labels that records have, with their number."""
    return curation.registry(spark).join(relational.counts(specimens(spark, sf), "label"), "label")
