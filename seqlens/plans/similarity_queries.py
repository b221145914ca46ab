"""Queries over k-mer sets, pair distances, placement, mapping and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqlens.functions import fixed, kmers
from seqlens.operators import clustering, curation, distance, ordination, relational, setjoin, similarity
from seqlens.operators.components import checkpointed
from seqlens.plans.bindings import FRAGMENT_LABELS, FRAGMENT_VALUES, SEQ, fragments, pick, references, table
from seqlens.plans.catalog import query

FRAGMENTS = f"f AS (SELECT item_id AS id, {SEQ} AS seq FROM benchmark), lab AS (SELECT id, {pick('id', FRAGMENT_LABELS)} AS label FROM f), meta AS (SELECT id, {FRAGMENT_VALUES} FROM f)"
REFS = f"r AS (SELECT doc_id AS id, {SEQ} AS seq, source AS label FROM documents)"
CLEAN = "replace(replace(upper(seq), '-', ''), 'N', '')"


def windows(x: str, k: int) -> str:
    return f"unnest(list_distinct([substr({x}, i, {k}) FOR i IN range(1, length({x}) - {k - 2})]))"


def rounded(x: str) -> str:
    return f"floor({x} * 1000000 + 0.5) / 1000000"


def six(c):
    return F.floor(c * 1000000 + 0.5) / 1000000


ALIGNED = f"""WITH {FRAGMENTS}, p AS (SELECT id, i, substr(seq, i, 1) AS c FROM (SELECT id, seq, unnest(range(1, length(seq) + 1)) AS i FROM f)),
x AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS comparable, count(*) FILTER (a.c <> b.c) AS differing FROM p a JOIN p b ON a.i = b.i AND a.id < b.id GROUP BY 1, 2),
e AS (SELECT id_a, id_b, differing / comparable AS p, -0.75 * ln(1 - 4.0::DOUBLE / 3.0::DOUBLE * least(greatest(differing / comparable, 0), 0.7499)) + 0.0 AS d FROM x),
y AS (SELECT e.*, la.label AS label_a, lb.label AS label_b FROM e JOIN lab la ON la.id = id_a JOIN lab lb ON lb.id = id_b)"""



def linkage(name: str, cut: float) -> str:
    """SQL (recursive): step by step the two clusters of the least average distance become one, up to a cut. dd has all pairs."""
    closest = f"SELECT x, y FROM (SELECT least(p.c, q.c) AS x, greatest(p.c, q.c) AS y, avg(dd.d) AS m FROM dd JOIN l_{name} p ON p.id = dd.a JOIN l_{name} q ON q.id = dd.b WHERE p.c <> q.c GROUP BY 1, 2) WHERE m <= {cut} ORDER BY m, x, y LIMIT 1"
    return f"l_{name} AS (SELECT 0 AS step, id, id AS c FROM f UNION ALL SELECT r.step + 1, r.id, CASE WHEN r.c = best.y THEN best.x ELSE r.c END FROM l_{name} r, ({closest}) best), {name} AS (SELECT id, arg_max(c, step) AS c FROM l_{name} GROUP BY id)"


def every_pair(pairs: str, far: float) -> str:
    return f"dd AS (SELECT a.id AS a, b.id AS b, coalesce(g.d, {far})::DOUBLE AS d FROM f a JOIN f b ON a.id < b.id LEFT JOIN {pairs} g ON g.id_a = a.id AND g.id_b = b.id)"


#: Groups of fragments by the Jaccard distance of their 3-mers.
GROUPS = f"""WITH RECURSIVE {FRAGMENTS}, k3 AS (SELECT id, {windows(CLEAN, 3)} AS kmer FROM f), kn AS (SELECT id, count(*) AS n FROM k3 GROUP BY id),
ks AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS s FROM k3 a JOIN k3 b ON a.kmer = b.kmer AND a.id < b.id GROUP BY 1, 2),
jd AS (SELECT id_a, id_b, 1.0::DOUBLE - s::DOUBLE / (x.n + y.n - s) AS d FROM ks JOIN kn x ON x.id = id_a JOIN kn y ON y.id = id_b),
{every_pair('jd', 1.0)}, {linkage('groups', 0.5)},
sized AS (SELECT c, count(*) AS size FROM groups GROUP BY c), ranked AS (SELECT c, row_number() OVER (ORDER BY size DESC, c) AS rank FROM sized WHERE size >= 2),
grouped AS (SELECT id, CASE WHEN rank IS NULL THEN 'ST_unassigned' ELSE concat('novel_', rank) END AS label, size FROM groups JOIN sized USING (c) LEFT JOIN ranked USING (c))"""
C6 = GROUPS + " SELECT id, label, size, CASE WHEN label LIKE 'novel%' THEN concat('clustered with ', size, ' other unplaced records at Jaccard d<0.2') ELSE 'no source ST tag, >max-placement-dist from all seeds, and no coherent novel cluster' END AS reason FROM grouped"
#: Clusters of fragments at three cuts of their corrected distances; who stands apart; what a report says of each label.
CUTS = {"cluster_top": 0.9, "cluster_subtype": 0.8, "cluster_variant": 0.7}
CLUSTERED = f"""{ALIGNED.replace('WITH', 'WITH RECURSIVE', 1)}, {every_pair('e', 10.0)}, {', '.join(linkage(n, c) for n, c in CUTS.items())},
clustered AS (SELECT id, t.c AS cluster_top, s.c AS cluster_subtype, v.c AS cluster_variant, label FROM cluster_top t JOIN cluster_subtype s USING (id) JOIN cluster_variant v USING (id) JOIN lab USING (id))"""
APART = CLUSTERED + f""", own AS (SELECT id, label, cluster_subtype AS k FROM clustered WHERE label <> 'Unknown' AND label IN (SELECT label FROM clustered GROUP BY label HAVING count(*) >= 3)),
inn AS (SELECT id_a, id_b, d, label_a AS label FROM y WHERE label_a = label_b AND label_a IN (SELECT label FROM own)),
two AS (SELECT id_a AS id, id_b AS other, d, label FROM inn UNION ALL SELECT id_b, id_a, d, label FROM inn),
med AS (SELECT label, id AS medoid FROM (SELECT label, id, row_number() OVER (PARTITION BY label ORDER BY floor(sum(d) * 1000000000 + 0.5), id) AS o FROM two GROUP BY label, id) WHERE o = 1),
mid AS (SELECT label, quantile_cont(d, 0.5) AS median FROM inn GROUP BY label), sizes AS (SELECT label, k, count(*) AS m FROM own GROUP BY label, k),
dom AS (SELECT label, arg_min(k, (-m, k)) AS dominant, max(m) / sum(m) AS share FROM sizes GROUP BY label),
facts AS (SELECT own.*, dominant, share, CASE WHEN own.id = medoid THEN 0.0::DOUBLE ELSE two.d END AS dm, greatest({fixed.OUTLIER_MULTIPLIER} * greatest(median, {fixed.OUTLIER_FLOOR}), {2 * fixed.CLUSTER_CUTS['cluster_variant']})::DOUBLE AS cutoff FROM own JOIN med USING (label) JOIN mid USING (label) JOIN dom USING (label) LEFT JOIN two ON two.id = own.id AND two.other = medoid),
apart AS (SELECT id, dm, concat_ws('; ', CASE WHEN dm > cutoff THEN concat('d_medoid=', printf('%.4f', dm), ' > ', printf('%.4f', cutoff)) END, CASE WHEN k <> dominant AND share > {fixed.DOMINANT_SHARE} THEN concat('minority cluster (', k, ')') END) AS reason FROM facts)"""


@query("a1k_kmer_sets", f"WITH {FRAGMENTS} SELECT id, kmer FROM (SELECT id, {windows(CLEAN, 8)} AS kmer FROM f)")
def a1k(spark, sf):
    return fragments(spark, sf).select("id", F.explode(kmers.kmer_set(F.col("seq"))).alias("kmer"))


@query("a2k_strict_kmers", f"WITH f AS (SELECT item_id AS id, upper(translate(lower(text), 'bdefhijklmnopqrsuvwxyz', 'ACGTACGTACGTACGTACGTAC')) AS seq FROM benchmark) SELECT id, count(*) AS n FROM (SELECT id, {windows('seq', 3)} AS kmer FROM f) WHERE regexp_full_match(kmer, '[ACGT]+') GROUP BY id")
def a2k(spark, sf):
    rows = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.translate(F.lower("text"), "bdefhijklmnopqrsuvwxyz", "ACGTACGTACGTACGTACGTAC").alias("seq"))
    return rows.select("id", F.size(kmers.strict_kmer_set(F.col("seq"), 3)).cast("bigint").alias("n")).where("n > 0")


@query("a3k_kmer6_sizes", f"WITH {FRAGMENTS} SELECT id, count(*) AS n FROM (SELECT id, {windows(CLEAN, 6)} AS kmer FROM f) GROUP BY id")
def a3k(spark, sf):
    return fragments(spark, sf).select("id", F.size(kmers.kmer_set(F.col("seq"), 6)).cast("bigint").alias("n"))


@query("x19_reverse_complement", f"WITH {FRAGMENTS} SELECT id, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM f")
def x19(spark, sf):
    return fragments(spark, sf).select("id", kmers.reverse_complement(F.col("seq")).alias("rc"))


@query("f15_empty_kmer_sets", "SELECT doc_id AS id FROM documents WHERE length(regexp_replace(lower(text), '[^a-z]', '', 'g')) < 8")
def f15(spark, sf):
    refs = references(spark, sf)
    return refs.where(F.size(kmers.kmer_set(F.col("seq"))) == 0).select("id")


@query("k4_distance_export", ALIGNED + " SELECT id_a, id_b, floor(p * 100000 + 0.5) / 100000 AS d FROM e")
def k4(spark, sf):
    table_ = distance.distance_table(fragments(spark, sf), aligned=True)
    return table_.select("id_a", "id_b", (F.floor(F.col("d") * 100000 + 0.5) / 100000).alias("d"))


@query("c6_unplaced_rows", C6)
def c6(spark, sf):
    groups = clustering.novel_groups(fragments(spark, sf), 3, cutoff=0.5)
    return groups.withColumn("reason", clustering.novel_reason("label", "size"))


@query("a6k_packed_kmers", f"WITH {FRAGMENTS} SELECT id, kmer, list_sum([(strpos('ACGT', substr(kmer, j, 1)) - 1) * CAST(pow(4, 8 - j) AS BIGINT) FOR j IN range(1, 9)])::BIGINT AS code FROM (SELECT id, {windows('seq', 8)} AS kmer FROM f)")
def a6k(spark, sf):
    return fragments(spark, sf).select("id", F.explode(kmers.strict_kmer_set(F.col("seq"))).alias("kmer")).withColumn("code", kmers.packed(F.col("kmer")))


PAIR6 = f"""WITH {FRAGMENTS}, k AS (SELECT id, {windows(CLEAN, 6)} AS kmer FROM f), n AS (SELECT id, count(*) AS n FROM k GROUP BY id),
c AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS shared FROM k a JOIN k b ON a.kmer = b.kmer AND a.id < b.id GROUP BY 1, 2)"""


@query("a10k_kmer_pairs", PAIR6 + f" SELECT id_a, id_b, shared, {rounded('(1 - shared / (x.n + y.n - shared))')} AS d FROM c JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b")
def a10k(spark, sf):
    return distance.kmer_pairs(fragments(spark, sf)).withColumn("d", six(F.col("d")))


#: Documents whose 12-mers are near enough: copies are one class, told by its least id. (There are 65,536 8-mers of four letters, of which long documents share many by chance.)
NEAR = f"""WITH {REFS}, k AS (SELECT id, {windows(CLEAN, 12)} AS kmer FROM r), s AS MATERIALIZED (SELECT id, count(*) AS n, md5(string_agg(kmer, ' ' ORDER BY kmer)) AS mark FROM k GROUP BY id),
m AS (SELECT id, n, min(id) OVER (PARTITION BY mark) AS rep FROM s), c AS MATERIALIZED (SELECT id, n FROM m WHERE id = rep), t AS MATERIALIZED (SELECT k.id, kmer FROM k JOIN c USING (id)),
p AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS shared FROM t a JOIN t b ON a.kmer = b.kmer AND a.id < b.id GROUP BY 1, 2),
d AS (SELECT id_a, id_b, 1.0::DOUBLE - shared::DOUBLE / (x.n + y.n - shared) AS d FROM p JOIN c x ON x.id = id_a JOIN c y ON y.id = id_b),
e AS (SELECT id_a AS id, d FROM d WHERE d <= 0.2 UNION ALL SELECT id_b, d FROM d WHERE d <= 0.2), f AS (SELECT id, count(*) AS links, min(d) AS nearest FROM e GROUP BY id)"""


@query("a10k_near_sets", NEAR + f" SELECT r.id, rep, coalesce(links, 0) AS links, {rounded('nearest')} AS nearest FROM r LEFT JOIN m USING (id) LEFT JOIN f ON f.id = rep")
def a10k_near(spark, sf):
    """Each document with its class of equal 12-mer sets, how many other classes are within the cutoff, and how far the nearest of these is."""
    near, members = setjoin.near_kmer_sets(references(spark, sf), 12)
    links = distance.both_ways(near).groupBy(F.col("id").alias("rep")).agg(F.count(F.lit(1)).alias("links"), six(F.min("d")).alias("nearest"))
    return members.join(links, "rep", "left").select("id", "rep", F.coalesce("links", F.lit(0)).alias("links"), "nearest")


@query("j13_pairs_of_segments", "SELECT a.c_mktsegment AS a, b.c_mktsegment AS b FROM (SELECT DISTINCT c_mktsegment FROM customer) a JOIN (SELECT DISTINCT c_mktsegment FROM customer) b ON a.c_mktsegment < b.c_mktsegment")
def j13(spark, sf):
    own = table(spark, sf, "customer").agg(F.array_sort(F.collect_set("c_mktsegment")).alias("s"))  # the few segments
    return own.select(F.explode(F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p")).select("p.a", "p.b")


MAPPED = f"""WITH {FRAGMENTS}, {REFS},
q AS (SELECT id, 0 AS strand, {windows('seq', 8)} AS kmer FROM f UNION ALL SELECT id, 1, {windows('rc', 8)} FROM (SELECT id, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM f)),
nq AS (SELECT id, count(*) AS n FROM q WHERE strand = 0 GROUP BY id),
rk AS (SELECT id, {windows('seq', 8)} AS kmer FROM r),
c AS (SELECT q.id AS qid, rk.id AS rid, count(*) FILTER (strand = 0) AS a, count(*) FILTER (strand = 1) AS b FROM q JOIN rk USING (kmer) GROUP BY 1, 2),
d AS (SELECT qid, rid, 1 - greatest(a, b) / n AS d FROM c JOIN nq ON nq.id = qid),
t AS (SELECT qid, d, rank, label FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, rid) AS rank FROM d) JOIN r ON r.id = rid WHERE rank <= 5),
v AS (SELECT qid, label, row_number() OVER (PARTITION BY qid ORDER BY count(*) DESC, min(rank)) AS o FROM t GROUP BY qid, label),
g AS (SELECT t.qid AS id, t.label AS best, t.d, CASE WHEN d <= 0.05 THEN 'high' WHEN d <= 0.15 THEN 'medium' WHEN d <= 0.30 AND v.label = t.label THEN 'low' WHEN d <= 0.30 THEN 'ambiguous' ELSE 'unmapped' END AS confidence
 FROM t JOIN v ON t.qid = v.qid AND rank = 1 AND o = 1),
m AS (SELECT id, CASE WHEN confidence = 'unmapped' THEN 'unmapped' ELSE best END AS assigned, d, confidence FROM g)"""


def mapped(spark, sf):
    return similarity.map_fragments(fragments(spark, sf), references(spark, sf))


#: The five nearest in order; three places, rounded half up.
TOP5 = ", five AS (SELECT qid, string_agg(concat(label, ':', printf('%.3f', floor(d * 1000 + 0.5) / 1000)), '; ' ORDER BY rank) AS top5 FROM t GROUP BY qid)"


@query("c9_map_fragments", MAPPED + TOP5 + f" SELECT id, assigned, {rounded('d')} AS d, confidence, top5 FROM m JOIN five ON id = qid")
def c9(spark, sf):
    return mapped(spark, sf).select("id", "assigned", six(F.col("containment_dist")).alias("d"), "confidence", "top5")


@query("a5k_containment", MAPPED + " SELECT qid AS id, rid AS ref_id, greatest(a, b) AS shared, n AS nq FROM c JOIN nq ON nq.id = qid WHERE greatest(a, b) >= 0.5 * n")
def a5k(spark, sf):
    pairs = similarity.contained(fragments(spark, sf), references(spark, sf), 0.5)
    return pairs.select(F.col("query_id").alias("id"), "ref_id", "shared", F.col("nq").cast("bigint").alias("nq"))


def summary(rows, facts):
    """assigned, n, median_dist, high, top_hosts, top_countries of what was mapped. facts: id, host, country."""
    kept = rows.where(~F.col("confidence").isin("unmapped", "ambiguous")).join(facts, "id")
    out = kept.groupBy("assigned").agg(F.count(F.lit(1)).alias("n"), six(F.percentile("containment_dist", 0.5)).alias("median_dist"), F.count_if(F.col("confidence") == "high").alias("high"))
    for column, name in (("host", "top_hosts"), ("country", "top_countries")):
        out = out.join(relational.top_values(kept, "assigned", column, 3, name), "assigned")
    return out


def most(column: str, key: str, rows: str, n: int) -> str:
    """SQL: key and the n most frequent values of a column with their counts."""
    return f"(SELECT {key}, string_agg(concat({column}, ':', n), '; ' ORDER BY n DESC, {column} NULLS FIRST) AS v FROM (SELECT {key}, {column}, count(*) AS n, row_number() OVER (PARTITION BY {key} ORDER BY count(*) DESC, {column} NULLS FIRST) AS o FROM {rows} GROUP BY {key}, {column}) WHERE o <= {n} GROUP BY {key})"


@query("q23_mapping_summary", MAPPED + f", own AS (SELECT m.*, meta.host, meta.country FROM m JOIN meta USING (id) WHERE m.confidence NOT IN ('unmapped', 'ambiguous')) SELECT assigned, count(*) AS n, {rounded('median(d)')} AS median_dist, count(*) FILTER (confidence = 'high') AS high, first(h.v) AS top_hosts, first(c.v) AS top_countries FROM own JOIN {most('host', 'assigned', 'own', 3)} h USING (assigned) JOIN {most('country', 'assigned', 'own', 3)} c USING (assigned) GROUP BY assigned")
def q23(spark, sf):
    return summary(mapped(spark, sf), fragments(spark, sf).select("id", "host", "country"))


@query("q24_hits_of_prefix", MAPPED + TOP5 + f" SELECT id, assigned, {rounded('d')} AS d, m.confidence, top5, host, country, technology FROM m JOIN five ON id = qid JOIN meta USING (id) WHERE starts_with(assigned, 'src1') AND m.confidence NOT IN ('unmapped', 'ambiguous')")
def q24(spark, sf):
    hits = mapped(spark, sf).where(F.col("assigned").startswith("src1") & ~F.col("confidence").isin("unmapped", "ambiguous"))
    return hits.join(fragments(spark, sf).select("id", "host", "country", "technology"), "id").select("id", "assigned", six(F.col("containment_dist")).alias("d"), "confidence", "top5", "host", "country", "technology")


@query("q25_mapping_confidence", MAPPED + " SELECT confidence, count(*) AS n, 100.0::DOUBLE * count(*) / (SELECT count(*) FROM m) AS pct FROM m GROUP BY confidence")
def q25(spark, sf):
    return relational.shares(mapped(spark, sf).select("id", "confidence"), "confidence")


@query("q26_share_comparison", MAPPED + """, s AS (SELECT assigned AS label, count(*) AS n FROM m WHERE confidence NOT IN ('unmapped', 'ambiguous') GROUP BY 1), l AS (SELECT label, count(*) AS n FROM r GROUP BY 1)
SELECT s.label, 100.0::DOUBLE * s.n / (SELECT sum(n)::DOUBLE FROM s) AS short_pct, 100.0::DOUBLE * coalesce(l.n, 0) / (SELECT sum(n)::DOUBLE FROM l) AS full_pct FROM s LEFT JOIN l USING (label) ORDER BY s.n DESC, s.label LIMIT 15""")
def q26(spark, sf):
    kept = mapped(spark, sf).where(~F.col("confidence").isin("unmapped", "ambiguous")).select(F.col("assigned").alias("label"))
    short, full = relational.shares(kept, "label", share="short_pct"), relational.shares(references(spark, sf).select("label"), "label", name="m", share="full_pct")
    return short.join(full, "label", "left").orderBy(F.desc("n"), "label").limit(15).select("label", "short_pct", F.coalesce("full_pct", F.lit(0.0)).alias("full_pct"))


PLACED = f"""WITH {FRAGMENTS}, r AS (SELECT doc_id AS id, {SEQ} AS seq, lang AS label FROM documents),
q AS (SELECT id, {windows(CLEAN, 8)} AS kmer FROM f), nq AS (SELECT id, count(*) AS n FROM q GROUP BY id),
rk AS (SELECT id, {windows(CLEAN, 8)} AS kmer FROM r), nr AS (SELECT id, count(*) AS n FROM rk GROUP BY id),
c AS (SELECT q.id AS qid, rk.id AS rid, count(*) AS s FROM q JOIN rk USING (kmer) GROUP BY 1, 2),
d AS (SELECT qid, rid, 1 - s / (nq.n + nr.n - s) AS d FROM c JOIN nq ON nq.id = qid JOIN nr ON nr.id = rid),
t AS (SELECT qid, d, rank, label FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, rid) AS rank FROM d) JOIN r ON r.id = rid WHERE rank <= 5),
v AS (SELECT qid, label, row_number() OVER (PARTITION BY qid ORDER BY count(*) DESC, min(rank)) AS o FROM t GROUP BY qid, label)"""


@query("c3_place_by_neighbours", PLACED + f""" SELECT t.qid AS id, CASE WHEN v.label = t.label AND d > 0.3 THEN 'Unplaced' ELSE t.label END AS assigned, {rounded('d')} AS d,
CASE WHEN v.label <> t.label THEN 'low' WHEN d > 0.3 THEN 'rejected' WHEN d > 0.15 THEN 'low' WHEN d > 0.08 THEN 'medium' ELSE 'high' END AS confidence FROM t JOIN v ON t.qid = v.qid AND rank = 1 AND o = 1""")
def c3(spark, sf):
    refs = references(spark, sf).select("id", "seq", F.col("lang").alias("label"))
    return similarity.place(fragments(spark, sf), refs).withColumn("d", six(F.col("d")))


@query("c4_placed_or_not", PLACED + " SELECT CASE WHEN v.label = t.label AND d > 0.3 THEN 'unassigned' ELSE 'placed' END AS state, count(*) AS n FROM t JOIN v ON t.qid = v.qid AND rank = 1 AND o = 1 GROUP BY 1")
def c4(spark, sf):
    refs = references(spark, sf).select("id", "seq", F.col("lang").alias("label"))
    return relational.counts(similarity.place(fragments(spark, sf), refs).select(F.when(F.col("confidence") == "rejected", "unassigned").otherwise("placed").alias("state")), "state")


@query("a4k_jaccard_of_sets", "SELECT a.c_nationkey AS a, b.s_nationkey AS b, floor((1 - len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s)))) * 1000000 + 0.5) / 1000000 AS d FROM (SELECT c_nationkey, list(DISTINCT c_custkey % 50) AS s FROM customer GROUP BY 1) a JOIN (SELECT s_nationkey, list(DISTINCT s_suppkey % 50) AS s FROM supplier GROUP BY 1) b ON a.c_nationkey = b.s_nationkey")
def a4k(spark, sf):
    a = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("a")).agg(F.collect_set((F.col("c_custkey") % 50).cast("string")).alias("sa"))
    b = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("b")).agg(F.collect_set((F.col("s_suppkey") % 50).cast("string")).alias("sb"))
    return a.join(b, F.col("a") == F.col("b")).select("a", "b", six(kmers.jaccard_distance(F.col("sa"), F.col("sb"))).alias("d"))


def pairs(spark, sf):
    return distance.corrected(distance.aligned_pairs(fragments(spark, sf)))


def labels_of(spark, sf):
    return fragments(spark, sf).select("id", "label")


def classes(rows):
    """Pairs of rows by labels and distance, n of each: label_a, label_b, same, p, d, n."""
    return distance.corrected(distance.pair_classes(rows)).withColumn("same", F.col("label_a") == F.col("label_b"))


def known_classes(spark, sf):
    return classes(fragments(spark, sf).where(F.col("label").startswith("ST") & (F.col("label") != "ST_unassigned")))


@query("a8k_p_distance", ALIGNED + " SELECT * FROM x")
def a8k(spark, sf):
    return pairs(spark, sf).select("id_a", "id_b", "comparable", "differing")


@query("a7k_codes", f"WITH {FRAGMENTS} SELECT id, translate(seq, 'ACGT', '1234') AS codes FROM f")
def a7k(spark, sf):
    return fragments(spark, sf).select("id", kmers.codes(F.col("seq")).alias("codes"))


@query("a9k_corrected", ALIGNED + f" SELECT id_a, id_b, {rounded('d')} AS d FROM e")
def a9k(spark, sf):
    return pairs(spark, sf).select("id_a", "id_b", six(F.col("d")).alias("d"))


@query("a11k_distance_matrix", ALIGNED + f" SELECT id_a, id_b, {rounded('p')} AS p FROM e")
def a11k(spark, sf):
    return pairs(spark, sf).select("id_a", "id_b", six(F.col("p")).alias("p"))


KNOWN = "label_a LIKE 'ST%' AND label_b LIKE 'ST%' AND label_a <> 'ST_unassigned' AND label_b <> 'ST_unassigned'"


@query("j15_same_or_different", ALIGNED + f" SELECT label_a = label_b AS same, count(*) AS n FROM y WHERE {KNOWN} GROUP BY 1")
def j15(spark, sf):
    return known_classes(spark, sf).groupBy("same").agg(F.sum("n").alias("n"))


@query("g4_within_label", ALIGNED + f" SELECT label_a AS label, count(*) AS n, {rounded('avg(d)')} AS mean, {rounded('median(d)')} AS median, {rounded('max(d)')} AS most FROM y WHERE label_a = label_b GROUP BY 1")
def g4(spark, sf):
    own = classes(fragments(spark, sf)).where("same").select(F.col("label_a").alias("label"), "d", "n")
    return within(checkpointed(own), "mean", "median", "most")


def within(rows, mean: str, median: str, most: str):
    """label, n, and the mean, median and greatest d of each label. rows: label, d, n (pairs)."""
    middle = relational.quantiles(rows, ["label"], "d", {median: 0.5, most: 1.0}, "n").select("label", "n", six(F.col(median)).alias(median), six(F.col(most)).alias(most))
    return middle.join(rows.groupBy("label").agg(six(F.sum(F.col("d") * F.col("n")) / F.sum("n")).alias(mean)), "label").select("label", "n", mean, median, most)


@query("g5_novel_medians", ALIGNED + f" SELECT label_a AS label, count(*) AS n, {rounded('median(p)')} AS median FROM y WHERE label_a = label_b AND label_a LIKE 'novel%' GROUP BY 1")
def g5(spark, sf):
    own = classes(fragments(spark, sf).where("label LIKE 'novel%'")).where("same").select(F.col("label_a").alias("label"), "p", "n")
    return relational.quantiles(own, ["label"], "p", {"median": 0.5}, "n").withColumn("median", six(F.col("median")))


@query("g13_neighbour_vote", MAPPED + " SELECT t.qid AS id, t.label AS best, v.label AS vote FROM t JOIN v ON t.qid = v.qid AND rank = 1 AND o = 1")
def g13(spark, sf):
    near = similarity.neighbours(fragments(spark, sf), references(spark, sf), 8, contained=True)
    return similarity.vote(near).select(F.col("query_id").alias("id"), "best", "vote")


@query("q3_intra_inter", ALIGNED + f" SELECT same, count(*) AS n, {rounded('median(d)')} AS median FROM (SELECT label_a = label_b AS same, d FROM y WHERE {KNOWN}) GROUP BY same")
def q3(spark, sf):
    return relational.quantiles(known_classes(spark, sf), ["same"], "d", {"median": 0.5}, "n").withColumn("median", six(F.col("median")))


@query("a14k_cliffs_delta", ALIGNED + f", z AS (SELECT label_a = label_b AS same, d FROM y WHERE {KNOWN}) SELECT {rounded('sum(CASE WHEN a.d > b.d THEN 1 WHEN a.d < b.d THEN -1 ELSE 0 END)::DOUBLE / count(*)')} AS delta FROM z a JOIN z b ON a.same AND NOT b.same")
def a14k(spark, sf):
    rows = known_classes(spark, sf).select(F.when(F.col("same"), "intra").otherwise("inter").alias("g"), "d", "n")
    return relational.cliffs_delta(rows, "g", "intra", "inter", "d", "n").select(six(F.col("delta")).alias("delta"))


def numbers(x: str) -> str:
    return ", ".join(f"{rounded(e)} AS {n}" for n, e in (("low", f"min({x})"), ("q1", f"quantile_cont({x}, 0.25)"), ("median", f"quantile_cont({x}, 0.5)"), ("q3", f"quantile_cont({x}, 0.75)"), ("high", f"max({x})")))


def boxes(rows):
    five = relational.five_numbers(rows, "label", "d", "n")
    return five.select("label", "n", *[six(F.col(c)).alias(c) for c in ("low", "q1", "median", "q3", "high")])


@query("q4_known_boxes", ALIGNED + f" SELECT label_a AS label, count(*) AS n, {numbers('d')} FROM y WHERE label_a = label_b AND {KNOWN} GROUP BY 1")
def q4(spark, sf):
    return boxes(known_classes(spark, sf).where("same").select(F.col("label_a").alias("label"), "d", "n"))


@query("q5_novel_boxes", ALIGNED + f" SELECT label_a AS label, count(*) AS n, {numbers('d')} FROM y WHERE label_a = label_b AND (label_a LIKE 'novel%' OR label_a = 'ST_unassigned') GROUP BY 1")
def q5(spark, sf):
    own = classes(fragments(spark, sf).where("label LIKE 'novel%' OR label = 'ST_unassigned'")).where("same")
    return boxes(own.select(F.col("label_a").alias("label"), "d", "n"))


@query("a16k_medoids", ALIGNED + ", w AS (SELECT id_a AS id, label_a AS label, p FROM y WHERE label_a = label_b UNION ALL SELECT id_b, label_b, p FROM y WHERE label_a = label_b), t AS (SELECT id, label, floor(sum(p) * 1000000000 + 0.5) AS s FROM w GROUP BY ALL) SELECT label, id AS medoid FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s, id) AS o FROM t) WHERE o = 1")
def a16k(spark, sf):
    return distance.medoids_of(fragments(spark, sf)).select("label", "medoid")


@query("q2_heatmap_pyramid", ALIGNED + f""", o AS (SELECT id, row_number() OVER (ORDER BY label, id) AS place FROM lab), c AS (SELECT least(a.place, b.place) - 1 AS i, greatest(a.place, b.place) - 1 AS j, p FROM e JOIN o a ON a.id = id_a JOIN o b ON b.id = id_b)
SELECT level::INTEGER AS level, i // pow(2, level)::BIGINT + 1 AS i, j // pow(2, level)::BIGINT + 1 AS j, count(*) AS n, {rounded('avg(p)')} AS mean, {rounded('max(p)')} AS most FROM c, range(4) t(level) GROUP BY ALL""")
def q2_pyramid(spark, sf):
    """The heat map at four resolutions."""
    axis = relational.ranked(labels_of(spark, sf), [F.col("label"), F.col("id")], "place")
    cells = distance.permuted(pairs(spark, sf).select("id_a", "id_b", F.col("p").alias("d")), axis)
    return distance.pyramid(cells, 4).withColumns({"mean": six(F.col("mean")), "most": six(F.col("most"))})


@query("r11_permuted_matrix", ALIGNED + ", o AS (SELECT id, row_number() OVER (ORDER BY label, id) AS place FROM lab) SELECT least(a.place, b.place) AS i, greatest(a.place, b.place) AS j, floor(p * 1000000 + 0.5) / 1000000 AS d FROM e JOIN o a ON a.id = id_a JOIN o b ON b.id = id_b")
def r11(spark, sf):
    axis = relational.ranked(labels_of(spark, sf), [F.col("label"), F.col("id")], "place")
    return distance.permuted(pairs(spark, sf).select("id_a", "id_b", six(F.col("p")).alias("d")), axis)


@query("q2_heatmap_blocks", f"WITH {FRAGMENTS}, n AS (SELECT label, count(*) AS n FROM lab GROUP BY label), b AS (SELECT label, n, coalesce(sum(n) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM n) SELECT label, first, first + n AS last, (2 * first + n) // 2 AS tick FROM b")
def q2(spark, sf):
    return relational.blocks(relational.counts(labels_of(spark, sf), "label"), "label", [F.col("label")])


@query("q2_heatmap_cap", ALIGNED + f" SELECT {rounded('quantile_cont(d, 0.95)')} AS cap FROM e")
def q2_cap(spark, sf):
    """Where the scale of the heat map ends."""
    return relational.quantiles(classes(fragments(spark, sf)), [], "d", {"cap": 0.95}, "n").select(six(F.col("cap")).alias("cap"))


@query("q4_axis", ALIGNED + f", ax AS (SELECT quantile_cont(d, 0.99) AS p FROM y WHERE label_a = label_b AND {KNOWN}) SELECT {rounded("p")} AS p99, CASE WHEN p < 0.2 THEN -0.005::DOUBLE END AS low, CASE WHEN p < 0.2 THEN {rounded('greatest(0.15, 1.5 * p)')} END AS high FROM ax")
def q4_axis(spark, sf):
    """The axis of the boxes: cut where the 99th percentile is small, else left to the values."""
    p = F.col("p")
    own = relational.quantiles(known_classes(spark, sf).where("same"), [], "d", {"p": 0.99}, "n")
    return own.select(six(p).alias("p99"), F.when(p < 0.2, F.lit(-0.005)).alias("low"), F.when(p < 0.2, six(F.greatest(F.lit(0.15), 1.5 * p))).alias("high"))


@query("c5_novel_groups", GROUPS + " SELECT id, label, size FROM grouped")
def c5(spark, sf):
    return clustering.novel_groups(fragments(spark, sf), 3, cutoff=0.5)


def clustered(spark, sf):
    """All pair distances, and the clusters at three cuts with the labels, both written once."""
    own = checkpointed(pairs(spark, sf).select("id_a", "id_b", "d"))
    made = clustering.clusters(fragments(spark, sf), own, CUTS, far=10.0)
    return own, checkpointed(made.join(labels_of(spark, sf), "id"))


@query("c7_clusters", CLUSTERED + " SELECT * FROM clustered")
def c7(spark, sf):
    return clustered(spark, sf)[1]


def apart(own, made):
    return clustering.outliers(made.select("id", "label", F.col("cluster_subtype").alias("cluster")), own)


@query("c8_outliers", APART + f" SELECT id, {rounded('dm')} AS dist_from_medoid, coalesce(reason, '') <> '' AS potential_novel_variant, coalesce(reason, '') AS novel_variant_reason FROM clustered LEFT JOIN apart USING (id)")
def c8(spark, sf):
    return apart(*clustered(spark, sf)).withColumn("dist_from_medoid", six(F.col("dist_from_medoid")))


REGISTRY = "(VALUES " + ", ".join("('{}', '{}', {}, '{}')".format(a, b, c == "yes", d.replace("'", "''")) for a, b, c, d in fixed.REGISTRY) + ") AS r(label, status, human, note)"
FACTS = "(SELECT clustered.*, host, technology, confidence FROM clustered JOIN meta USING (id) WHERE label <> 'Unknown')"


@query("q21_label_summary", APART + f""", w AS {FACTS}, n AS (SELECT label, count(*) AS n_sequences, count(DISTINCT cluster_variant) AS n_variant_clusters, count(*) FILTER (coalesce(reason, '') <> '') AS n_novel_candidates FROM w LEFT JOIN apart USING (id) GROUP BY label HAVING count(*) > 1),
i AS (SELECT label_a AS label, {rounded('avg(d)')} AS mean_intra, {rounded('median(d)')} AS median_intra, {rounded('max(d)')} AS max_intra FROM y WHERE label_a = label_b GROUP BY 1)
SELECT n.*, coalesce(r.status, 'unknown') AS status, coalesce(r.human, false) AS reported_in_humans, coalesce(r.note, '') AS registry_note, mean_intra, median_intra, max_intra, a.v AS confidence_breakdown, b.v AS top_hosts, c.v AS sequencing_technologies
FROM n JOIN i USING (label) LEFT JOIN {REGISTRY} USING (label) JOIN {most('confidence', 'label', 'w', 1000)} a USING (label) JOIN {most('host', 'label', 'w', 3)} b USING (label) JOIN {most('technology', 'label', 'w', 1000)} c USING (label)""")
def q21(spark, sf):
    """A report's table of labels with two rows or more."""
    own, made = clustered(spark, sf)
    rows = made.where("label <> 'Unknown'").join(fragments(spark, sf).drop("label", "seq", "country"), "id").join(apart(own, made).select("id", "potential_novel_variant"), "id")
    rows = checkpointed(rows)
    out = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n_sequences"), F.countDistinct("cluster_variant").alias("n_variant_clusters"), F.count_if("potential_novel_variant").alias("n_novel_candidates")).where("n_sequences > 1")
    inner = checkpointed(distance.labelled(own, labels_of(spark, sf)).where("same").select(F.col("label_a").alias("label"), "d", F.lit(1).alias("n")))
    out = out.join(within(inner, "mean_intra", "median_intra", "max_intra").drop("n"), "label")
    reg = curation.registry(spark).select("label", "status", F.col("human").alias("reported_in_humans"), F.col("note").alias("registry_note"))
    out = out.join(F.broadcast(reg), "label", "left").withColumns({"status": F.coalesce("status", F.lit("unknown")), "reported_in_humans": F.coalesce("reported_in_humans", F.lit(False)), "registry_note": F.coalesce("registry_note", F.lit(""))})  # 52 rows
    for column, n, name in (("confidence", 1000, "confidence_breakdown"), ("host", 3, "top_hosts"), ("technology", 1000, "sequencing_technologies")):
        out = out.join(relational.top_values(rows, "label", column, n, name), "label")
    return out


#: The double-centred matrix of all pairs.
GOWER = f"""{ALIGNED.replace('WITH', 'WITH RECURSIVE', 1)}, fu AS MATERIALIZED (SELECT id_a AS i, id_b AS j, d * d AS q FROM e UNION ALL SELECT id_b, id_a, d * d FROM e UNION ALL SELECT id, id, 0 FROM f),
rm AS (SELECT i, avg(q) AS m FROM fu GROUP BY i), b0 AS MATERIALIZED (SELECT fu.i, fu.j, -0.5 * (q - x.m - y.m + (SELECT avg(q) FROM fu)) AS b FROM fu JOIN rm x ON x.i = fu.i JOIN rm y ON y.i = fu.j)"""


def leading(n: int) -> str:
    """SQL: the axis of the greatest eigenvalue of b{n}, from squares of squares of it, as a{n} (i, u, k), and b{n + 1}, b{n} without it."""
    return f"""p{n} AS (SELECT 0 AS t, i, j, b AS v FROM b{n} UNION ALL SELECT t, i, j, v / max(abs(v)) OVER () FROM (SELECT x.t + 1 AS t, x.i, y.j, sum(x.v * y.v) AS v FROM p{n} x JOIN p{n} y ON x.j = y.i WHERE x.t < 14 GROUP BY ALL)),
w{n} AS MATERIALIZED (SELECT i, j, v FROM p{n} WHERE t = 14), c{n} AS (SELECT i, v / sqrt(sum(v * v) OVER ()) AS u FROM w{n} WHERE j = (SELECT arg_max(i, v) FROM w{n} WHERE i = j)),
k{n} AS (SELECT sum(x.u * b * y.u) AS k FROM b{n} JOIN c{n} x ON x.i = b{n}.i JOIN c{n} y ON y.i = b{n}.j),
a{n} AS MATERIALIZED (SELECT i, u * sqrt(k) * CASE WHEN first_value(u) OVER (ORDER BY -floor(abs(u * sqrt(k)) * 1000000000 + 0.5), i) < 0 THEN -1 ELSE 1 END AS u, k FROM c{n}, k{n}),
b{n + 1} AS MATERIALIZED (SELECT b{n}.i, b{n}.j, b - x.u * y.u AS b FROM b{n} JOIN a{n} x ON x.i = b{n}.i JOIN a{n} y ON y.i = b{n}.j)"""


@query("a12k_centred", GOWER + f" SELECT i AS id_a, j AS id_b, {rounded('b')} AS b FROM b0 WHERE i <= j")
def a12k(spark, sf):
    return ordination.centred(pairs(spark, sf)).withColumn("b", six(F.col("b")))


@query("q1_ordination", GOWER + f", {leading(0)}, {leading(1)} SELECT id, {rounded('x.u')} AS x, {rounded('y.u')} AS y, label, starts_with(label, 'novel_') AS novel FROM lab JOIN a0 x ON x.i = id JOIN a1 y ON y.i = id")
def q1(spark, sf):
    found = ordination.ordination(pairs(spark, sf)).join(labels_of(spark, sf), "id")
    return found.select("id", six(F.col("x")).alias("x"), six(F.col("y")).alias("y"), "label", F.col("label").startswith("novel_").alias("novel"))


@query("a13k_shares")
def a13k(spark, sf):
    """What the two axes show of the whole."""
    return ordination.ordination(pairs(spark, sf)).select("share_x", "share_y").distinct()


@query("a15k_tree")
def a15k(spark, sf):
    return ordination.tree(pairs(spark, sf))
