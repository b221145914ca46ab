import functools
import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlens.operators import clustering, curation, distance, ordination, relational, similarity
from seqlens.operators import linkage as trees
from seqlens.operators import nearest as kernel
from seqlens.operators.components import connected_components


def linkage(d, t):
    """Average linkage by the definition: cluster distances are means over all pairs of members."""
    groups = [[i] for i in range(len(d))]
    while len(groups) > 1:
        h, i, j = min((np.mean([d[a][b] for a in groups[i] for b in groups[j]]), i, j) for i, j in itertools.combinations(range(len(groups)), 2))
        if h > t:
            break
        groups[i] += groups.pop(j)
    return sorted(sorted(g) for g in groups)


def test_average_linkage():
    r = np.random.default_rng(0)
    for _ in range(20):
        x = r.random((r.integers(2, 20), 2))
        d = np.linalg.norm(x[:, None] - x[None], axis=-1)
        cuts = [0.1, 0.3]
        for t, own in zip(cuts, trees.average_linkage(d, cuts), strict=True):
            assert sorted(np.flatnonzero(own == o).tolist() for o in set(own.tolist())) == linkage(d, t)


def test_clusters_by_component_are_global(spark):
    r = np.random.default_rng(3)
    x = r.random((40, 2))
    d = np.linalg.norm(x[:, None] - x[None], axis=-1)
    pairs = spark.createDataFrame([(i, j, float(d[i, j])) for i, j in itertools.combinations(range(40), 2)], "id_a long, id_b long, d double")
    ids = spark.range(40)
    cuts = {"a": 0.25, "b": 0.12}
    rows = clustering.clusters(ids, pairs, cuts, far=2.0).collect()
    for name, t in cuts.items():
        own = {}
        for q in rows:
            own.setdefault(q[name], []).append(q["id"])
        assert sorted(sorted(g) for g in own.values()) == linkage(d, t)
        assert all(k == min(g) for k, g in own.items())


def both_plans(spark, d, cuts, far=2.0, weight=None):
    """The clusters of one component by a matrix and by rounds: id to its cluster at each cut."""
    n = len(d)
    nodes = spark.createDataFrame([(i, 0, 1 if weight is None else weight[i]) for i in range(n)], "id long, component long, weight long")
    edges = spark.createDataFrame([(0, i, j, float(d[i, j])) for i, j in itertools.combinations(range(n), 2) if d[i, j] < far], "component long, id_a long, id_b long, d double")
    as_map = lambda df: {r["id"]: tuple(r[c] for c in cuts) for r in df.collect()}
    out = as_map(trees.linked(nodes, edges, cuts, far, n)), as_map(trees.linked(nodes, edges, cuts, far, 0))
    assert len(out[0]) == n and out[0] == as_map(trees.linked(nodes, edges, cuts, far, n // 2))  # the last begins by rounds and ends by a matrix
    return out


@pytest.mark.parametrize("kind", ["points", "sparse", "ties", "copies", "weights"])
def test_rounds_equal_the_matrix(spark, kind):
    r = np.random.default_rng(len(kind))
    x = r.random((30, 2))
    if kind == "copies":
        x = x[r.integers(0, 8, 30)]
    if kind == "ties":
        x = np.round(x[:15] * 4) / 4
    d = np.abs(x[:, None] - x[None]).sum(axis=-1)
    if kind == "sparse":
        d[d > 0.4] = 2.0
    by_matrix, by_rounds = both_plans(spark, d, {"b": 0.35, "a": 0.15}, weight=r.integers(1, 9, 30).tolist() if kind == "weights" else None)
    assert by_matrix == by_rounds and len(set(by_rounds.values())) > 1


def test_weight_stands_for_copies(spark):
    r = np.random.default_rng(4)
    x, weight = r.random((15, 2)), r.integers(1, 5, 15)
    every = np.repeat(np.arange(15), weight)
    of = lambda p: np.linalg.norm(p[:, None] - p[None], axis=-1)
    cuts = {"a": 0.2, "b": 0.4}
    one = both_plans(spark, of(x), cuts, weight=weight.tolist())[1]
    many = both_plans(spark, of(x[every]), cuts)[0]
    assert all(many[i] == tuple(np.flatnonzero(every == c)[0] for c in one[w]) for i, w in enumerate(every.tolist()))


def by_heap(n, edges, cut, far):
    """Average linkage of a sparse graph, the closest pair first."""
    import heapq

    near = [{} for _ in range(n)]
    for i, j, d in edges:
        near[i][j] = near[j][i] = (d, 1)
    size, owner = [1] * n, list(range(n))
    height = lambda i, j: (near[i][j][0] + far * (size[i] * size[j] - near[i][j][1])) / (size[i] * size[j])
    heap = [(d, i, j) for i, j, d in edges]
    heapq.heapify(heap)
    while heap and heap[0][0] <= cut:
        d, i, j = heapq.heappop(heap)
        if size[i] and size[j] and j in near[i] and height(i, j) == d:
            for k, (s, c) in near[j].items():
                del near[k][j]
                if k != i:
                    t, e = near[i].get(k, (0.0, 0))
                    near[i][k] = near[k][i] = (s + t, c + e)
            near[j] = {}
            size[i], size[j], owner[j] = size[i] + size[j], 0, i
            for k in near[i]:
                heapq.heappush(heap, (height(i, k), *sorted((i, k))))
    root = lambda i: i if owner[i] == i else root(owner[i])
    return [root(i) for i in range(n)]


def test_large_component_without_a_matrix(spark):
    """20,000 rows of one component, 200,000 of its pairs nearer than far."""
    r = np.random.default_rng(8)
    n = 20_000
    ends = {(i, i + 1) for i in range(n - 1)} | {tuple(sorted(p)) for p in zip(r.integers(0, n, 180_000).tolist(), r.integers(0, n, 180_000).tolist(), strict=True) if p[0] != p[1]}
    edges = [(i, j, float(d)) for (i, j), d in zip(sorted(ends), r.random(len(ends)), strict=True)]
    nodes = spark.range(n).selectExpr("id", "0L AS component", "1L AS weight")
    table = spark.createDataFrame([(0, *e) for e in edges], "component long, id_a long, id_b long, d double")
    found = {row["id"]: row["c"] for row in trees.linked(nodes, table, {"c": 0.5}).collect()}
    assert [found[i] for i in range(n)] == by_heap(n, edges, 0.5, 1.0)


def test_novel_groups(spark):
    r = random.Random(1)
    first, second, third, fourth = ("".join(r.choices("ACGT", k=80)) for _ in range(4))
    rows = [(1, first), (2, first[1:]), (3, second), (4, second[:-1]), (5, second), (6, third), (7, fourth), (8, "ACG"), (9, None)]
    found = clustering.novel_groups(spark.createDataFrame(rows, "id long, seq string"))
    got = {q["id"]: (q["label"], q["size"]) for q in found.collect()}
    assert got == {1: ("novel_2", 2), 2: ("novel_2", 2), 3: ("novel_1", 3), 4: ("novel_1", 3), 5: ("novel_1", 3)} | dict.fromkeys((6, 7, 8, 9), ("ST_unassigned", None))
    none = clustering.novel_groups(spark.createDataFrame(rows[7:], "id long, seq string")).collect()
    assert {q["label"] for q in none} == {"ST_unassigned"} and len(none) == 2


def test_outliers(spark):
    points = {1: 0.0, 2: 0.001, 3: 0.002, 4: 0.003, 5: 0.2, 6: 0.5, 7: 0.5}
    labels = spark.createDataFrame([(i, "A" if i <= 5 else "B", 1 if i != 5 else 9) for i in points], "id long, label string, cluster int")
    pairs = spark.createDataFrame([(i, j, abs(points[i] - points[j])) for i, j in itertools.combinations(points, 2)], "id_a long, id_b long, d double")
    got = {r["id"]: r for r in clustering.outliers(labels, pairs).collect()}
    assert [i for i, r in got.items() if r["potential_novel_variant"]] == [5]
    assert "minority cluster (9)" in got[5]["novel_variant_reason"] and got[5]["novel_variant_reason"].startswith("d_medoid=")
    assert got[6]["dist_from_medoid"] is None and got[3]["dist_from_medoid"] == 0.0


def test_components(spark):
    r = random.Random(0)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, None), (7, 7)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            p, q = root(a), root(b)
            parent[max(p, q)] = min(p, q)
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for x in list(parent)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_tiles(spark):
    r = random.Random(2)
    seqs = ["".join(r.choice("ACGT-Nu") for _ in range(r.randint(0, 30))) for _ in range(25)]
    rows = spark.createDataFrame(list(enumerate(seqs)), "id long, seq string")
    for size in (512, 7):
        got = {(x["id_a"], x["id_b"]): (x["comparable"], x["differing"], x["p"]) for x in distance.aligned_pairs(rows, tile_rows=size).collect()}
        assert len(got) == 25 * 24 // 2
        for (a, b), (n, m, p) in got.items():
            both = [(x, y) for x, y in zip(seqs[a].upper().replace("U", "T"), seqs[b].upper().replace("U", "T"), strict=False) if x in "ACGT" and y in "ACGT"]
            assert (n, m) == (len(both), sum(x != y for x, y in both)) and p == (m / n if n else 1.0)


@pytest.mark.parametrize("letters", ["ACGT", "ACGTacgt-Nß", "абв中😀"])
def test_kmer_pairs(spark, monkeypatch, letters):
    r = random.Random(6)
    seqs = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(30)] + [None, "", letters[:2]]
    sets = [{t[i : i + 3] for t in [(s or "").upper().replace("-", "").replace("N", "")] for i in range(len(t) - 2)} for s in seqs]
    want = {(a, b): (len(sets[a] & sets[b]), 1 - len(sets[a] & sets[b]) / len(sets[a] | sets[b])) for a in range(len(seqs)) for b in range(a + 1, len(seqs)) if sets[a] & sets[b]}
    rows = spark.createDataFrame(list(enumerate(seqs)), "id long, seq string")
    for tile_rows, columns in ((512, 4096), (7, 5)):
        monkeypatch.setattr(distance, "COLUMNS", columns)
        assert {(x["id_a"], x["id_b"]): (x["shared"], x["d"]) for x in distance.kmer_pairs(rows, 3, tile_rows).collect()} == want


def take_plan(monkeypatch, plan):
    """How neighbours() searches: all queries sent to the references, in small blocks and lanes, or joined on k-mers."""
    monkeypatch.setattr(kernel, "MAX_QUERIES", 4096 if plan == "one pass" else -1)
    in_blocks = functools.partial(BLOCKS, block_rows=9, lane_rows=20)
    by_join = lambda q, r, k, contained, top: similarity.top_neighbours(similarity.joined_pairs(q, r, k, contained), q, r, top).select("query_id", "ref_id", "d")
    monkeypatch.setattr(kernel, "nearest_in_blocks", by_join if plan == "join" else in_blocks)


BLOCKS = kernel.nearest_in_blocks
PLANS = ["one pass", "blocks", "join"]


@pytest.fixture(params=PLANS)
def either_way(request, monkeypatch):
    take_plan(monkeypatch, request.param)


@pytest.mark.parametrize("letters", ["ACGT" * 6 + "N-RYk", "ACGTacgtéß", "абвАБ σΣ", "中文字符AC😀𠀀", "".join(map(chr, range(0x100, 0x400)))])
def test_all_plans_agree(spark, monkeypatch, letters):
    r = random.Random(9)
    make = lambda n: "".join(r.choice(letters) for _ in range(n))
    texts = [make(r.randint(0, 300)) for _ in range(100)]
    refs = spark.createDataFrame([(i, t, f"L{i % 4}") for i, t in enumerate([*texts, *texts[:20], None, ""])], "id long, seq string, label string")
    queries = spark.createDataFrame([(i, t) for i, t in enumerate([*(t[i % 7 : 200] for i, t in enumerate(texts[:20])), *(make(r.randint(0, 120)) for _ in range(20)), None, "", "AC"])], "id long, seq string")
    found = []
    for plan in PLANS:
        take_plan(monkeypatch, plan)
        found.append([sorted(map(tuple, f(queries, refs, 4).collect())) for f in (similarity.map_fragments, similarity.place)])
    assert found[0] == found[1] == found[2]
    assert len(found[0][0]) == len(found[0][1]) == 43


def test_a_letter_run_that_all_have_is_no_key(spark, monkeypatch):
    """Copies of one query and one reference by the hundred: no k-mer is dealt out by, and ties go to the least ids."""
    take_plan(monkeypatch, "blocks")
    text = "ACGTTGCAACGGTTAACC"
    queries = spark.range(150).select("id", F.lit(text).alias("seq"))
    refs = spark.range(300).select("id", F.lit(text * 2).alias("seq"), F.lit("x").alias("label"))
    plan = kernel.nearest_in_blocks(queries, refs, 8, True, 5)
    assert "kmer" not in plan._jdf.queryExecution().toString()
    near = similarity.neighbours(queries, refs, 8, contained=True)
    assert near.count() == 750 and near.where("d = 0.0").count() == 750
    assert {tuple(r) for r in plan.where("query_id = 7").orderBy("d", "ref_id").limit(5).collect()} == {(7, i, 0.0) for i in range(5)}


def test_placement_beyond_ascii(spark, either_way):
    seeds = spark.createDataFrame([(i, t, f"L{i}") for i, t in enumerate(["ACGTACGTAC", "что такое хорошо", "привет мир как дела сегодня", "?????????", "GGGGGGG", "TTTTTTTT"])], "id long, seq string, label string")
    queries = spark.createDataFrame([(1, "привет мир как дела сегод"), (2, "中文字符")], "id long, seq string")
    got = {r["id"]: (r["assigned"], r["d"]) for r in similarity.place(queries, seeds, 4).collect()}
    assert got[1][0] == "L2" and abs(got[1][1] - (1 - 22 / 24)) < 1e-12 and got[2] == ("Unplaced", 1.0)


def test_placement_rules(spark, either_way):
    base = "ACGTTGCAACGGTTAACCGGATATCGCGTTAAGGCCAATTCCGGTTAACGAT"
    seeds = spark.createDataFrame([("a", base, "ST1"), ("b", base[:-1] + "A", "ST2"), ("c", base[:-2] + "AA", "ST2"), ("d", "T" * 40, "ST9"), ("e", "C" * 30, "ST9"), ("f", "G" * 30, "ST9")], "id string, seq string, label string")
    queries = spark.createDataFrame([("q1", base), ("q2", "AT"), ("q3", "GATTACAGATTACATTTGAC")], "id string, seq string")
    got = {r["id"]: r for r in similarity.place(queries, seeds).collect()}
    assert got["q1"]["assigned"] == "ST1" and got["q1"]["d"] == 0.0 and got["q1"]["confidence"] == "low"  # the vote is for ST2
    assert (got["q2"]["assigned"], got["q2"]["d"], got["q2"]["confidence"]) == ("Unplaced", 1.0, "rejected")
    assert got["q3"]["d"] == 1.0 and got["q3"]["confidence"] == "low"  # nothing shared: the lowest ids fill up, and their vote differs
    strict = {r["id"]: r["confidence"] for r in similarity.place(queries, seeds, strict_reject=True).collect()}
    assert strict["q3"] == "rejected"
    assert {r["assigned"] for r in similarity.place(queries, seeds.limit(0)).collect()} == {"Unplaced"}


def test_containment_is_strand_free(spark, either_way):
    text = "ACGTTGCAACGGTTAACCGGATATCGCGTTAAGGCCAATTCCGG"
    refs = spark.createDataFrame([(1, text * 2, "x"), (2, "T" * 50, "y")], "id long, seq string, label string")
    complement = text[5:30].translate(str.maketrans("ACGT", "TGCA"))[::-1]
    queries = spark.createDataFrame([(7, text[5:30]), (8, complement)], "id long, seq string")
    got = {r["id"]: r for r in similarity.map_fragments(queries, refs).collect()}
    assert all(r["assigned"] == "x" and r["containment_dist"] == 0.0 and r["confidence"] == "high" for r in got.values())
    assert got[7]["top5"] == "x:0.000; y:1.000"


def test_cliffs_delta(spark):
    r = random.Random(1)
    rows = [(g, float(r.randrange(12) + s)) for g, s in (("a", 0), ("b", 3)) for _ in range(60)]
    a, b = ([v for g, v in rows if g == k] for k in "ab")
    want = sum((x > y) - (x < y) for x in a for y in b) / 3600
    got = relational.cliffs_delta(spark.createDataFrame(rows, "g string, v double"), "g", "a", "b", "v").first()
    assert math.isclose(got["delta"], want)
    empty = relational.cliffs_delta(spark.createDataFrame([("a", 1.0)], "g string, v double"), "g", "a", "b", "v").first()
    assert empty["delta"] is None


def test_ordination_and_tree(spark):
    x = np.array([[0, 0], [3, 0], [0, 4], [3, 4], [1, 1]], float)
    d = np.linalg.norm(x[:, None] - x[None], axis=-1)
    xy, share = ordination.principal_coordinates(d)
    assert np.allclose(np.linalg.norm(xy[:, None] - xy[None], axis=-1), d) and math.isclose(share.sum(), 1.0)
    tree = ordination.neighbour_joining(["a", "b", "c", "d"], np.array([[0, 3, 8, 9], [3, 0, 9, 10], [8, 9, 0, 9], [9, 10, 9, 0]], float))
    assert tree.count("(") == 3 and "a:1.000000,b:2.000000" in tree
    pairs = spark.createDataFrame([(1, 2, 0.1), (1, 3, 0.2), (2, 3, 0.3)], "id_a long, id_b long, d double")
    with pytest.raises(ValueError):
        ordination.tree(pairs, most=2)


def distance_rows(spark, d, far):
    n = len(d)
    return spark.createDataFrame([(i, j, float(d[i, j])) for i, j in itertools.combinations(range(n), 2) if d[i, j] != far], "id_a long, id_b long, d double")


@pytest.mark.parametrize("kind", ["points", "sets"])
def test_axes_without_a_matrix(spark, kind):
    """The same coordinates as from the matrix: of points, and of sets of which many pairs are absent and some eigenvalues negative."""
    r = np.random.default_rng(6)
    x = r.random((40, 4)) * [4, 2, 0.5, 0.2]
    d = np.linalg.norm(x[:, None] - x[None], axis=-1)
    far = 9.0
    if kind == "sets":
        s = (r.random((40, 12)) < 0.25) | (np.arange(40)[:, None] % 12 == np.arange(12))
        shared = (s[:, None] & s[None]).sum(axis=-1)
        d, far = 1 - shared / np.maximum((s[:, None] | s[None]).sum(axis=-1), 1), 1.0
        np.fill_diagonal(d, 0)
    pairs = distance_rows(spark, d, far)
    as_map = lambda df: {q["id"]: np.array([q["x"], q["y"]]) for q in df.collect()}
    by_matrix, by_joins = as_map(ordination.ordination(pairs, far)), as_map(ordination.ordination(pairs, far, most=10))
    assert set(by_matrix) == set(by_joins) == set(range(40))
    assert max(np.abs(by_matrix[i] - by_joins[i]).max() for i in range(40)) < 1e-4
    if kind == "points":
        shares = [tuple(ordination.ordination(pairs, far, most=m).select("share_x", "share_y").first()) for m in (100, 10)]
        assert np.allclose(*shares)


def test_centred_matrix(spark):
    r = np.random.default_rng(2)
    d = np.round(r.random((12, 12)), 2)
    d = np.minimum(d, d.T)
    d[d > 0.7] = 1.0
    np.fill_diagonal(d, 0)
    centre = np.eye(12) - 1 / 12
    want = -0.5 * centre @ d**2 @ centre
    found = ordination.centred(distance_rows(spark, d, 1.0), 1.0).collect()
    assert len(found) == 12 + (np.triu(d != 1.0, 1)).sum() and all(math.isclose(q["b"], want[q["id_a"], q["id_b"]], abs_tol=1e-12) for q in found)


def test_merge_and_first(spark):
    prior = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    new = spark.createDataFrame([("b", 2), ("c", 2)], "k string, v int")
    assert sorted(map(tuple, relational.merge_newest(prior, new, "k").collect())) == [("a", 1), ("b", 2), ("c", 2)]
    assert sorted(map(tuple, relational.merge_prior(prior, new, "k").collect())) == [("a", 1), ("b", 1), ("c", 2)]
    rows = spark.createDataFrame([("A.1",), ("A",), ("B.2",), ("C",)], "k string")
    assert sorted(r["k"] for r in relational.without_known(rows, spark.createDataFrame([("A.1",), ("C",)], "k string"), "k").collect()) == ["B.2"]


def test_curate(spark):
    features = "array<struct<type:string,qualifiers:map<string,array<string>>>>"
    r = random.Random(4)
    make = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    one, two, three = make(1200), make(1200), make(1200)
    rows = [("AB1.1", "ST1", one), ("AB2.1", "ST1", one), ("AB3.1", "", one[:-3] + "AAA"), ("AB4.1", "", two), ("AB5.1", "", two[:-2] + "CC"), ("AB6.1", "", three), ("XM_7.1", "ST1", make(1200)), ("AB8.1", "ST1", "ACGT")]
    records = spark.createDataFrame([(i, a, "n", "d", "", s, "", {}, [("source", {"isolate": [x]} if x else {})], "broad_query", "q") for i, (a, x, s) in enumerate(rows)], f"ord long, accession string, name string, description string, organism string, seq string, comment string, structured_comment map<string,map<string,string>>, features {features}, source string, query string")
    got = {x["accession"]: (x["subtype"], x["st_confidence"]) for x in curation.curate(records, "Examplea").collect()}
    assert got == {"AB1.1": ("ST1", "high"), "AB3.1": ("ST1", "high"), "AB4.1": ("novel_1", "novel_cluster"), "AB5.1": ("novel_1", "novel_cluster"), "AB6.1": ("ST_unassigned", "unplaced")}


def test_quantiles(spark):
    r = random.Random(2)
    rows = [(r.choice(["a", "a", "a", "b", None]), r.choice([None, *(x / 7 for x in range(50))])) for _ in range(3000)] + [("one", 3.5), ("none", None)]
    points = {"low": 0.0, "q1": 0.25, "m": 0.5, "p": 0.987, "high": 1.0}
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    found = {x["k"]: x for x in relational.quantiles(df, ["k"], "v", points).collect()}
    assert found.keys() == {"a", "b", None, "one"}
    for k, x in found.items():
        values = [v for key, v in rows if key == k and v is not None]
        assert x["n"] == len(values)
        assert all(math.isclose(x[name], np.quantile(values, p), abs_tol=1e-12) for name, p in points.items())
    (x,) = relational.quantiles(df, [], "v", {"m": 0.5}).collect()
    assert math.isclose(x["m"], np.quantile([v for _, v in rows if v is not None], 0.5))
    assert relational.quantiles(df.limit(0), ["k"], "v", points).collect() == []


def test_counts_of_a_run(spark):
    """What a run says of its steps is what its steps give one by one; with or without counting it gives the same rows."""
    from seqlens.plans import metadata_queries as queries

    own = queries.records(spark, "/root/testdata/sf0.001").drop("label", "confidence").cache()
    counts = curation.StepCounts()
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(curation.curate(own, queries.GENUS, 28, 31, counts=counts)) == rows(curation.curate(own, queries.GENUS, 28, 31))
    found = {(step, what): n for step, what, n in counts.found()}
    good = curation.quality_filter(own)
    sized = curation.length_filter(good, 28, 31)
    labelled = curation.labelled(sized, queries.GENUS)
    want = {"read": own.count(), "quality": good.count(), "length": sized.count(), "labelled": labelled.count(), "placed": labelled.where("label IS NULL").count()}
    assert {step: found[step, "n"] for step in want} == want
    assert found["read", "predicted"] + found["read", "molecule_type"] == want["read"] - want["quality"] > 0
    assert found["quality", "too_short"] + found["quality", "too_long"] == want["quality"] - want["length"]
    assert sum(found["placed", k] for k in ("high", "medium", "low", "rejected")) == want["placed"] > 0


def test_second_pass(spark):
    """Against the rules, record by record."""
    from seqlens.operators import acquisition
    from seqlens.plans import metadata_queries as queries

    own = queries.gene_records(spark, "/root/testdata/sf0.001").cache()
    first = acquisition.narrow_pass(own, "ST7", queries.GENUS).cache()
    rows = own.select("accession", "ord", "seq", "source").collect()
    had = {r["accession"] for r in first.collect()}
    bare = {a.split(".")[0] for a in had}
    contents, added = {r["md5"] for r in first.collect()}, {}
    sets = lambda t: {t[i : i + 8] for t in [t.upper().replace("-", "").replace("N", "")] for i in range(len(t) - 7)}
    seeds = sorted((r["accession"], sets(r["seq"])) for r in first.collect())
    for r in sorted((r for r in rows if r["source"] == "broad_query" and r["accession"] not in had and r["accession"].split(".")[0] not in bare), key=lambda r: r["ord"]):
        mine = sets(r["seq"])
        nearest = min((1 - len(mine & s) / len(mine | s) if mine and s else 1.0 for _, s in seeds), default=1.0)
        md5 = hashlib.md5(r["seq"].upper().encode()).hexdigest()
        if mine and nearest <= 0.9 and md5 not in contents:
            contents.add(md5)
            added[r["accession"]] = md5
    found = {r["accession"]: r for r in acquisition.second_pass(first, own.where("source = 'curated_reference'"), own.where("source = 'broad_query'"), queries.GENUS, min_length=1, max_dist=0.9).collect()}
    assert added and {a: r["md5"] for a, r in found.items()} == added
    assert {r["subtype"] for r in found.values()} == {"ST7"} and {r["acquisition_pass"] for r in found.values()} == {"pass2_placement"}
    unchecked = acquisition.narrow_pass(own, "ST7", queries.GENUS, validate=False)
    assert unchecked.count() >= first.count() and {r[0] for r in unchecked.select("st_confidence").distinct().collect()} == {"unchecked"}


def test_references_come_before_placed_records(spark):
    from seqlens.functions import fixed
    from seqlens.operators import acquisition
    from seqlens.plans import metadata_queries as queries

    own = queries.gene_records(spark, "/root/testdata/sf0.001")
    first = acquisition.narrow_pass(own, "ST7", queries.GENUS)
    one = own.where("source = 'broad_query'").orderBy("ord").limit(1)
    reference = one.withColumn("accession", F.lit(next(iter(fixed.CURATED_LABELS)) + ".1"))
    out = acquisition.second_pass(first, reference, one, queries.GENUS, min_length=1, max_dist=1.0).collect()
    assert [(r["st_confidence"], r["acquisition_pass"]) for r in out] == [("curated_reference", "pass2_reference")]


def test_resumed_steps(spark, tmp_path):
    from seqlens.operators import acquisition

    path, made = f"{tmp_path}/step", []
    make = lambda: made.append(1) or spark.range(5)
    assert acquisition.resumed(spark, path, make).count() == acquisition.resumed(spark, path, make).count() == 5 and len(made) == 1
    (tmp_path / "broken" / "_temporary").mkdir(parents=True)
    assert acquisition.resumed(spark, f"{tmp_path}/broken", make).count() == 5
