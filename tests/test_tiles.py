"""What tiles sum up, against the table of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from seqlens.operators import distance, relational


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(2)
    made = [(i, "".join(draw.choices("ACGTacgtuN-", k=draw.randint(0, 30))), draw.choice(["a", "b", "c", "c"])) for i in range(60)]
    return spark.createDataFrame([*made, (60, "ACGT", None), (61, "", "d"), (62, "ACGT", "e")], "id long, seq string, label string").repartition(3)


@pytest.mark.parametrize("tile_rows", [512, 9])
def test_pair_classes(rows, tile_rows):
    pairs = distance.labelled(distance.aligned_pairs(rows), rows.select("id", "label").where("label IS NOT NULL"))
    key = ["label_a", "label_b", "comparable", "differing", "p"]
    want = {tuple(r) for r in pairs.groupBy(*key).count().select(*key, "count").collect()}
    found = distance.pair_classes(rows, tile_rows)
    assert {tuple(r) for r in found.select(*key, "n").collect()} == want
    total = found.agg(F.sum("n")).first()[0]
    assert total == 62 * 61 // 2 and found.count() < total


@pytest.mark.parametrize("correct", [False, True])
@pytest.mark.parametrize("tile_rows", [512, 9])
def test_medoids_of(rows, tile_rows, correct):
    table = distance.distance_table(rows.select("id", "seq"), aligned=True, correct=correct)
    labels = rows.select("id", "label").where("label IS NOT NULL")
    as_map = lambda df: {r["label"]: (r["medoid"], round(r["sum_d"], 6)) for r in df.collect()}
    assert as_map(distance.medoids_of(rows, correct, tile_rows)) == as_map(distance.medoids(table, labels)) != {}


def test_weights_stand_for_rows(spark):
    draw = random.Random(3)
    made = [(draw.choice("ab"), draw.choice([0.1, 0.2, 0.25, 0.5, None]), draw.randint(1, 6)) for _ in range(60)]
    light = spark.createDataFrame(made, "g string, v double, n long")
    heavy = light.select("g", "v", F.explode(F.sequence(F.lit(1), "n")).alias("_")).select("g", "v")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(relational.five_numbers(light, "g", "v", "n")) == rows(relational.five_numbers(heavy, "g", "v"))
    assert rows(relational.cliffs_delta(light.dropna(), "g", "a", "b", "v", "n")) == rows(relational.cliffs_delta(heavy.dropna(), "g", "a", "b", "v"))


def test_delta_of_more_pairs_than_a_long_holds(spark):
    rows = spark.createDataFrame([("a", 1.0, 10**12), ("a", 3.0, 10**12), ("b", 2.0, 10**12), ("b", 3.0, 10**12)], "g string, v double, n long")
    assert relational.cliffs_delta(rows, "g", "a", "b", "v", "n").first()["delta"] == -0.25


def test_tiles_within_groups(spark):
    draw = random.Random(7)
    rows = spark.createDataFrame([(i, "".join(draw.choices("ACGT", k=20)), i % 3) for i in range(40)], "id long, seq string, part int")
    for tile_rows in (512, 5):
        inside = {tuple(r) for r in distance.kmer_pairs(rows, 3, tile_rows, within="part").collect()}
        every = {(r["id_a"] % 3, *r) for r in distance.kmer_pairs(rows, 3).where("id_a % 3 = id_b % 3").collect()}
        assert inside == every


def test_pyramid_of_a_matrix(spark):
    n = 13
    draw = random.Random(5)
    cells = {(i, j): draw.random() for i in range(1, n + 1) for j in range(i, n + 1) if draw.random() < 0.9}
    found = distance.pyramid(spark.createDataFrame([(*at, d) for at, d in cells.items()], "i long, j long, d double"), 5).collect()
    for level in range(5):
        want = {}
        for (i, j), d in cells.items():
            want.setdefault(((i - 1 >> level) + 1, (j - 1 >> level) + 1), []).append(d)
        got = {(r["i"], r["j"]): (r["n"], round(r["mean"], 9), r["most"]) for r in found if r["level"] == level}
        assert got == {at: (len(own), round(sum(own) / len(own), 9), max(own)) for at, own in want.items()}
    assert len([r for r in found if r["level"] == 4]) == 1
