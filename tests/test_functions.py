import re
import time

import pytest
from pyspark.sql import functions as F

from seqlens.functions import fixed, kmers, metadata
from seqlens.operators import curation

GENUS = "Examplea"
FEATURES = "array<struct<type:string,qualifiers:map<string,array<string>>>>"


@pytest.fixture(scope="module")
def one(spark):
    return lambda column, **values: spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("date", "want"), [("1998/2021", 2021), ("24-Sep-2022", 2022), ("2024-06", 2024), ("Unknown", None), (None, None), ("2100", None)])
def test_year(one, date, want):
    assert one(metadata.year(F.col("d")), d=date) == want


@pytest.mark.parametrize(("place", "want"), [("Spain:Madrid", "Spain"), ("France:Cote d'Azur, Antibes", "France"), ("", "Unknown"), ("Iraq, Erbil", "Iraq"), (None, "Unknown"), (" : x", "Unknown")])
def test_country(one, place, want):
    assert one(metadata.normalise_country(F.col("c")), c=place) == want


@pytest.mark.parametrize(("host", "want"), [(" Cow ", "Bos taurus"), ("N/A", "Unknown"), (f"{GENUS} sp.", "Unknown"), ("Odd Beast", "Odd Beast"), (None, "Unknown"), ("", "Unknown")])
def test_normalise_host(one, host, want):
    assert one(metadata.normalise_host(F.col("h"), GENUS), h=host) == want


@pytest.mark.parametrize(
    ("qualifiers", "organism", "want"),
    [
        ({"host": "Pig", "note": "from human"}, "", ("Pig", "host_qualifier")),
        ({"host": "unknown", "isolation_source": "cattle"}, "", ("cattle", "isolation_source")),
        ({"isolation_source": "cattle feces", "note": "isolated from a goat"}, "", ("Goat", "note")),
        ({"note": "isolated from Homo sapiens"}, "", ("Homo", "note")),
        ({"note": "human stool"}, "", ("Human", "note")),
        ({"isolation_source": "water"}, f"{GENUS} ratti", ("Rattus norvegicus", "organism")),
        ({}, "x", ("Unknown", "unknown")),
    ],
)
def test_coalesce_host(spark, qualifiers, organism, want):
    features = [("gene", {"host": ["cat"]}), ("source", {k: [v] for k, v in qualifiers.items()}), ("source", {"host": ["dog"]})]
    df = spark.createDataFrame([(features, organism)], f"features {FEATURES}, organism string")
    r = df.select(metadata.coalesce_host(F.col("features"), F.col("organism"), GENUS).alias("h")).first()["h"]
    assert (r["host"], r["host_source"]) == want
    none = df.select(metadata.coalesce_host(F.array().cast(FEATURES), F.lit(None).cast("string"), GENUS).alias("h")).first()["h"]
    assert none["host_source"] == "unknown"


@pytest.mark.parametrize(("note", "description", "want", "label"), [("ST10", "ST2 gene", ["ST10", "ST2"], ("ST10", "medium")), ("ST03", "", ["ST3"], ("ST3", "high")), ("subtype 7", "st4-clone", ["ST4", "ST7"], ("ST4", "medium")), ("st5", "", [], None), ("", "x" * 120 + " ST9", [], None)])
def test_declared_labels(spark, note, description, want, label):
    df = spark.createDataFrame([([("source", {"note": [note]})], "n", description)], f"features {FEATURES}, name string, description string")
    declared = metadata.declared_labels(F.col("features"), F.col("name"), F.col("description"), GENUS)
    r = df.select(declared.alias("d"), metadata.label_of(declared).alias("l")).first()
    assert r["d"] == want
    assert (tuple(r["l"]) if r["l"] else None) == label


def test_validate_claim(spark):
    df = spark.createDataFrame([(["ST1"], "ST1"), (["ST1", "ST2"], "ST1"), ([], "ST1"), (["ST2"], "ST1"), (["ST2"], "NMAST4")], "d array<string>, c string")
    got = [tuple(r["v"]) for r in df.select(metadata.validate_claim(F.col("d"), F.col("c")).alias("v")).collect()]
    assert [g[:2] for g in got] == [(True, "high"), (True, "medium"), (True, "low"), (False, "rejected"), (True, "low")]
    assert got[1][2] == "source declares ST1 alongside ['ST2']"


def test_natural_order(spark):
    labels = ["Unknown", "novel_3", "ST10", "NMAST1", "ST_unassigned", "ST2", "novel_12"]
    df = spark.createDataFrame([(x,) for x in labels], "s string")
    assert [r["s"] for r in df.orderBy(*metadata.natural_order(F.col("s"))).collect()] == ["ST2", "ST10", "NMAST1", "novel_3", "novel_12", "ST_unassigned", "Unknown"]


@pytest.mark.parametrize(("text", "want"), [("asymptomatic patient", "healthy_control"), ("patients", "symptomatic_unspec"), ("colorectal cancer", "colorectal_cancer"), ("lung cancer", "other_cancer"), ("unhealthy; AIDS", "immunocompromised;healthy_control"), ("", ""), (None, "")])
def test_classify(one, text, want):
    assert one(metadata.categories(metadata.classify(F.col("t"))), t=text) == want


def test_classify_is_the_patterns_own_result(spark):
    # an example of each alternative in odd case, with letters that only fold to ASCII, and near misses, against all patterns on all texts
    shown = lambda a: re.sub(r"\[(.)[^\]]*\]\??", r"\1", re.sub(r"\(([^()|]*)[^()]*\)\??", r"\1", a)).replace(r"\b", " ").replace(r"\s+", "\x0b\n ").replace("?", "")
    examples = [shown(a) for p in fixed.DISEASES.values() for a in metadata.alternatives(p)]
    odd = [f(x) for x in examples for f in (str, str.title, lambda x: f"{x.upper()}x", lambda x: x.lower().replace("i", "\u0131").replace("s", "\u017f"), lambda x: x.upper().replace("I", "\u0130").replace("K", "\u212a"), lambda x: f"\u00e9{x.strip()}", lambda x: x[1:])]
    rows = spark.createDataFrame([(x,) for x in [None, "", "environment crash", "\U0001f600 non crohn semis", *odd, *(" ".join(odd[i : i + 3]) for i in range(len(odd)))]], "t string").repartition(4)
    plain = F.array(*[F.when(F.col("t").rlike(metadata.any_of([p])), F.struct(F.lit(c).alias("category"), F.regexp_extract("t", metadata.any_of([p]), 0).alias("evidence"))) for c, p in fixed.DISEASES.items()])
    want = metadata.let(F.filter(plain, lambda h: h.isNotNull()), metadata._by_rule)
    told = rows.select("t", metadata.classify(F.col("t")).alias("got"), metadata.classify(F.col("t"), evidence=False).alias("bare"), want.alias("want")).collect()
    assert all(r["got"] == r["want"] and [h["category"] for h in r["bare"]] == [h["category"] for h in r["want"]] for r in told)
    assert {h["category"] for r in told for h in r["want"]} == set(fixed.DISEASES)
    assert all(re.search(a, x, re.IGNORECASE) for a, x in zip(metadata.DISEASE_WORDS, examples, strict=True))


def test_classify_searches_patterns_only_where_their_words_are(spark):
    # by the time on texts that show nothing; the better of two runs each
    rows = spark.range(200).select(F.concat(F.repeat(F.lit("Ontion reand shble hewh. "), 4000), F.col("id").cast("string")).alias("t")).persist()
    rows.count()
    plain = F.array(*[F.col("t").rlike(metadata.any_of([p])) for p in fixed.DISEASES.values()])

    def seconds(column):
        taken = []
        for _ in range(2):
            start = time.monotonic()
            rows.select(F.sum(F.size(column))).collect()
            taken.append(time.monotonic() - start)
        return min(taken)

    assert 1.5 * seconds(metadata.classify(F.col("t"), evidence=False)) < seconds(plain)


def test_tags_and_headers(one):
    assert one(metadata.tag(F.col("d"), "host"), d="x [host= Bos taurus ] [host=b]") == "Bos taurus"
    assert one(metadata.tag(F.col("d"), "date"), d="x") == "Unknown"
    made = one(metadata.header(F.col("d"), {t: F.lit("v") for t in metadata.TAGS}), d="text")
    assert made.startswith("text [subtype=v] [host=v]") and made.endswith("[host_source=v]")


def test_molecule_and_prefix(spark):
    rows = [("XM_1", "genomic DNA"), ("AB1", "mRNA"), ("AB2", "viral protein"), ("AB3", "odd"), ("AB4", "rRNA")]
    df = spark.createDataFrame([(a, [("source", {"mol_type": [m]})]) for a, m in rows], f"accession string, features {FEATURES}")
    got = [r["r"] for r in df.select(metadata.drop_reason(F.col("accession"), F.col("features")).alias("r")).collect()]
    assert got == ["predicted", "molecule_type", "molecule_type", None, None]
    assert {r["accession"] for r in curation.quality_filter(df).collect()} == {"AB3", "AB4"}


def test_kmers(one):
    assert one(kmers.kmer_set(F.col("s"), 3), s="acg-nta") == ["ACG", "CGT", "GTA"]
    assert one(kmers.strict_kmer_set(F.col("s"), 3), s="acgnacg") == ["ACG"]
    assert one(kmers.kmer_set(F.col("s"), 8), s="ACGT") == []
    assert one(kmers.reverse_complement(F.col("s")), s="AACGx") == "xCGTT"
    assert one(kmers.packed(F.col("s")), s="ACGTACGT") == int("01230123", 4)
    assert one(kmers.codes(F.col("s")), s="AcgTuN-") == "1234400"


def test_distances(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], ["a"])], "a array<string>, b array<string>")
    assert [round(r[0], 6) for r in df.select(kmers.jaccard_distance(F.col("a"), F.col("b"))).collect()] == [round(2 / 3, 6), 1.0]
    p = spark.createDataFrame([(0.0,), (0.9,), (0.1,)], "p double").select(kmers.jukes_cantor(F.col("p")).alias("d")).collect()
    assert p[0]["d"] == 0.0 and str(p[0]["d"]) == "0.0" and round(p[1]["d"], 3) == 6.692 and round(p[2]["d"], 6) == 0.107326


def test_fixed_values():
    assert len(fixed.REGISTRY) == 52
    counts = {s: sum(r[1] == s for r in fixed.REGISTRY) for s in ("accepted", "tentative", "contested", "avian_nmast")}
    assert counts == {"accepted": 30, "tentative": 10, "contested": 4, "avian_nmast": 8}
    assert len(metadata.palette(5)) == 5 and all(len(c) == 7 for c in metadata.palette(5))
    assert "ST18" not in curation.selected_labels() and curation.selected_labels(" st1,ST2") == ["ST1", "ST2"]
    assert len(curation.selected_labels(contested=True)) == 44
