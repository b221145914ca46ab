"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from seqlens.llm import decontaminate, html_extract, language_id, packing, pii, quality, sharding, simhash, substrings, tokenizer_fst

LONG = "wordy " * 60_000
ROWS = [(1, "The cat sat on the mat and the dog sat on the log.", "en"), (1, "The cat sat on the mat and the dog sat on the log.", "en"), (2, None, "en"), (3, "", None), (None, "Der Hund und die Katze sind in dem Haus.", "de"), (None, None, None), (4, LONG, "en"), (5, " \t\n ", "de"), (6, "12345 !!! 67", None), (7, "Der Hund und die Katze sind in dem Haus.", "de"), (7, "another text under the same id", "en")]
SCHEMA = "doc_id long, text string, lang string"
CLASHES = ("n_words", "n_bytes", "n_tokens", "score", "slot", "shard", "fp", "part", "bucket", "row_id", "items", "kept", "n_entities", "cell", "start", "length", "label", "held_out_", "component_id", "rank", "url2")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).select("*", *[F.lit("x").alias(c) for c in CLASHES])


@pytest.fixture(scope="module")
def operators(spark, tokenizer):
    items = spark.createDataFrame([(1, "the cat sat on the mat"), (2, None), (None, "x y"), (3, "")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1), (7, 0), (None, 1), (2, None)], "doc_id long, quality int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    return {
        "language": lambda d: language_id.identify(d, language_id.fit_profiles(d)),
        "simhash": simhash.components,
        "quality": lambda d: quality.judge(d, quality.train(d, labels)),
        "quality without labels": lambda d: quality.judge(d, quality.train(d, none)),
        "decontamination": lambda d: decontaminate.contamination(d, items),
        "decontamination, no items": lambda d: decontaminate.contamination(d, items.limit(0)),
        "pii": lambda d: pii.pseudonymise(d, "key"),
        "substrings": substrings.remove_repeats,
        "sharding": lambda d: sharding.place(d, ["a", "b"], slots=7),
        "tokens": lambda d: tokenizer_fst.count_tokens(d, tokenizer),
        "html": lambda d: html_extract.extract(d.withColumn("url", F.lit(None).cast("string")), "doc_id", "url", "text"),
    }


NAMES = ["language", "simhash", "quality", "quality without labels", "decontamination", "decontamination, no items", "pii", "substrings", "sharding", "tokens", "html"]


@pytest.mark.parametrize("name", NAMES)
def test_one_row_out_for_each_row_in(docs, operators, name):
    ids = lambda d, c: sorted((r[0] for r in d.select(c).collect()), key=lambda x: (x is None, x))
    out = operators[name](docs)
    assert ids(out, out.columns[0]) == ids(docs, "doc_id")


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(docs, operators, name):
    assert operators[name](docs.limit(0)).collect() == []


def test_packing_edges(docs, tokenizer):
    pieces = packing.pack_documents(docs, tokenizer).collect()
    assert packing.pack_documents(docs.limit(0), tokenizer).collect() == []
    per_doc = {}
    for r in pieces:
        per_doc.setdefault(r["doc_id"], 0)
        per_doc[r["doc_id"]] += r["length"]
    assert per_doc[2] == per_doc[3] == 1 and per_doc[4] > 60_000
    assert sum(r["start"] == 0 for r in pieces) == len(ROWS)


def test_defined_results(docs, operators, tokenizer):
    by = lambda d, c: {(r["doc_id"], r[c]) for r in d.collect()}
    language = by(operators["language"](docs), "lang_pred")
    assert {(2, "und"), (3, "und"), (5, "und"), (6, "und"), (1, "en"), (7, "de")} <= language
    components = {(r["doc_id"], r["component_id"]) for r in operators["simhash"](docs).collect()}
    assert {(2, 2), (3, 2), (5, 2), (None, 2), (None, 7), (1, 1)} <= components
    removed = {(r["doc_id"], r["n_removed"]) for r in operators["substrings"](docs).collect()}
    assert (1, 50) not in removed and {(2, 0), (3, 0), (7, 0)} <= removed
    assert all(r["component_id"] is not None for r in operators["simhash"](docs).where("doc_id IS NOT NULL").collect())
