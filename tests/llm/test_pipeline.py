"""The pipeline's stages against brute force over the smallest tables."""

import corpus_pipeline
import numpy as np
from tests.llm.test_operators import classes, fingerprint

from seqlens.llm import decontaminate, queries

SF = "/root/testdata/sf0.001"


def test_stages(spark, small, tokenizer, tmp_path):
    from tokenizers import Tokenizer

    documents = small("documents")
    docs = documents
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.schema.simpleString() == documents.schema.simpleString()
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs
    rows = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert {r["doc_id"] for r in kept["language_id"].collect()} == {d for d, t in rows.items() if any(map(str.isalpha, t))}
    ids = sorted(r["doc_id"] for r in kept["language_id"].collect())
    roots = classes([fingerprint(rows[d]) for d in ids], lambda a, b: (a ^ b).bit_count() <= 3)
    unique = {ids[r] for r in roots}
    assert {r["doc_id"] for r in kept["near_duplicates"].collect()} == unique
    bad = {r["doc_id"] for r in decontaminate.contamination(documents, small("benchmark")).where("contaminated").collect()}
    assert bad and {r["doc_id"] for r in kept["decontamination"].collect()} == unique - bad
    private = {r["doc_id"]: r for r in kept["pii"].collect()}
    assert private.keys() == unique - bad and all(len(r["text"]) == r["n_chars"] for r in private.values())
    changed = [d for d, r in private.items() if r["text"] != rows[d]]
    assert changed and all("@" in rows[d] or any(map(str.isdigit, rows[d])) for d in changed)
    encode = Tokenizer.from_file(tokenizer).encode
    pieces = {}
    for r in kept["packing"].collect():
        pieces.setdefault(r["doc_id"], []).append((r["start"], np.frombuffer(r["token_ids"], "<u4").tolist()))
    for d, r in private.items():
        assert sum((ids for _, ids in sorted(pieces[d])), []) == [*encode(r["text"], add_special_tokens=False).ids, 2]


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert "op6_packing" in queries.queries()


def test_repeated_and_null_rows(spark):
    rows = [(1, "one text of a few words", "en", "s", 9), (1, "one text of a few words", "en", "s", 9), (2, "one text of a few words", "en", "s", 9), (None, "another text", "en", "s", 9), (3, None, "en", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'x' AS component_id", "'y' AS n_entities", "1 AS count")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    assert sorted((r["doc_id"] or 0) for r in docs.collect()) == [0, 1]
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs.limit(0), SF).collect()


def test_rows_decide_not_ids(spark):
    """Documents under shared ids, or without one, by brute force over rows."""
    import random

    r = random.Random(8)
    words = lambda n: " ".join(r.choice("the and of to in a is that it was for on are with".split()) for _ in range(n))
    item = " ".join(f"bench{i} mark" for i in range(10))
    texts = [words(40) for _ in range(12)] + [f"{item} and more of it", None]
    rows = [(r.choice([None, *range(10)]), r.choice(texts), "en", f"s{i}", 1) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    once = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
    fps = [fingerprint(t) for _, t, *_ in rows]
    roots = classes(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    groups = {}
    for root, row in zip(roots, rows, strict=True):
        groups.setdefault(root, []).append(row)
    assert len(once) == len(groups)
    for own in groups.values():
        ids = [x[0] for x in own if x[0] is not None]
        here = [x for x in once if tuple(x) in own]
        assert len(here) == 1 and here[0]["doc_id"] == (min(ids) if ids else None)
    items = spark.createDataFrame([("a", item)], "item_id string, text string")
    clean = sorted(tuple(x)[3] for x in decontaminate.clean(docs, items).collect())
    assert clean == sorted(x[3] for x in rows if not (x[1] or "").startswith("bench"))
