"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlens.llm import queries, spelling

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string"


def words_of(rows):
    found = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            found[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    n = words_of(rows)
    facts = {}
    for w in n:
        own = [x for x in n if abs(len(x) - len(w)) < 2 and near(w, x)]
        best = min(own, key=lambda x: (-n[x], x), default=None)
        facts[w] = (best if best and n[best] >= 2 * n[w] else None, len(own))
    out = []
    for w, (form, count) in facts.items():
        root = w
        while facts[root][0]:
            root = facts[root][0]
        out.append((w, form, root, n[w], count, n[form] if form else None))
    return sorted(out)


def found_by(df, **sizes):
    return sorted(tuple(r) for r in spelling.variants(df, **sizes).collect())


def made_up(seed, letters, size):
    """Words with many neighbours of all three kinds, at the ends and in runs of one letter too."""
    draw = random.Random(seed)
    base = ["".join(draw.choice(letters) for _ in range(draw.randint(4, 9))) for _ in range(size)]
    for _ in range(size):
        w, i = draw.choice(base), draw.randint(0, 9)
        base.append(draw.choice([w[:i] + draw.choice(letters) + w[i:], w[:i] + w[i + 1 :], w[:i] + draw.choice(letters) + w[i + 1 :], w + w[-1:], w[:1] + w]))
    return [(draw.choice([1, 2, 3, None, 77]), " ".join(draw.choices(base, weights=[1 / (i + 1) for i in range(len(base))], k=400))) for _ in range(20)]


@pytest.mark.parametrize("letters", ["ab", "aeÀÿzB", "abcdefghijklmnopqrstuvwxyzßàéñ"])
def test_all_pairs(spark, letters):
    rows = made_up(len(letters), letters, 60)
    docs = spark.createDataFrame(rows, SCHEMA)
    assert found_by(docs) == brute(rows) != []


def test_many_tries_and_groups(spark):
    rows = made_up(5, "abcé", 80)
    docs = spark.createDataFrame(rows, SCHEMA)
    assert found_by(docs, trie_words=7, group_bytes=1500, block_words=5) == found_by(docs, trie_bytes=40) == brute(rows)


def test_trie_spells_its_words():
    words = sorted({"".join(random.Random(i).choices("abyzàÿ", k=random.Random(-i).randint(1, 7))) for i in range(300)})
    trie = spelling.Trie.unpack(spelling.Trie.of([w.encode("latin-1") for w in words], np.arange(len(words))).pack())
    at = np.flatnonzero(trie.ends)
    assert sorted(trie.spelt(v) for v in at) == words
    assert all(words[trie.rank[trie.word_at[v]]] == trie.spelt(v) and trie.n[trie.word_at[v]] == trie.rank[trie.word_at[v]] for v in at)


def test_edges(spark):
    long = "wordy" * 4000
    rows = [(1, None), (2, ""), (3, "12 34 x yz"), (None, "Letters letters LETTERS lettres"), (4, "letterz letterz letterz"), (4, "letterz letterz letterz"), (5, f"{long} {long} {long} {long} {long[:-1]} {long[:-1]} {long[:-1]} a{long}"), (6, "straße STRASSE strasse StraSSe ÀÉÀÉÀÉ ÀÉÀÉÀÉ ÀÉÀÉÀÉ àéàéàé")]
    docs = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("x").alias(c) for c in ("word", "n", "root", "key", "h", "run")])
    found = found_by(docs)
    assert found == brute(rows)
    assert {r[0] for r in found} >= {"letterz", long, "ÀÉÀÉÀÉ"}
    assert found_by(docs.limit(0)) == found_by(docs.where("doc_id < 4")) == []


def test_chain_of_forms(spark):
    rows = [(1000 + i, f"{w} " * n) for i, (w, n) in enumerate([("aaaaaa", 3), ("aaaaab", 8), ("aaaabb", 20), ("aaabbb", 50), ("aabbbb", 120), ("zzzzzz", 9), ("yzzzzz", 5)])]
    found = {r[0]: r for r in found_by(spark.createDataFrame(rows, SCHEMA))}
    assert sorted(found.values()) == brute(rows)
    assert found["aaaaaa"][1:3] == ("aaaaab", "aabbbb") and found["yzzzzz"][1:3] == (None, "yzzzzz")


def test_query_by_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(spelling.ORACLE_SQL)
    columns = [c[0] for c in want.description]
    found = queries.op11_spelling_variants(spark, SF)
    assert found.columns == columns and sorted(tuple(r) for r in found.collect()) == sorted(want.fetchall())
