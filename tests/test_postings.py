"""Nearest sets by lists of k-mers, against all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from seqlens.operators import nearest as kernel
from seqlens.operators import postings

NAMES = ["BUILDING", "AUTOMOBILE", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def all_pairs(asked, ids, texts, k, top):
    d, ref = kernel.best_of(kernel.Index([(a, "") for a in asked], k, False), ids, pa.array(texts), top)
    return {(q, int(ref[i, q]), float(d[i, q])) for q in range(len(asked)) for i in range(len(d))}


def by_lists(asked, ids, texts, k, top):
    found = list(zip(*(x.tolist() for x in postings.nearest(asked, ids, texts, k, top)), strict=True))
    assert len(set(found)) == len(found)
    return set(found)


def record(r, most):
    return f"CUSTOMER#{r.randrange(most):09d}-{r.choice(NAMES)}"


@pytest.mark.parametrize("first,pairs,batch", [(16, 1 << 20, 4096), (1, 7, 9)])
@pytest.mark.parametrize("letters,longest,k", [("ACGT", 200, 4), ("ACGT", 60, 8), ("ab", 9, 3), ("ACGT", 300, 2), ("абвгACGT中😀", 80, 4), ("".join(map(chr, range(0x100, 0x500))), 80, 8), ("", 0, 8)])
def test_equal_to_all_pairs(monkeypatch, letters, longest, k, first, pairs, batch):
    """Ties by id, copies, empty sets, sets that share nothing, fewer refs than asked for."""
    monkeypatch.setattr(postings, "FIRST", first)
    monkeypatch.setattr(postings, "PAIRS", pairs)
    monkeypatch.setattr(postings, "BATCH", batch)
    r = random.Random(len(letters) + k + first)
    make = lambda: "".join(r.choice(letters) for _ in range(r.randint(0, longest))) if letters else record(r, 3000)
    for n_asked, n in ((60, 400), (30, 3), (5, 1)):
        texts = [make() for _ in range(n)]
        asked = [*(make() for _ in range(n_asked)), *(t[: len(t) // 2] + t[len(t) // 2 + 1 :] for t in texts[:20]), ""]
        texts += texts[:9]
        ids = r.sample(range(10 * len(texts)), len(texts))
        ids = [f"r{i}" for i in ids] if n == 3 else ids
        assert by_lists(asked, ids, texts, k, 5) == all_pairs(asked, ids, texts, k, 5)


def test_long_lists_are_counted(monkeypatch):
    """Where each list has most sets, queries count all at once."""
    counted = []
    whole = postings.Search.count_all
    monkeypatch.setattr(postings.Search, "count_all", lambda self, q: (counted.append(q), whole(self, q)))
    r = random.Random(3)
    texts, asked = (["".join(r.choice("ACGT") for _ in range(200)) for _ in range(n)] for n in (300, 40))
    assert by_lists(asked, list(range(300)), texts, 3, 5) == all_pairs(asked, list(range(300)), texts, 3, 5)
    assert len(counted) > 4 and len(set(counted)) == len(counted)


def test_records_that_all_differ_are_not_met_by_all_queries(monkeypatch):
    """k-mers that all have are not followed: of ten times as many records a query looks at few more."""
    counted = []
    take = postings.Search.take
    monkeypatch.setattr(postings.Search, "take", lambda self, q, r: (counted.append(len(q)), take(self, q, r)))
    r, looked = random.Random(5), []
    for n in (4000, 40000):
        texts, asked = ([record(r, 10 * n) for _ in range(m)] for m in (n, 500))
        counted.clear()
        query, _, d = postings.nearest(asked, list(range(n)), texts, 8, 5)
        assert np.bincount(query).tolist() == [5] * 500 and d.max() < 0.9
        looked.append(sum(counted) / 500)
    assert looked[1] < 3 * looked[0] < 3 * 400


def test_texts_that_all_differ_are_few_tiles(spark):
    """Queries and refs beyond the bounds of one pass: refs are sent to a few blocks, not to one for each 4,096 queries and 2,048 refs."""
    from pyspark.sql import functions as F

    rows = lambda n, seed: spark.range(n).select("id", F.format_string("CUSTOMER#%09d-HOUSEHOLD", F.col("id") * 7 + seed).alias("seq"))
    plan = kernel.nearest_in_blocks(rows(20_000, 3), rows(10_000, 0), 8, False, 5)
    found = plan.groupBy("query_id").count()
    assert found.agg(F.min("count"), F.max("count"), F.count("*")).first() == (5, 5, 20_000)  # one lane
