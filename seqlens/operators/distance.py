"""Pair distances: of aligned sequences and of k-mer sets, both by tiles; and what is derived from a distance table.

A distance table has id_a, id_b, d with id_a < id_b."""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlens.functions import fixed, kmers
from seqlens.operators.components import checkpointed
from seqlens.operators.layout import spread

TILE = 512
#: k-mers of a tile that are counted at once.
COLUMNS = 4096
CODE = np.zeros(256, np.uint8)
for _i, _letters in enumerate((b"Aa", b"Cc", b"Gg", b"TtUu"), 1):
    for _b in _letters:
        CODE[_b] = _i


def encode(seqs: list[str]) -> np.ndarray:
    """Codes 1 to 4, 0 for gaps and all else, padded on the right."""
    width = max(map(len, seqs), default=0)
    out = np.zeros((len(seqs), width), np.uint8)
    for row, s in zip(out, seqs, strict=True):
        row[: len(s)] = CODE[np.frombuffer(s.encode("ascii", "replace"), np.uint8)]
    return out


def tile(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places that both have, and places that differ, of all pairs of two tiles: products of indicator matrices."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    both = (a > 0).astype(np.float32) @ (b > 0).astype(np.float32).T
    same = sum((a == c).astype(np.float32) @ (b == c).astype(np.float32).T for c in range(1, 5))
    return both.round().astype(np.int64), (both - same).round().astype(np.int64)


def in_tiles(rows: DataFrame, columns: list[str], tile_rows: int, within: str | None = None) -> DataFrame:
    """rows (id and columns) with block, i, j: rows are dealt to blocks of about tile_rows by a hash of the id; each pair of blocks i <= j is a
    tile, and a block's rows go to all tiles that it is part of. within: a column whose values each have blocks of their own."""
    if within:
        sizes = rows.groupBy(within).agg(F.ceil(F.count(F.lit(1)) / tile_rows).cast("int").alias("_blocks"))
        rows, blocks = rows.join(sizes, within), F.col("_blocks")
    else:
        blocks = F.lit(max(1, -(-rows.count() // tile_rows)))
    own = rows.select("id", *columns, F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"), blocks.alias("_blocks"))
    part = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    return own.select("id", *columns, "block", F.explode(part).alias("t")).select("id", *columns, "block", "t.i", "t.j")


def pairs_of(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> tuple[np.ndarray, ...]:
    """Places in left and right, lower and higher id of the pairs of a tile."""
    a, b = left["id"].to_numpy(), right["id"].to_numpy()
    x, y = np.nonzero(a[:, None] < b[None, :] if same else a[:, None] != b[None, :])
    return x, y, np.where(a[x] < b[y], a[x], b[y]), np.where(a[x] < b[y], b[y], a[x])


def aligned_pairs(rows: DataFrame, id_type: str = "long", tile_rows: int = TILE) -> DataFrame:
    """id_a, id_b, comparable, differing, p of all pairs of aligned sequences (id, seq); p is 1 where nothing is comparable."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        i, j = key
        left, right = frame[frame["block"] == i], frame[frame["block"] == j]
        both, differing = tile(encode(left["seq"].tolist()), encode(right["seq"].tolist()))
        x, y, low, high = pairs_of(left, right, i == j)
        return pd.DataFrame({"id_a": low, "id_b": high, "comparable": both[x, y], "differing": differing[x, y]})

    pairs = in_tiles(rows, ["seq"], tile_rows).groupBy("i", "j").applyInPandas(run, f"id_a {id_type}, id_b {id_type}, comparable long, differing long")
    return pairs.withColumn("p", F.when(F.col("comparable") == 0, 1.0).otherwise(F.col("differing") / F.col("comparable")))


def aligned_tiles(rows: DataFrame, tile_rows: int, schema: str, fold: Callable[..., pd.DataFrame]) -> DataFrame:
    """fold(left, right, x, y, comparable, differing) of every tile of aligned sequences (id, seq, label): x and y are the places in left and right of its
    pairs, the lower id first, comparable and differing their numbers. Rows without a label take no part."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        i, j = key
        left, right = frame[frame["block"] == i], frame[frame["block"] == j]
        both, differing = tile(encode(left["seq"].tolist()), encode(right["seq"].tolist()))
        x, y, _, _ = pairs_of(left, right, i == j)
        return fold(left, right, x, y, both[x, y], differing[x, y])

    return in_tiles(rows.where("label IS NOT NULL"), ["seq", "label"], tile_rows).groupBy("i", "j").applyInPandas(run, schema)


def pair_classes(rows: DataFrame, tile_rows: int = TILE) -> DataFrame:
    """label_a, label_b, comparable, differing, p, n: how many pairs of aligned sequences (id, seq, label) have these labels (in the order of the ids) and numbers of places.

    Pairs are counted inside their tile. A p-distance is a fraction of small numbers, so what leaves a tile is a row for each fraction and pair of labels, and not
    one for each pair."""

    def fold(left: pd.DataFrame, right: pd.DataFrame, x: np.ndarray, y: np.ndarray, comparable: np.ndarray, differing: np.ndarray) -> pd.DataFrame:
        names, codes = np.unique(np.concatenate([left["label"], right["label"]]).astype(str), return_inverse=True)
        a, b = codes[: len(left)][x], codes[len(left) :][y]
        turned = left["id"].to_numpy()[x] > right["id"].to_numpy()[y]
        a, b = np.where(turned, b, a), np.where(turned, a, b)
        (a, b, comparable, differing), n = np.unique(np.stack([a, b, comparable, differing]), axis=1, return_counts=True)
        return pd.DataFrame({"label_a": names[a], "label_b": names[b], "comparable": comparable, "differing": differing, "n": n})

    counted = aligned_tiles(rows, tile_rows, "label_a string, label_b string, comparable long, differing long, n long", fold)
    summed = counted.groupBy("label_a", "label_b", "comparable", "differing").agg(F.sum("n").alias("n"))
    return summed.withColumn("p", F.when(F.col("comparable") == 0, 1.0).otherwise(F.col("differing") / F.col("comparable")))


def medoids_of(rows: DataFrame, correct: bool = False, tile_rows: int = TILE) -> DataFrame:
    """medoids() of aligned sequences (id, seq, label): a tile sums up each row's distances to rows of its own label, so no row for a pair leaves it.

    Sums are compared to nine places, as they depend on the order of summing beyond."""
    kind = rows.schema["id"].dataType.simpleString()

    def fold(left: pd.DataFrame, right: pd.DataFrame, x: np.ndarray, y: np.ndarray, comparable: np.ndarray, differing: np.ndarray) -> pd.DataFrame:
        own = left["label"].to_numpy()[x] == right["label"].to_numpy()[y]
        x, y, comparable, differing = x[own], y[own], comparable[own], differing[own]
        d = np.where(comparable == 0, 1.0, differing / np.maximum(comparable, 1))
        d = -0.75 * np.log(1.0 - 4.0 / 3.0 * np.clip(d, 0.0, 0.7499)) if correct else d
        sides = [(side, np.bincount(at, d, minlength=len(side)), np.bincount(at, minlength=len(side))) for side, at in ((left, x), (right, y))]
        return pd.concat([pd.DataFrame({"id": side["id"], "label": side["label"], "sum_d": total})[n > 0] for side, total, n in sides])

    sums = aligned_tiles(rows, tile_rows, f"id {kind}, label string, sum_d double", fold).groupBy("label", "id").agg(F.sum("sum_d").alias("sum_d"))
    nearest = F.struct(F.floor(F.col("sum_d") * 1_000_000_000 + 0.5), F.col("id"))
    return sums.groupBy("label").agg(F.min_by("id", nearest).alias("medoid"), F.min("sum_d").alias("sum_d"))


def corrected(pairs: DataFrame, p: str = "p") -> DataFrame:
    """With d, the distance corrected for repeated changes."""
    return pairs.withColumn("d", kmers.jukes_cantor(F.col(p)))


def shared_kmers(left: list[set[str]], right: list[set[str]]) -> np.ndarray:
    """How many k-mers each two sets share: products of indicator matrices, COLUMNS k-mers at a time."""
    common = set().union(*left) & set().union(*right)
    number = {m: n for n, m in enumerate(common)}
    shared = np.zeros((len(left), len(right)), np.float32)
    ends = np.arange(0, len(number) + COLUMNS, COLUMNS)
    sides = []
    for sets in (left, right):
        at = [np.fromiter((n for m in own if (n := number.get(m)) is not None), np.int64) for own in sets]
        row, column = np.repeat(np.arange(len(sets)), [len(x) for x in at]), np.concatenate([*at, np.zeros(0, np.int64)])
        order = np.argsort(column, kind="stable")
        sides.append((len(sets), row[order], column[order], np.searchsorted(column[order], ends)))
    for c in range(len(ends) - 1):
        chunk = []
        for n, row, column, start in sides:
            own = slice(start[c], start[c + 1])
            chunk.append(np.zeros((n, COLUMNS), np.float32))
            chunk[-1][row[own], column[own] - ends[c]] = 1.0
        shared += chunk[0] @ chunk[1].T
    return shared.round().astype(np.int64)


def kmer_pairs(rows: DataFrame, k: int = fixed.MATRIX_KMER, tile_rows: int = TILE, within: str | None = None) -> DataFrame:
    """id_a, id_b, shared, d of the pairs of (id, seq) that share a k-mer; all others are at distance 1. within: only pairs of rows that
    have the same value of this column, and the column before theirs.

    Counted tile by tile, so that a k-mer which all sequences have costs no more than another."""
    group = [within] if within else []
    source = spread(rows.select("id", "seq", *group)).select("id", *group, F.coalesce(F.translate(F.upper("seq"), "-N", ""), F.lit("")).alias("seq"))
    kind = lambda c: rows.schema[c].dataType.simpleString()

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        i, j = key[-2:]
        left, right = frame[frame["block"] == i], frame[frame["block"] == j]
        sets = [[{t[n : n + k] for n in range(len(t) - k + 1)} for t in side["seq"]] for side in (left, right)]
        shared = shared_kmers(*sets)
        x, y, low, high = pairs_of(left, right, i == j)
        some = shared[x, y] > 0
        x, y, low, high = x[some], y[some], low[some], high[some]
        na, nb = (np.fromiter(map(len, side), np.int64, len(side)) for side in sets)
        union = na[x] + nb[y] - shared[x, y]
        return pd.DataFrame({g: [v] * len(low) for g, v in zip(group, key, strict=False)} | {"id_a": low, "id_b": high, "shared": shared[x, y], "d": 1.0 - shared[x, y] / union})

    schema = ", ".join([*[f"{g} {kind(g)}" for g in group], f"id_a {kind('id')}, id_b {kind('id')}, shared long, d double"])
    return in_tiles(source, [*group, "seq"], tile_rows, within).groupBy(*group, "i", "j").applyInPandas(run, schema)


def distance_table(rows: DataFrame, aligned: bool, correct: bool = False, id_type: str = "long") -> DataFrame:
    """id_a, id_b, d of (id, seq): of aligned sequences, corrected if asked for, or of 6-mer sets, where pairs that are absent are at
    distance 1 and no correction applies."""
    if not aligned:
        return kmer_pairs(rows).select("id_a", "id_b", "d")
    pairs = aligned_pairs(rows, id_type)
    return (corrected(pairs) if correct else pairs.withColumn("d", F.col("p"))).select("id_a", "id_b", "d")


def both_ways(pairs: DataFrame) -> DataFrame:
    """id, other, d."""
    return pairs.select(F.col("id_a").alias("id"), F.col("id_b").alias("other"), "d").unionByName(pairs.select(F.col("id_b").alias("id"), F.col("id_a").alias("other"), "d"))


def labelled(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """pairs with label_a, label_b and same. labels has id, label."""
    a, b = (labels.select(F.col("id").alias(f"id_{x}"), F.col("label").alias(f"label_{x}")) for x in "ab")
    return pairs.join(a, "id_a").join(b, "id_b").withColumn("same", F.col("label_a") == F.col("label_b"))


def medoids(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """label, medoid, sum_d: of each label the member nearest to all its others; ties go to the lower id."""
    return medoids_within(labelled(pairs, labels).where("same"))


def medoids_within(inner: DataFrame) -> DataFrame:
    """medoids() of pairs (label_a, id_a, id_b, d) of members of one label each."""
    ends = F.explode(F.array("id_a", "id_b")).alias("id")
    sums = inner.select(F.col("label_a").alias("label"), ends, "d").groupBy("label", "id").agg(F.sum("d").alias("sum_d"))
    return sums.groupBy("label").agg(F.min_by("id", F.struct(F.col("sum_d"), F.col("id"))).alias("medoid"), F.min("sum_d").alias("sum_d"))


def permuted(pairs: DataFrame, axis: DataFrame) -> DataFrame:
    """i, j, d: the matrix with rows and columns in the order of axis (id, place)."""
    a, b = (axis.select(F.col("id").alias(f"id_{x}"), F.col("place").alias(p)) for x, p in (("a", "pa"), ("b", "pb")))
    return pairs.join(a, "id_a").join(b, "id_b").select(F.least("pa", "pb").alias("i"), F.greatest("pa", "pb").alias("j"), "d")


def pyramid(cells: DataFrame, levels: int) -> DataFrame:
    """level, i, j, n, mean, most of a matrix's cells (i, j, d; i <= j, from 1) at several resolutions: at level 0 a block is a cell, at each further level two by two blocks
    of the one before, down to one block if there are levels enough.

    A level is made from the one before, whose blocks are a quarter as many, so a matrix of any size is summed up for the cost of its cells, and what is shown of it
    is bounded by its level. Absent cells count for nothing."""
    at = cells.groupBy("i", "j").agg(F.sum("d").alias("total"), F.count("d").alias("n"), F.max("d").alias("most"))
    made = []
    for level in range(levels):
        if level:
            half = lambda c: (F.floor((F.col(c) - 1) / 2) + 1).alias(c)
            at = at.groupBy(half("i"), half("j")).agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.max("most").alias("most"))
        at = checkpointed(at)
        made.append(at.select(F.lit(level).alias("level"), "i", "j", "n", (F.col("total") / F.col("n")).alias("mean"), "most"))
    return functools.reduce(DataFrame.unionByName, made)


def matrix_rows(pairs: DataFrame, ids: list) -> DataFrame:
    """The matrix as wide rows, for export of a known, small list of ids."""
    full = both_ways(pairs)
    return full.groupBy("id").pivot("other", ids).agg(F.first("d")).na.fill(0.0)


