"""Nearest references of a bounded set of queries: one pass over the references with the queries' k-mer index in hand.

A task holds the index (k-mer to the queries that have it) and the counts of a few references at a time, and emits for each query its nearest of those;
so what is shuffled is five rows a query and batch, where the join of both k-mer tables shuffles every pair that shares one.
Query sets within MAX_QUERIES and MAX_BYTES are sent to where the references lie; larger ones go in blocks of that size, each of which meets the references in lanes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlens.functions import kmers
from seqlens.operators import postings
from seqlens.operators.layout import spread
from seqlens.session import importable

MAX_QUERIES = 4096
MAX_BYTES = 8 << 20
#: References of a lane, where query sets are larger.
LANE_ROWS = 2048
LANE_BYTES = 16 << 20
#: Queries of a block and bytes of a lane, where lists of refs are searched; and how many tiles a core has, if blocks need not be small for it.
SEARCHED_ROWS, SEARCHED_BYTES, TILES = 1 << 17, 8 << 20, 3
#: Cells of a table of counts (references by queries).
CELLS = 1 << 20

_base = np.zeros(256, bool)
_base[list(b"ACGT")] = True
#: Set in the numbers of k-mers with letters beyond ASCII; those of eight ASCII letters never reach it.
BEYOND = 1 << 63


def windows_of(letters: np.ndarray, k: int) -> np.ndarray:
    """k letters in a row as a number, k of 8 at most."""
    n = len(letters) - k + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(k if n > 0 else 0):
        out = out << np.uint64(8) | letters[i : i + n]
    return out


def strict_kmers(text: str, k: int) -> np.ndarray:
    """Distinct k-mers of A, C, G and T only."""
    letters = np.frombuffer(text.encode("ascii", "replace"), np.uint8)
    if len(letters) < k:
        return np.zeros(0, np.uint64)
    return np.unique(windows_of(letters, k)[np.convolve(_base[letters], np.ones(k, np.int64), "valid") == k])


#: Up to so many k-mers a sort is faster than a look through a table of all.
SORTED = 8192
#: Of a byte: 0 to 3 for A, C, G and T, 4 for all else; and the same for either case.
_digit = bytes(max(b"ACGT".find(i), 0) if i in b"ACGT" else 4 for i in range(256))
_digit_any_case = bytes(_digit[ord(chr(i).upper())] if i < 128 else 4 for i in range(256))


def strict_codes(text: str, k: int, any_case: bool = False) -> np.ndarray:
    """The same k-mers as numbers of two bits a letter, k of 8 at most, in order; with any_case those of the text in upper case. Numbers of 1, 2, 4 and 8 letters are made each
    of two of the ones before; those of long texts are marked in a table of all, which is faster than to sort them."""
    raw = (text.upper() if any_case and not text.isascii() else text).encode("ascii", "replace")
    letters = np.frombuffer(raw.translate(_digit_any_case if any_case else _digit), np.uint8).astype(np.uint16)
    n = len(letters) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    valid = np.convolve(letters < 4, np.ones(k, np.int64), "valid") == k if letters.max() == 4 else None
    code, have, part, size = np.zeros(len(letters), np.uint16), 0, letters & np.uint16(3), 1
    while have < k:
        if k & size:
            code = part if not have else code[: len(part) - have] << np.uint16(2 * size) | part[have:]
            have += size
        if have < k:
            part, size = part[:-size] << np.uint16(2 * size) | part[size:], 2 * size
    code = code[:n] if valid is None else code[:n][valid]
    if len(code) < SORTED:
        code = np.sort(code, kind="stable")  # of 16 bits: by digits
        return code[np.append(True, code[1:] != code[:-1])[: len(code)]].astype(np.int64)
    held = np.zeros(4**k, bool)
    held[code] = True
    return np.flatnonzero(held)


def all_kmers(text: str, k: int) -> tuple[np.ndarray, set[str]]:
    """Distinct k-mers: those of ASCII letters as numbers, others as they are."""
    if text.isascii():
        return np.unique(windows_of(np.frombuffer(text.encode(), np.uint8), k)), set()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if len(points) < k:
        return np.zeros(0, np.uint64), set()
    plain = np.convolve(points < 128, np.ones(k, np.int64), "valid") == k
    return np.unique(windows_of(points.astype(np.uint8), k)[plain]), {text[i : i + k] for i in np.flatnonzero(~plain).tolist()}


def prepared(rows: DataFrame, contained: bool, keep: bool = False) -> DataFrame:
    """id, seq and (queries that may be contained) rev: letters as the k-mer functions see them (those that are contained or contain are put in upper case by the index)."""
    forward = F.col("seq") if contained else F.translate(F.upper("seq"), "-N", "")
    rev = F.upper(kmers.reverse_complement(F.col("seq"))) if contained and keep else F.lit(None).cast("string")
    return rows.select("id", F.coalesce(forward, F.lit("")).alias("seq"), F.coalesce(rev, F.lit("")).alias("rev"))


class Index:
    """K-mer to the columns of queries that have it; with both_strands a query has two columns."""

    def __init__(self, rows: list[tuple[str, str]], k: int, contained: bool):
        self.k, self.contained, self.n = k, contained, len(rows)
        self.beyond: dict[str, int] = {}
        own = [self.keys_of(seq, True)[0] for seq, _ in rows]
        self.sizes = np.array([len(x) for x in own], np.int64)
        if contained:
            own += [strict_codes(rev, k) for _, rev in rows]
        key = np.concatenate(own) if own else np.zeros(0, np.uint64)
        column = np.repeat(np.arange(len(own)), [len(x) for x in own])
        order = np.argsort(key, kind="stable")
        self.keys, self.start = np.unique(key[order], return_index=True)
        self.stop = np.append(self.start[1:], len(key))
        self.columns, self.width = column[order], len(own)
        if contained:  # where the columns of each number begin
            self.begin = np.searchsorted(key[order], np.arange(4**k + 1))

    def keys_of(self, seq: str, new: bool = False) -> tuple[np.ndarray, int]:
        """The distinct k-mers of a text that a query may have, and the number of all. new: those beyond ASCII get numbers."""
        if self.contained:
            keys = strict_codes(seq, self.k, True)
            return keys, len(keys)
        keys, others = all_kmers(seq, self.k)
        if not others:
            return keys, len(keys)
        numbers = [self.beyond.setdefault(x, len(self.beyond)) for x in others] if new else [n for x in others if (n := self.beyond.get(x)) is not None]
        return np.concatenate([keys, np.array(numbers, np.uint64) | np.uint64(BEYOND)]), len(keys) + len(others)

    def shared(self, own: np.ndarray) -> np.ndarray:
        """How many of the distinct k-mers of a reference each column has."""
        if self.contained:
            start = self.begin[own]
            size = self.begin[own + 1] - start
        else:
            at = np.minimum(np.searchsorted(self.keys, own), max(len(self.keys) - 1, 0))
            at = at[self.keys[at] == own] if len(self.keys) else at[:0]
            start, size = self.start[at], self.stop[at] - self.start[at]
        flat = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else start, size) + np.arange(size.sum())
        return np.bincount(self.columns[flat], minlength=self.width)

    def contained_in(self, seq: str) -> np.ndarray:
        """How many of each query's k-mers a reference has, by the strand of which it has more."""
        shared = self.shared(self.keys_of(seq)[0])
        return np.maximum(shared[: self.n], shared[self.n :])

    def distances(self, seq: str) -> np.ndarray:
        """Of a reference from each query."""
        if self.contained:
            return 1.0 - self.contained_in(seq) / np.maximum(self.sizes, 1)
        own, size_of_ref = self.keys_of(seq)
        shared = self.shared(own)
        union = self.sizes + size_of_ref - shared
        return np.where((self.sizes == 0) | (size_of_ref == 0), 1.0, 1.0 - shared / np.maximum(union, 1))


def bounded(queries: DataFrame, contained: bool) -> list | None:
    """The prepared rows of a query set within the bounds, else None."""
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("seq")).alias("b")).first()
    return prepared(queries, contained, keep=True).collect() if size["n"] <= MAX_QUERIES and (size["b"] or 0) <= MAX_BYTES else None


def best_of(index: Index, ids: list, texts: pa.Array | pa.ChunkedArray, top: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Distances and places of the `top` nearest of these references for every query (a row for each rank), by distance, then id; None without references."""
    step = max(top, min(256, CELLS // max(1, index.n)))
    order = sorted((i for i, x in enumerate(ids) if x is not None), key=ids.__getitem__)
    best: tuple | None = None
    for s in range(0, len(order), step):
        own = order[s : s + step]
        d = np.stack([index.distances(texts[i].as_py()) for i in own])
        ref = np.broadcast_to(np.array(own)[:, None], d.shape)
        if best is not None:  # earlier ids come first, so a stable sort keeps them on ties
            nearer = (d < best[0][-1]).any(axis=1) if len(best[0]) == top else np.ones(len(d), bool)
            d, ref = np.vstack([best[0], d[nearer]]), np.vstack([best[1], ref[nearer]])
        chosen = np.argsort(d, axis=0, kind="stable")[:top]
        best = np.take_along_axis(d, chosen, 0), np.take_along_axis(ref, chosen, 0)
    return best if index.n else None


def nearest(rows: list, refs: DataFrame, k: int, contained: bool, top: int) -> DataFrame:
    """query, ref_id, d: of each query (its place in rows) the `top` nearest refs of every batch, by distance, then id."""
    if k > 8:
        raise ValueError("k-mers of eight letters at most")
    shared = refs.sparkSession.sparkContext.broadcast([(r["seq"], r["rev"]) for r in rows])  # within twice MAX_BYTES
    importable(refs.sparkSession)
    source = prepared(spread(refs.select("id", "seq")), contained).select("id", "seq")
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value, k, contained)
        for batch in batches:
            found = best_of(index, batch.column(0).to_pylist(), batch.column(1), top)
            if found is not None:
                d, ref = found
                query = np.tile(np.arange(index.n), len(d))
                yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), batch.column(0).take(pa.array(ref.ravel())), pa.array(d.ravel())], ["query", "ref_id", "d"])

    return source.mapInArrow(run, f"query long, ref_id {kind}, d double")


def within(rows: list, refs: DataFrame, k: int, share: float) -> DataFrame:
    """query (its place in rows), ref_id, nq, shared of the pairs where a reference has such a share of a query's k-mers, by either strand. nq is 1 at least. What shares
    less leaves no task."""
    if k > 8:
        raise ValueError("k-mers of eight letters at most")
    shared = refs.sparkSession.sparkContext.broadcast([(r["seq"], r["rev"]) for r in rows])  # within twice MAX_BYTES
    importable(refs.sparkSession)
    source = prepared(spread(refs.select("id", "seq")), True).where("id IS NOT NULL").select("id", "seq")
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value, k, True)
        nq = np.maximum(index.sizes, 1)
        for batch in batches:
            query, ref, count = [], [], []
            for i, text in enumerate(batch.column(1)):
                own = index.contained_in(text.as_py())
                at = np.flatnonzero((own >= share * nq) & (own > 0))
                query.append(at)
                ref.append(np.full(len(at), i))
                count.append(own[at])
            query, ref, count = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (query, ref, count))
            yield pa.RecordBatch.from_arrays([pa.array(query), batch.column(0).take(pa.array(ref)), pa.array(nq[query]), pa.array(count)], ["query", "ref_id", "nq", "shared"])

    return source.mapInArrow(run, f"query long, ref_id {kind}, nq long, shared long")


def parts_of(rows: DataFrame, most_rows: int, most_bytes: int) -> int:
    """Into how many parts rows (seq) go, so that one has so many rows and bytes on average."""
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("seq").cast("long")), F.lit(0)).alias("b")).first()
    return max(1, -(-size["n"] // most_rows), -(-size["b"] // most_bytes))


def nearest_in_blocks(queries: DataFrame, refs: DataFrame, k: int, contained: bool, top: int, block_rows: int | None = None, lane_rows: int | None = None) -> DataFrame:
    """query_id, ref_id, d of the `top` nearest refs of each query in every lane, for query sets of any size.

    Queries are dealt to blocks and refs to lanes by a hash of their ids; every block meets every lane, by an equi-join of both numbers, and builds its index there. So no
    k-mer is a key: one that all have costs a task no more than its refs' other k-mers, and what is shuffled is a copy of the refs a block and of the queries a lane.
    Contained queries are counted against each ref; by Jaccard distance only refs that may come among the nearest are (postings.py), so blocks and lanes are larger."""
    if k > 8:
        raise ValueError("k-mers of eight letters at most")
    importable(refs.sparkSession)
    most = (MAX_QUERIES, LANE_ROWS, LANE_BYTES) if contained else (SEARCHED_ROWS, SEARCHED_ROWS * 4, SEARCHED_BYTES)
    lanes = parts_of(refs, lane_rows or most[1], most[2])
    blocks = parts_of(queries, block_rows or most[0], MAX_BYTES)
    if not contained and not block_rows:  # smaller ones where all cores would not have some
        cores = refs.sparkSession.sparkContext.defaultParallelism
        blocks = max(blocks, min(-(-TILES * cores // lanes), parts_of(queries, MAX_QUERIES, MAX_BYTES)))
    number = lambda n, name: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias(name)
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    tasks = min(2 * blocks * lanes, 32 * refs.sparkSession.sparkContext.defaultParallelism)
    dealt = lambda rows: rows if contained else rows.repartition(tasks, "block", "lane")  # noqa: E731 - adaptive execution would put many short texts, and so much work, in one task
    asked = prepared(queries, contained, keep=True).select("id", "seq", "rev", number(blocks, "block"), every(lanes, "lane"))
    held = prepared(refs, contained).where("id IS NOT NULL").select("id", "seq", number(lanes, "lane"), every(blocks, "block"))
    kinds = [rows.schema["id"].dataType for rows in (queries, refs)]
    names = ["query_id", "ref_id", "d"]

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        if contained:
            index = Index(list(zip(asked["seq"].to_pylist(), asked["rev"].to_pylist(), strict=True)), k, contained)
            found = best_of(index, held["id"].to_pylist(), held["seq"].combine_chunks(), top) if len(held) else None
            if found is None:
                return pa.table([asked["id"].slice(0, 0), held["id"].slice(0, 0), pa.array([], pa.float64())], names)
            d, ref = found
            query, ref, d = np.tile(np.arange(index.n), len(d)), ref.ravel(), d.ravel()
        else:
            query, ref, d = postings.nearest(asked["seq"].to_pylist(), held["id"].to_pylist(), held["seq"].to_pylist(), k, top)
        return pa.table([asked["id"].take(pa.array(query)), held["id"].take(pa.array(ref)), pa.array(d)], names)

    both = dealt(asked).groupBy("block", "lane").cogroup(dealt(held).groupBy("block", "lane"))
    return both.applyInArrow(run, f"query_id {kinds[0].simpleString()}, ref_id {kinds[1].simpleString()}, d double")
