"""Benchmark decontamination by a positional inverted index (operator 4).

Training texts are indexed in shards: a shard holds the postings (positions in a space where documents
stand one after the other, a place apart) of all its terms, one list a term. The index is a stored table with a row for each
shard; it knows nothing of what will be asked, so any number of benchmarks can be searched in it.

A phrase is found by intersecting its terms' lists, each moved back by the term's offset, from the rarest term of the shard on. All phrases of
a block are searched at once: those whose anchor (the rarest of their terms within the block) the shard has and then all of whose terms it has
are intersected term by term as arrays. Shards are searched where they lie; no row is shuffled. A proximity match is a stretch of few more
words than the phrase has that holds all of its terms.

Items are taken in blocks of bounded size, one after the other, each block's phrases sent to all shards.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlens.llm.common import by_verdict, checkpointed, map_batches

WINDOW = 13
#: Words of a shard, beyond which the next one begins (a single longer text is a shard of its own).
SHARD_WORDS = 1 << 19
#: UTF-8 bytes of a block of items: what the driver and a task hold of a benchmark at once.
BLOCK_BYTES = 4 << 20
#: Places that are intersected at once, beyond which the next phrases wait.
PLACES = 1 << 20
PHRASES_AT_ONCE = 1 << 16

WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(WORD_BYTES).split() if text else []


def spread_out(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... of size[i] numbers, for each i."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


@dataclass
class Phrases:
    """Distinct phrases of a block of items, by length: terms by number, and of each phrase the items that have it."""

    terms: dict[bytes, int]
    items: list[str]  # in order
    tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # phrases (a row each), where the items of each start, items

    @classmethod
    def of(cls, items: list[tuple[str, str | None]], window: int | None = WINDOW) -> Phrases:
        """Of windows of so many words, or whole items. An item of fewer words, but not none, is one phrase."""
        terms: defaultdict[bytes, int] = defaultdict(count().__next__)
        names = sorted({item for item, _ in items})
        number = {item: i for i, item in enumerate(names)}
        found: dict[int, list[tuple[np.ndarray, int]]] = {}
        for item, text in items:
            if own := words(text):
                size = min(len(own), window or len(own))
                ids = np.fromiter(map(terms.__getitem__, own), np.int32, len(own))
                found.setdefault(size, []).append((np.lib.stride_tricks.sliding_window_view(ids, size), number[item]))
        tables = []
        for size, parts in sorted(found.items()):
            rows = np.ascontiguousarray(np.concatenate([x for x, _ in parts]))
            item = np.concatenate([np.full(len(x), i, np.int32) for x, i in parts])
            _, first, which = np.unique(rows.view(np.dtype((np.void, 4 * size))).ravel(), return_index=True, return_inverse=True)
            pairs = np.unique(which.astype(np.int64) * len(names) + item)
            tables.append((rows[first], np.searchsorted(pairs, np.arange(len(first) + 1) * len(names)), (pairs % len(names)).astype(np.int32)))
        return cls(dict(terms), names, tables)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each shard: its number; doc_ids, n_words and starts of its documents; terms (parted by blanks), term_starts and
    postings (little-endian int32). Write it or checkpoint it: numbers follow from partitions."""
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc_ids: list = []
        n_words: list[int] = []
        parts: list[np.ndarray] = []
        number: defaultdict[bytes, int] = defaultdict(count().__next__)
        total = 0
        shard = TaskContext.get().partitionId() << 32
        kind = None

        def flush() -> pa.RecordBatch:
            nonlocal total, number, shard
            starts = np.concatenate([[0], np.cumsum(np.array(n_words, np.int64) + 1)[:-1]]).astype(np.int32)
            space = np.concatenate(parts)
            at = np.arange(len(space), dtype=np.int32) + np.repeat(np.arange(len(parts), dtype=np.int32), n_words)
            order = np.argsort(space, kind="stable")
            first = np.concatenate([[0], np.cumsum(np.bincount(space, minlength=len(number)))])
            lists = [pa.array([shard], pa.int64()), pa.array([doc_ids], pa.list_(kind)), pa.array([n_words], pa.list_(pa.int32())), pa.array([starts.tolist()], pa.list_(pa.int32()))]
            data = [pa.array([x], pa.binary()) for x in (b" ".join(number), first.astype("<i4").tobytes(), at[order].astype("<i4").tobytes())]
            for x in (doc_ids, n_words, parts):
                x.clear()
            number = defaultdict(count().__next__)
            total, shard = 0, shard + 1
            return pa.RecordBatch.from_arrays([*lists, *data], ["shard", "doc_ids", "n_words", "starts", "terms", "term_starts", "postings"])

        for batch in batches:
            kind = batch.column(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = words(text.as_py())
                if n_words and total + len(own) > SHARD_WORDS:
                    yield flush()
                doc_ids.append(doc_id)
                n_words.append(len(own))
                parts.append(np.fromiter(map(number.__getitem__, own), np.int32, len(own)))
                total += len(own)
        if n_words:
            yield flush()

    return map_batches(source, run, f"shard long, doc_ids array<{id_type}>, n_words array<int>, starts array<int>, terms binary, term_starts binary, postings binary")


class Shard:
    """Postings of one index row, of the terms that are asked for."""

    def __init__(self, terms: bytes, term_starts: bytes, postings: bytes, asked: dict[bytes, int]):
        first, at = np.frombuffer(term_starts, "<i4").astype(np.int64), np.frombuffer(postings, "<i4")
        own = terms.split(b" ") if terms else []
        number = np.fromiter((asked.get(t, -1) for t in own), np.int64, len(own))
        mine = np.flatnonzero(number >= 0)
        mine = mine[np.argsort(number[mine])]
        size = np.diff(first)[mine] if len(own) else np.zeros(0, np.int64)
        self.places = at[spread_out(first[mine], size)].astype(np.int64)
        #: (term, place) as one number, in order.
        self.keys = np.repeat(number[mine] << 32, size) + self.places
        self.start, self.count = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)
        self.start[number[mine]], self.count[number[mine]] = np.cumsum(size) - size, size

    def of(self, term: int) -> np.ndarray:
        return self.places[self.start[term] : self.start[term] + self.count[term]]

    def has(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether these terms stand in these places."""
        key = (term.astype(np.int64) << 32) + place
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        return self.keys[at] == key if len(self.keys) else np.zeros(len(key), bool)

    def find(self, rows: np.ndarray, by_anchor: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(phrase, where it starts) of all occurrences. by_anchor: anchors, where the phrases of each start, phrases."""
        anchors, first, phrases = by_anchor
        here = np.flatnonzero(self.count[anchors] > 0)
        candidates = phrases[spread_out(first[here], np.diff(first)[here])]
        for i in range(0, len(candidates), PHRASES_AT_ONCE):
            own = candidates[i : i + PHRASES_AT_ONCE]
            times = self.count[rows[own]]
            whole = times.min(axis=1) > 0
            own, times = own[whole], times[whole]
            order = np.argsort(times, axis=1, kind="stable")
            rarest = np.take_along_axis(times, order[:, :1], 1).ravel()
            turn = (np.cumsum(rarest) - rarest) // PLACES
            for part in np.split(np.arange(len(own)), np.flatnonzero(np.diff(turn)) + 1):
                yield self.intersect(rows, own[part], order[part], rarest[part])

    def intersect(self, rows: np.ndarray, own: np.ndarray, order: np.ndarray, rarest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        which = np.repeat(np.arange(len(own)), rarest)
        offset = order[:, 0]
        at = self.places[spread_out(self.start[rows[own, offset]], rarest)] - offset[which]
        for j in range(1, rows.shape[1]):
            offset = order[which, j]
            found = self.has(rows[own[which], offset], at + offset)
            at, which = at[found], which[found]
        return own[which], at

    def near(self, phrase: np.ndarray, slop: int, end_of: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Stretches [from, to) of len(phrase) + slop words at most, inside one document, that begin and end with terms of the phrase and hold
        each as often as it does; for each place where one begins the longest."""
        terms, needed = np.unique(phrase, return_counts=True)
        order = np.argsort(self.count[terms] // needed, kind="stable")
        if (self.count[terms] < needed).any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        every = np.sort(np.concatenate([self.of(t) for t in terms]))
        begin = every
        for i in order.tolist():  # from the rarest on
            limit = np.minimum(begin + len(phrase) + slop, end_of[np.searchsorted(first, begin, side="right") - 1])
            own = self.of(terms[i])
            begin = begin[np.searchsorted(own, limit) - np.searchsorted(own, begin) >= needed[i]]
        limit = np.minimum(begin + len(phrase) + slop, end_of[np.searchsorted(first, begin, side="right") - 1])
        return begin, every[np.searchsorted(every, limit) - 1] + 1


def anchored(rows: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases by their anchor: of their terms the one that the block's phrases have least often."""
    times = np.bincount(rows.ravel(), minlength=n_terms)
    anchor = np.take_along_axis(rows, times[rows].argmin(axis=1)[:, None], 1).ravel()
    order = np.argsort(anchor, kind="stable")
    anchors, first = np.unique(anchor[order], return_index=True)
    return anchors, np.append(first, len(order)), order


def search(index: DataFrame, phrases: Phrases, slop: int | None = None) -> DataFrame:
    """A row for each indexed document: shard, place (in the shard), doc_id, n_words, spans (words inside matches as sorted disjoint
    [from, to) pairs), items (of the phrases found, sorted as strings).

    Without a slop phrases are matched word for word; with one, by stretches of so many words more than the phrase has, in any order."""
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()
    shared = index.sparkSession.sparkContext.broadcast(phrases)  # of one block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        tables = [(rows, anchored(rows, len(asked.terms)), first, items) for rows, first, items in asked.tables]
        names = pa.array(asked.items, pa.string())
        for batch in batches:
            for r in range(batch.num_rows):
                number, doc_ids, n_words, starts, terms, term_starts, postings = (batch.column(i)[r].as_py() for i in range(7))
                shard = Shard(terms, term_starts, postings, asked.terms)
                first, sizes = np.array(starts, np.int64), np.array(n_words, np.int64)
                edge = np.zeros(int(sizes.sum()) + len(sizes) + 2, np.int32)
                found: list[np.ndarray] = []

                def note(phrase: np.ndarray, begin: np.ndarray, end: np.ndarray, items_first: np.ndarray, items: np.ndarray) -> None:
                    np.add.at(edge, begin, 1)  # noqa: B023
                    np.add.at(edge, end, -1)  # noqa: B023
                    doc = np.searchsorted(first, begin, side="right") - 1  # noqa: B023
                    pair = np.unique(doc * len(items_first) + phrase)
                    doc, phrase = pair // len(items_first), pair % len(items_first)
                    size = np.diff(items_first)[phrase]
                    found.append(np.unique(np.repeat(doc, size) * len(names) + items[spread_out(items_first[phrase], size)]))  # noqa: B023

                for rows, by_anchor, items_first, items in tables:
                    if slop is None:
                        for phrase, at in shard.find(rows, by_anchor):
                            if len(at):
                                note(phrase, at, at + rows.shape[1], items_first, items)
                    else:
                        for k in np.flatnonzero(shard.count[rows].min(axis=1) > 0).tolist():
                            begin, end = shard.near(rows[k], slop, first + sizes, first)
                            if len(begin):
                                note(np.full(len(begin), k), begin, end, items_first, items)
                turn = np.flatnonzero(np.diff(np.concatenate([[False], np.cumsum(edge) > 0, [False]]).astype(np.int8))).reshape(-1, 2)
                doc = np.searchsorted(first, turn[:, 0], side="right") - 1
                spans = pa.ListArray.from_arrays(pa.array(np.arange(len(turn) + 1, dtype=np.int32) * 2), pa.array((turn - first[doc][:, None]).ravel()))
                spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(sizes) + 1)).astype(np.int32)), spans)
                pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
                items_of = pa.ListArray.from_arrays(pa.array(np.searchsorted(pairs, np.arange(len(sizes) + 1) * max(len(names), 1)).astype(np.int32)), names.take(pa.array(pairs % max(len(names), 1))))
                cols = [pa.array(np.full(len(sizes), number)), pa.array(np.arange(len(sizes))), pa.array(doc_ids, batch.schema.field(1).type.value_type), pa.array(sizes), spans, items_of]
                yield pa.RecordBatch.from_arrays(cols, ["shard", "place", "doc_id", "n_words", "spans", "items"])

    return index.mapInArrow(run, f"shard long, place long, doc_id {kind}, n_words long, spans array<array<long>>, items array<string>")


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of about block_bytes, read once, a partition at a time."""
    rows = items.select(items[id_col].cast("string").alias("item"), items[text_col].cast("string").alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    own: list[tuple[str, str]] = []
    size = 0
    for r in rows.toLocalIterator():
        own.append((r["item"], r["text"]))
        size += len(r["text"].encode("utf-8", "replace"))
        if size >= block_bytes:
            yield own
            own, size = [], 0
    yield own


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, items, contaminated of every row of docs.

    n_hit counts words inside any occurrence of a window of an item; contaminated: at least one word and a twentieth of all. Texts that are null
    or without words have none. Items without an id or words are not searched for; an id that several items share is one id, and a window
    that several items share counts for each. One row out for each row in, null and repeated ids included; whole texts count, however long."""
    index = checkpointed(build_index(docs, id_col, text_col))
    return contamination_in(index, items, item_col, item_text_col, window, block_bytes)


def contamination_in(index: DataFrame, items: DataFrame, item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """As contamination(), for an index that build_index() made and that was written."""
    blocks = item_blocks(items, item_col, item_text_col, block_bytes)
    first, second = next(blocks), next(blocks, None)
    found = search(index, Phrases.of(first, window))
    if second is None:
        counted = found.select("doc_id", "n_words", covered(F.col("spans")).alias("n_hit"), "items")
    else:
        hits = checkpointed(found.where(F.size("items") > 0))
        while second is not None:
            hits = hits.unionByName(checkpointed(search(index, Phrases.of(second, window)).where(F.size("items") > 0)))
            second = next(blocks, None)
        merged = hits.groupBy("shard", "place").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        every = index.select("shard", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("place", "d")).select("shard", F.col("place").cast("long"), F.col("d.doc_ids").alias("doc_id"), F.col("d.n_words").cast("long").alias("n_words"))
        joined = every.join(merged, ["shard", "place"], "left")
        counted = joined.select("doc_id", "n_words", F.coalesce(covered(F.col("spans")), F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return counted.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def covered(spans: Column) -> Column:
    """The number of places in sorted spans, which may overlap."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    return F.aggregate(spans, start, lambda a, s: F.struct((a["n"] + F.greatest(s[1] - F.greatest(s[0], a["end"]), F.lit(0))).alias("n"), F.greatest(s[1], a["end"]).alias("end")), lambda a: a["n"])


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, that are not contaminated. Rows decide, not ids: of several rows with one id, or
    without one, those that are contaminated go."""
    found = checkpointed(contamination(docs, items, id_col, text_col).select("doc_id", "contaminated"))
    verdict = F.when(F.col("doc_id").isNull(), "rows").when(F.bool_and("contaminated"), "goes").when(F.bool_or("contaminated"), "rows").otherwise("stays")

    def chosen(rows: DataFrame) -> DataFrame:
        return contamination(rows, items, "row", text_col).where("NOT contaminated").select(F.col("doc_id").alias("row"))

    return by_verdict(docs, found.groupBy("doc_id").agg(verdict.alias("verdict")), chosen, id_col)


def phrase_matches(index: DataFrame, phrases: list[str], slop: int | None = None) -> DataFrame:
    """doc_id, spans, phrases (those found) of the documents of an index that hold any of these phrases.

    Without a slop a phrase's words stand one after the other. With one, a match is a stretch of at most that many words more than the phrase
    has, inside one document, that begins and ends with words of the phrase and holds each of them as often as the phrase does, in any
    order; spans are the union of all such stretches. A phrase without words, and a null text, match nothing; repeated phrases and rows count
    each for itself, and long texts are searched whole."""
    found = search(index, Phrases.of([(p, p) for p in phrases], None), slop)
    return found.where(F.size("items") > 0).select("doc_id", "spans", F.col("items").alias("phrases"))


def proximity_matches(docs: DataFrame, phrases: list[str], slop: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """phrase_matches() with a slop, of texts that are not indexed yet."""
    return phrase_matches(checkpointed(build_index(docs, id_col, text_col)), phrases, slop)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
gram AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win))),
occ AS (SELECT doc_id, i, n, item FROM gram JOIN win USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM occ GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
