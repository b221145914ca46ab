"""Language identification by rank-order n-gram profiles (operator 1).

A profile is the list of a language's most frequent character n-grams (n = 1 to 3, a blank at word ends) in
order of frequency. A text is ranked alike, and its distance from a profile is the sum, over its n-grams, of how
far out of place each stands; one that the profile lacks counts as the profile's length. The nearest profile wins.

Profiles are fitted on a bounded sample: about `sample_per_lang` documents of each language, picked by a hash of
the id, so that the driver and the fit see the same amount at any size of the corpus. Scoring reads every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqlens.llm.common import checkpointed, id_text, map_batches

SAMPLE_PER_LANG = 2000
PROFILE_SIZE = 400
MAX_N = 3
#: What a filter asks of a text at least; texts of the languages learnt have several times as much.
LEAST_NEARNESS = 0.05
UNKNOWN = "und"
CODE_POINTS = 0x110000
#: Languages whose rates are broadcast; those of more are joined.
BROADCAST_LANGS = 20_000
#: n-grams that a task of the fit holds before it hands their counts on.
HELD_GRAMS = 1 << 21


@dataclass
class Profiles:
    """langs, and each one's n-grams in order of rank (blank: a space)."""

    langs: list[str]
    grams: list[list[str]]
    size: int = PROFILE_SIZE
    keys: np.ndarray = field(init=False)
    ranks: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        coded = [[key_of(g) for g in own] for own in self.grams]
        self.keys = np.array(sorted({k for own in coded for k in own}), np.uint64)
        self.ranks = np.full((len(self.langs), len(self.keys)), -1, np.int64)
        for i, own in enumerate(coded):
            for rank, k in reversed(list(enumerate(own))):
                self.ranks[i, np.searchsorted(self.keys, np.uint64(k))] = rank

    def distances(self, text: str) -> tuple[np.ndarray, int] | None:
        """The distance from each profile, and the greatest that the text could have; None for a text without letters."""
        codes = letters_of(text)
        if not codes.any():
            return None
        ranked = rank_grams(codes, self.size)
        if not len(self.keys):
            return np.full(len(self.langs), len(ranked) * self.size), len(ranked) * self.size
        at = np.minimum(np.searchsorted(self.keys, ranked), len(self.keys) - 1)
        own = self.ranks[:, at]
        missing = (own < 0) | (self.keys[at] != ranked)
        apart = np.where(missing, self.size, np.abs(own - np.arange(len(ranked))))
        return apart.sum(axis=1), len(ranked) * self.size

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """The language, how much nearer it is than the next (0 to 1), and how near it is itself (0 to 1)."""
        found = self.distances(text) if text and self.langs else None
        if found is None:
            return UNKNOWN, 0.0, 0.0
        apart, most = found
        order = np.argsort(apart, kind="stable")
        first = int(apart[order[0]])
        second = int(apart[order[1]]) if len(order) > 1 else most
        return self.langs[order[0]], (second - first) / second if second else 0.0, 1.0 - first / most


_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(CODE_POINTS)), bool, CODE_POINTS))
    return _letters[0]


def letters_of(text: str) -> np.ndarray:
    """The code points of a text's letters, 0 in place of all else."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    return np.where(letter_table()[points], points, 0)


#: Bits of a code point, and what tells n-grams of two and of one apart from those of three.
POINT = 21
TWO, ONE = 1 << 63, 3 << 62


def key_of(gram: str) -> int:
    """An n-gram (blank: a space) as a number."""
    key = 0
    for c in gram:
        key = key << POINT | (0 if c == " " else ord(c))
    return key | (0, ONE, TWO, 0)[len(gram)]


def count_grams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of a text's n-grams, ascending (longer n-grams first, then by code point), and how often each is there. codes: 0 is no letter."""
    codes = np.concatenate([[0], codes, [0]]).astype(np.uint64)
    codes = codes[(codes != 0) | np.concatenate([[True], codes[:-1] != 0])]
    bits = np.uint64(POINT)
    two = codes[:-1] << bits | codes[1:]
    three = two[:-1] << bits | codes[2:]
    one = codes[codes != 0]
    return np.unique(np.concatenate([one | np.uint64(ONE), two | np.uint64(TWO), three[codes[1:-1] != 0]]), return_counts=True)


def rank_grams(codes: np.ndarray, size: int) -> np.ndarray:
    """Keys of the most frequent n-grams, most frequent first, ties by key."""
    keys, counts = count_grams(codes)
    if len(keys) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        enough = counts >= least
        keys, counts = keys[enough], counts[enough]
    return keys[np.argsort(-counts, kind="stable")[:size]]


def aligned(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n-grams with their first letter in the same place, and their lengths: in order of both they are in code-point order as strings."""
    length = np.where(keys >= np.uint64(ONE), 1, np.where(keys >= np.uint64(TWO), 2, 3))
    bare = np.where(length == 3, keys, keys & np.uint64((1 << 62) - 1))
    return (bare << ((3 - length) * POINT).astype(np.uint64)).astype(np.int64), length.astype(np.int8)


def spelt(at: int, length: int) -> str:
    """The n-gram that aligned() gives so; blank: a space."""
    points = [at >> POINT * (2 - i) & ((1 << POINT) - 1) for i in range(length)]
    return "".join(chr(p) if p else " " for p in points)


def fit_profiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_per_lang: int = SAMPLE_PER_LANG, size: int = PROFILE_SIZE) -> Profiles:
    """Profiles of all languages among the labelled rows of docs. Rows with a null text or language teach nothing.

    Only len(langs) * size n-grams come to the driver. The sample is drawn by a hash of id and text at a rate that follows
    from each language's number of texts; counts of the sample are summed on the executors. Of n-grams as frequent as each other the first in code
    point order ranks first."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"), docs[lang_col].alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    rates = checkpointed(rows.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(sample_per_lang) / F.count(F.lit(1))).alias("rate")))
    unit = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    few = rates.count() <= BROADCAST_LANGS
    sample = rows.join(F.broadcast(rates) if few else rates, "lang").where(unit < F.col("rate")).select("lang", "text")
    names = ["lang", "at", "length", "n"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        room = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                n = np.bincount(place, np.concatenate([c for _, c in parts])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(keys)), *map(pa.array, (*aligned(keys), n))], names)
            held.clear()

        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                codes = letters_of(text)
                if codes.any():
                    found = count_grams(codes)
                    held.setdefault(lang, []).append(found)
                    room += len(found[0])
                if room > HELD_GRAMS:
                    yield from flush()
                    room = 0
        yield from flush()

    summed = map_batches(sample, count, "lang string, at long, length tinyint, n long").groupBy("lang", "at", "length").agg(F.sum("n").alias("n"))
    ranked = summed.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "at", "length"))).where(F.col("rank") <= size)
    grams: dict[str, list] = {}
    for r in ranked.collect():
        grams.setdefault(r["lang"], []).append((r["rank"], spelt(r["at"], r["length"])))
    langs = sorted(grams)
    return Profiles(langs, [[g for _, g in sorted(grams[k])] for k in langs], size)


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, nearness of every row, from the whole text alone, without a shuffle.

    Null texts and texts without letters: `und`, score 0; a long text is read whole, in time and memory in proportion to it. Ties go to the first language by name. One row out for
    each row in, null and repeated ids included; without any profile all are `und`."""
    source = id_text(docs, id_col, text_col)
    grams, langs, size = profiles.grams, profiles.langs, profiles.size
    made: list[Profiles] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Profiles(langs, grams, size))
        for batch in batches:
            ids, texts = batch.columns
            found = [made[0].predict(t) for t in texts.to_pylist()]
            cols = list(zip(*found, strict=True)) if found else [(), (), ()]
            kinds = (pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], ["doc_id", "lang_pred", "score", "nearness"])

    return map_batches(source, run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, nearness double")


def in_known_language(docs: DataFrame, profiles: Profiles, text_col: str = "text", least_nearness: float = LEAST_NEARNESS) -> DataFrame:
    """The rows of docs, all columns as they are, whose text is in a language that has a profile.

    Null texts and texts without letters go, and texts that are no nearer to any profile than least_nearness (0: not one
    n-gram in common). Without any profile nothing can be told, so only texts without letters go. No row is shuffled."""
    grams, langs, size = profiles.grams, profiles.langs, profiles.size
    place = docs.columns.index(text_col)
    made: list[Profiles] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Profiles(langs, grams, size))
        known = made[0]

        def stays(text: str | None) -> bool:
            if not langs:
                return bool(text) and any(map(str.isalpha, text))
            lang, _, nearness = known.predict(text)
            return lang != UNKNOWN and nearness >= least_nearness

        for batch in batches:
            yield batch.filter(pa.array([stays(t) for t in batch.column(place).to_pylist()], pa.bool_()))

    return map_batches(docs, run, docs.schema)


def held_out(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs with held_out: the fifth of ids kept from the fit."""
    return docs.withColumn("held_out", F.coalesce(F.crc32(docs[id_col].cast("string").cast("binary")) % 5 == 0, F.lit(False)))
