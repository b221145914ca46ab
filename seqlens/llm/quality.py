"""Quality rules: base statistics and a gradient-boosted verdict (operator 3)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlens.llm import trees
from seqlens.llm.common import checkpointed, id_text, map_batches

SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\v\f\r"
REPEAT_WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Labelled documents that the trees are fitted on, at most.
TRAIN_ROWS = 6000
#: Documents whose probability of being good is below this go.
THRESHOLD = 0.35

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features, each with the sign that its effect on quality must have.
FEATURES = (("log_words", 0), ("mean_word", 0), ("symbol_ratio", -1), ("dup_line_ratio", -1), ("repeat_ratio", -1), ("upper_ratio", -1), ("mark_ratio", -1), ("bar_ratio", -1), ("digit_ratio", 0), ("distinct_ratio", 0), ("top_word_ratio", -1))

_marks = re.compile(r"[!?]")
_bars = re.compile(r"[|\t]")
_digits = re.compile(r"[0-9]")


def repeat_words(words: list[bytes]) -> int:
    """Words in windows of eight found twice or more. Windows are told apart by rank doubling, which is exact."""
    n = len(words)
    if n <= REPEAT_WINDOW:
        return 0
    number: dict[bytes, int] = {}
    rank = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    size = 1
    while size < REPEAT_WINDOW:
        if len(rank) - size < 2:
            return 0
        pair = rank[:-size] * (len(words) + 1) + rank[size:]
        rank = np.unique(pair, return_inverse=True)[1]
        size *= 2
    starts = np.flatnonzero(np.bincount(rank)[rank] > 1)
    if not len(starts):
        return 0
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + REPEAT_WINDOW, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """Base statistics and features of a text."""
    text = text or ""
    words = text.encode("utf-8", "replace").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACE)] if n else []
    dup = len(lines) - len(set(lines))
    repeat = repeat_words(words)
    size = max(chars, 1)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    upper = upper_count(text)
    per = max(n, 1)
    features = [
        float(np.log1p(n)), chars / per, symbols / size, dup / max(len(lines), 1), repeat / per, upper / size, len(_marks.findall(text)) / size,
        len(_bars.findall(text)) / size, len(_digits.findall(text)) / size, len(counts) / per, max(counts.values(), default=0) / per,
    ]
    return [n, chars, symbols, dup, repeat], features


def upper_count(text: str) -> int:
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    ascii_upper = int(((codes >= 65) & (codes <= 90)).sum())
    other = codes[codes > 127]
    return ascii_upper + (sum(map(str.isupper, map(chr, other.tolist()))) if len(other) else 0)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", forest: trees.Forest | None = None) -> DataFrame:
    """doc_id, the base statistics, features, and with a forest good: the probability that the text is good."""
    source = id_text(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.columns
            found = [statistics(t) for t in texts.to_pylist()]
            x = np.array([f for _, f in found]).reshape(len(found), len(FEATURES))
            base = [pa.array([b[i] for b, _ in found], pa.int64()) for i in range(len(BASE))]
            good = pa.array(forest.probability(x)) if forest is not None else pa.nulls(len(found), pa.float64())
            features = pa.array([f for _, f in found], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([ids, *base, features, good], ["doc_id", *BASE, "features", "good"])

    counts = "".join(f"{c} long, " for c in BASE)
    return map_batches(source, run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, {counts}features array<double>, good double")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = TRAIN_ROWS) -> trees.Forest | None:
    """Trees fitted on at most train_rows labelled documents, picked by a hash of their ids; None without both labels.

    Labels that are null or without a document teach nothing, repeated ones once. Of several texts with one id the one of least features
    teaches."""
    known = labels.select(labels[id_col].alias("doc_id"), labels[label_col].cast("int").alias("label")).dropna().distinct()
    sample = checkpointed(known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(train_rows))
    chosen = id_text(docs, id_col, text_col).join(F.broadcast(sample.select("doc_id").distinct()), "doc_id")  # at most train_rows rows
    measured = measure(chosen.select("doc_id", "text")).groupBy("doc_id").agg(F.min("features").alias("features"))
    rows = measured.join(F.broadcast(sample), "doc_id").select("features", "label", "doc_id").collect()  # at most train_rows rows
    rows.sort(key=lambda r: (r["doc_id"], r["label"]))
    y = np.array([r["label"] > 0 for r in rows], float)
    if not 0 < y.sum() < len(y):
        return None
    return trees.fit(np.array([r["features"] for r in rows]), y, tuple(sign for _, sign in FEATURES))


def judge(docs: DataFrame, forest: trees.Forest | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the base statistics, base_failed, good, kept of every row, in one pass without a shuffle.

    A null or empty text has no words and fails the base rules. Without a forest the base rules alone decide. A probability that equals the threshold keeps.
    One row out for each row in, null and repeated ids included; a long text is read whole, in time and memory in proportion to it."""
    rows = measure(docs, id_col, text_col, forest).drop("features")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    return rows.withColumn("kept", ~F.col("base_failed") & (F.coalesce("good", F.lit(1.0)) >= threshold))
