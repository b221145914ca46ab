"""Spelling variants, by tries of the vocabulary and the automaton of words one edit away (operator 11).

Words are counted on the JVM. Those frequent enough are ordered by range partitions, and each range becomes tries of bounded size in
level order: a label and a number of children a node, so about two bytes each. Tries are broadcast in groups of bounded bytes; every block
of words runs the nondeterministic automaton of Levenshtein distance one against every trie of the group: along the path that
spells the word itself each node's branches (another letter, a letter more, a letter less) are followed to their ends
before the path goes one letter deeper, so what waits is bounded by a block's branches at one depth. Of the ways to
edit one string into another only one is followed, so each neighbour is met once. A block sums its neighbours and keeps the best
form; counts and forms of all groups are reduced by word.

Letters are a-z and U+00C0 to U+00FF, so a letter is a byte of Latin-1, and order by byte is order by code point.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlens.llm.common import checkpointed, id_text, lower_ascii

RUN = r"[A-Za-zÀ-ÿ]+"
LEAST_LETTERS = 5
LEAST_COUNT = 3
#: One run in so many, told by its hash, loses a letter.
SLIP = 97
#: A form is at least so many times as frequent as the word.
TIMES = 2
#: Words and bytes of text of one trie; a longer word has a trie of its own.
TRIE_WORDS = 1 << 18
TRIE_BYTES = 4 << 20
#: Bytes of tries broadcast at once, if no single one is larger.
GROUP_BYTES = 24 << 20
#: Words and letters of a block, if no single word is longer.
BLOCK_WORDS = 8192
BLOCK_LETTERS = 1 << 18

#: Place of a letter in a node's bits.
_place = np.full(256, 127, np.int64)
_place[ord("a") : ord("z") + 1] = np.arange(26)
_place[0xC0:] = 26 + np.arange(64)


def ragged(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The letters of all words one after the other, and where each begins (with the end)."""
    at = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) for w in words], out=at[1:])
    return np.frombuffer(b"".join(words), np.uint8), at


def ranges(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers first to first + count - 1 of every row, and the row of each."""
    row = np.repeat(np.arange(len(first)), count)
    return np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[row], row


@dataclass
class Trie:
    """Nodes in level order, the root first: label, number of children, whether a word ends; for the latter the word's count and place in code-point order."""

    label: np.ndarray
    degree: np.ndarray
    ends: np.ndarray
    n: np.ndarray
    rank: np.ndarray
    first: np.ndarray = field(init=False)
    parent: np.ndarray = field(init=False)
    low: np.ndarray = field(init=False)
    high: np.ndarray = field(init=False)
    word_at: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        degree = self.degree.astype(np.int64)
        self.first = 1 + np.cumsum(degree) - degree
        self.parent = np.concatenate([[-1], np.repeat(np.arange(len(degree)), degree)]).astype(np.int32)
        place = _place[self.label[1:]]
        bits = np.left_shift(np.uint64(1), (place % 64).astype(np.uint64))
        self.low, self.high = np.zeros(len(degree), np.uint64), np.zeros(len(degree), np.uint64)
        some = np.flatnonzero(degree)
        if len(some):
            at = self.first[some] - 1
            self.low[some] = np.bitwise_or.reduceat(np.where(place < 64, bits, np.uint64(0)), at)
            self.high[some] = np.bitwise_or.reduceat(np.where(place < 64, np.uint64(0), bits), at)
        self.word_at = np.cumsum(self.ends) - 1

    @classmethod
    def of(cls, words: list[bytes], counts: np.ndarray) -> Trie:
        """words: distinct, ascending, none empty."""
        text, at = ragged(words)
        length = np.diff(at)
        label, degree, ends, n, rank = [np.zeros(1, np.uint8)], [], [np.zeros(1, bool)], [], []
        here = np.arange(len(words))  # words that go on at this depth, and the node that each has come to
        node = np.zeros(len(words), np.int64)
        width = 1
        for depth in range(int(length.max(initial=0))):
            letters = text[at[here] + depth]
            new = np.ones(len(here), bool)
            new[1:] = (node[1:] != node[:-1]) | (letters[1:] != letters[:-1])
            degree.append(np.bincount(node[new], minlength=width).astype(np.uint8))
            node = np.cumsum(new) - 1
            label.append(letters[new])
            width = len(label[-1])
            done = length[here] == depth + 1
            closed = np.zeros(width, bool)
            closed[node[done]] = True
            ends.append(closed)
            n.append(counts[here[done]])
            rank.append(here[done])
            here, node = here[~done], node[~done]
        degree.append(np.zeros(width, np.uint8))
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        return cls(join(label, np.uint8), join(degree, np.uint8), join(ends, bool), join(n, np.int64), join(rank, np.int32))

    def pack(self) -> bytes:
        head = np.array([len(self.label), len(self.n)], np.int64)
        return b"".join(x.tobytes() for x in (head, self.n, self.rank, self.label, self.degree, self.ends))

    @classmethod
    def unpack(cls, packed: bytes) -> Trie:
        nodes, words = np.frombuffer(packed, np.int64, 2)
        at, out = 16, []
        for kind, size in ((np.int64, words), (np.int32, words), (np.uint8, nodes), (np.uint8, nodes), (bool, nodes)):
            out.append(np.frombuffer(packed, kind, int(size), at))
            at += out[-1].nbytes
        n, rank, label, degree, ends = out
        return cls(label, degree, ends, n, rank)

    def child(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The child by a letter, -1 where there is none: so many places after the first as smaller letters are there."""
        place = _place[letter]
        bit = np.left_shift(np.uint64(1), (place % 64).astype(np.uint64))
        before = bit - np.uint64(1)
        low, high, late = self.low[node], self.high[node], place >= 64
        there = np.where(late, high & bit, low & bit) != 0
        smaller = np.where(late, np.bitwise_count(low).astype(np.int64) + np.bitwise_count(high & before), np.bitwise_count(low & before))
        return np.where(there & (place < 90), self.first[node] + smaller, -1)

    def spelt(self, node: int) -> str:
        letters = bytearray()
        while node:
            letters.append(self.label[node])
            node = self.parent[node]
        return bytes(letters[::-1]).decode("latin-1")

    def neighbours(self, text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each pair of a word (of those in text, ragged) and a node that ends another word one edit from it, once."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        # two letters that no node has, so that one may look past a word's end
        text = np.append(text, np.array([0, 0], np.uint8))
        end = at[1:]
        word = np.arange(len(end))
        node = np.zeros(len(end), np.int64)  # spells the word's first letters
        begin = at[:-1]
        depth = 0
        while len(word):
            i = begin[word] + depth
            left = i < end[word]
            letter = text[i]
            child, row = ranges(self.first[node], self.degree[node].astype(np.int64))
            other = (self.label[child] != letter[row]) | ~left[row]
            child, row = child[other], row[other]
            changed = left[row]
            shorter = left & ((i + 1 == end[word]) | (text[i + 1] != letter))
            self._follow(
                np.concatenate([word[row], word[row[changed]], word[shorter]]),
                np.concatenate([child, child[changed], node[shorter]]),
                np.concatenate([i[row], i[row[changed]] + 1, i[shorter] + 1]),
                text, end, found,
            )
            word, node, letter = word[left], node[left], letter[left]
            node = self.child(node, letter)
            word, node = word[node >= 0], node[node >= 0]
            depth += 1
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([w for w, _ in found]), np.concatenate([v for _, v in found])

    def _follow(self, word: np.ndarray, node: np.ndarray, i: np.ndarray, text: np.ndarray, end: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Branches that have had their edit: the rest is spelt as it stands."""
        while len(word):
            over = i >= end[word]
            if over.any():
                last = over & self.ends[node]
                if last.any():
                    found.append((word[last], node[last]))
                word, node, i = word[~over], node[~over], i[~over]
            node = self.child(node, text[i])
            there = node >= 0
            word, node, i = word[there], node[there], i[there] + 1


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word: every run of letters of every text, A-Z lower-cased, the letter deleted that the hash of id and run names."""
    rows = id_text(docs, id_col, text_col)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    each = rows.select(key.alias("key"), F.explode(F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(RUN), F.lit(0))).alias("run"))
    hashed = each.withColumn("h", F.crc32(F.concat("key", F.lit(":"), "run").cast("binary")))
    place = (F.col("h") % F.length("run")).cast("int")
    slipped = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.length("run")))
    return hashed.select(F.when(F.col("h") % SLIP == 0, slipped).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n (long) of the words long and frequent enough. A null id hashes as an empty one; null and empty texts have no words."""
    counted = runs(docs, id_col, text_col).where(F.length("word") >= least_letters).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least_count)


def tries(words: DataFrame, parts: int, trie_words: int = TRIE_WORDS, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """trie, size of each of so many ranges of words (word, n)."""
    ordered = words.repartitionByRange(parts, "word").sortWithinPartitions("word").select("word", "n")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[bytes] = []
        counts: list[int] = []
        letters = 0

        def flush() -> pa.RecordBatch:
            nonlocal letters
            packed = Trie.of(own, np.array(counts, np.int64)).pack()
            own.clear()
            counts.clear()
            letters = 0
            return pa.RecordBatch.from_arrays([pa.array([packed], pa.binary()), pa.array([len(packed)], pa.int64())], ["trie", "size"])

        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                coded = word.encode("latin-1")
                if own and (len(own) >= trie_words or letters + len(coded) > trie_bytes):
                    yield flush()
                own.append(coded)
                counts.append(n)
                letters += len(coded)
        if own:
            yield flush()

    return ordered.mapInArrow(build, "trie binary, size long")


def meet(words: list[bytes], group: list[Trie]) -> tuple[np.ndarray, np.ndarray, list[str | None]]:
    """For every word how many words of the tries are near, and the most frequent of these (ties: the first in code-point order) with its count."""
    text, at = ragged(words)
    near = np.zeros(len(words), np.int64)
    most = np.zeros(len(words), np.int64)
    form: list[str | None] = [None] * len(words)
    for trie in group:
        word, node = trie.neighbours(text, at)
        if not len(word):
            continue
        near += np.bincount(word, minlength=len(words))
        which = trie.word_at[node]
        order = np.lexsort((trie.rank[which], -trie.n[which], word))
        best = order[np.concatenate([[True], word[order][1:] != word[order][:-1]])]
        for w, v, n in zip(word[best].tolist(), node[best].tolist(), trie.n[which[best]].tolist(), strict=True):
            if n >= most[w]:
                spelt = trie.spelt(v)
                if n > most[w] or spelt < form[w]:
                    most[w], form[w] = n, spelt
    return near, most, form


def neighbours(words: DataFrame, trie_words: int = TRIE_WORDS, trie_bytes: int = TRIE_BYTES, group_bytes: int = GROUP_BYTES, block_words: int = BLOCK_WORDS) -> DataFrame:
    """word, n, n_near, best_n, best of every word (word, n): near words, and the most frequent of them (null: none), written to the shared folder.

    The driver hands on one group of tries at a time, group_bytes at most (a trie of one word longer than that alone excepted), and drops it when its round is written."""
    words = checkpointed(words)
    total, letters = words.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("word").cast("long")), F.lit(0))).first()
    shards = checkpointed(tries(words, max(1, math.ceil(total / trie_words), math.ceil(letters / trie_bytes)), trie_words, trie_bytes).withColumn("id", F.monotonically_increasing_id()))
    groups: list[list[int]] = []
    room = 0
    for r in shards.select("id", "size").orderBy("id").collect():  # a row for every trie_words words
        if not groups or r["size"] > room:
            groups.append([])
            room = group_bytes
        groups[-1].append(r["id"])
        room -= r["size"]
    context = words.sparkSession.sparkContext
    dealt = words.repartition(max(context.defaultParallelism, math.ceil(total / (4 * block_words))))
    rounds = []
    for ids in groups:
        sent = context.broadcast([bytes(r["trie"]) for r in shards.where(F.col("id").isin(ids)).select("trie").collect()])
        ready: list[Trie] = []

        def run(batches: Iterator[pa.RecordBatch], sent=sent, ready=ready) -> Iterator[pa.RecordBatch]:
            if not ready:
                ready.extend(Trie.unpack(t) for t in sent.value)
            own: list[str] = []
            counts: list[int] = []
            letters = 0

            def flush() -> pa.RecordBatch:
                nonlocal letters
                near, most, form = meet([w.encode("latin-1") for w in own], ready)
                some = near > 0
                columns = [pa.array(own, pa.string()), pa.array(counts, pa.int64()), pa.array(near), pa.array(most, mask=~some), pa.array(form, pa.string())]
                own.clear()
                counts.clear()
                letters = 0
                return pa.RecordBatch.from_arrays(columns, ["word", "n", "n_near", "best_n", "best"])

            for batch in batches:
                for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if own and (len(own) >= block_words or letters + len(word) > BLOCK_LETTERS):
                        yield flush()
                    own.append(word)
                    counts.append(n)
                    letters += len(word)
            if own:
                yield flush()

        rounds.append(checkpointed(dealt.mapInArrow(run, "word string, n long, n_near long, best_n long, best string")))
        sent.destroy()
    if not rounds:
        return words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best"))
    if len(rounds) == 1:
        return rounds[0]
    every = rounds[0]
    for r in rounds[1:]:
        every = every.unionByName(r)
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), F.col("best"))))
    summed = every.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b"))
    return checkpointed(summed.select("word", "n", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best")))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of every row (word, form): the last of the forms that follow. Each round doubles the way that rows have come, so there are about log2 log2(largest count) rounds."""
    now = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        further = checkpointed(now.join(now.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left"))
        if further.where("next IS NOT NULL").isEmpty():
            return now
        now = further.select("word", F.coalesce("next", "root").alias("root"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", times: int = TIMES, **sizes: int) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary of docs.

    Two words are near if one inserted, deleted or replaced letter makes one of the other. A word's form is its most frequent near word
    (ties: the first in code-point order), if that is at least `times` as frequent; root is where the forms that follow end, the word itself without a form.

    Null and empty texts and texts without letters have no words; a null id counts as an empty one; repeated rows count as often as they are
    there; a table without words gives no row. Long texts are taken whole; a long word costs time in proportion to its length. Other columns are not read."""
    near = neighbours(vocabulary(docs, id_col, text_col), **sizes)
    named = near.select("word", "n", "n_near", *[F.when(F.col("best_n") >= times * F.col("n"), F.col(c)).alias(x) for c, x in (("best", "form"), ("best_n", "form_n"))])
    root = roots(named.where("form IS NOT NULL"))
    last: Column = F.coalesce("root", "word").alias("root")
    return named.join(root, "word", "left").select("word", "form", last, "n", "n_near", "form_n")


#: One byte after another of CRC-32, in what DuckDB has; BITS turns eight bits.
_BITS = "(SELECT list(c ORDER BY i) FROM (SELECT i, list_reduce(range(8), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) AS c FROM (SELECT unnest(range(256)) AS i)))"
ORACLE_SQL = f"""WITH RECURSIVE t AS MATERIALIZED (SELECT {_BITS} AS bits),
r AS MATERIALIZED (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS key, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS m
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY 1, 2),
h AS (SELECT run, m, xor(list_reduce(list_transform(range(1, octet_length(encode(key || ':' || run)) + 1), lambda i: CAST(('0x' || substr(hex(encode(key || ':' || run)), 2 * i - 1, 2)) AS BIGINT)),
  lambda c, b: xor(c // 256, bits[1 + (xor(c, b) % 256)]), 4294967295), 4294967295) AS h FROM r, t),
w AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, m FROM h),
v AS MATERIALIZED (SELECT word, CAST(sum(m) AS BIGINT) AS n FROM w WHERE length(word) >= 5 GROUP BY 1 HAVING sum(m) >= 3),
d AS MATERIALIZED (SELECT DISTINCT word, i, left(word, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS MATERIALIZED (SELECT a.word, b.word AS near FROM d a JOIN d b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, v.word FROM d JOIN v ON d.less = v.word UNION SELECT v.word, d.word FROM d JOIN v ON d.less = v.word),
b AS (SELECT p.word, count(*) AS n_near, min({{'less': -v.n, 'form': near}}) AS best FROM p JOIN v ON v.word = near GROUP BY 1),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 2 * v.n THEN best.form END AS form, CASE WHEN -best.less >= 2 * v.n THEN -best.less END AS form_n FROM v LEFT JOIN b ON b.word = v.word),
c AS (SELECT word, word AS at FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM f JOIN c ON c.word = f.word JOIN f g ON g.word = c.at WHERE g.form IS NULL"""
