"""Hierarchical multi-length packing (operator 6).

Documents are routed to the smallest of several context sizes (tiers) that holds them; what is longer than
the largest is first cut into full windows. Each tier is packed from the longest on: a window opens with the
longest piece of its tier, gaps are filled with the longest pieces of its own and shorter tiers that fit, and a
last gap takes the head of the shortest piece left. Every window is full, so nothing is padded. What a partition
has left at its end goes to windows of falling powers of two. Windows of a tier are dealt to step groups of
equally many tokens.
"""

from __future__ import annotations

import re
import sys
from array import array
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqlens.llm.common import checkpointed, id_text, map_batches
from seqlens.llm.tokenizer_fst import WordPieces, words_of

TIERS = (512, 1024, 2048, 4096)
END_ID = 2
#: Tokens a tier gathers before it is packed; bounds the buffer of a task together with the longest text.
BUFFER_TOKENS = 1 << 18
STEP_TOKENS = 1 << 16
#: Rows of numbers of windows, one a tier and partition, that are broadcast; more of them are joined.
BROADCAST_ROWS = 100_000
#: Words and pieces of words that are kept encoded.
MAX_WORDS = 600_000
#: UTF-8 bytes of texts that are encoded together, and characters beyond which a text is cut at white space.
GROUP_BYTES = 2 << 20
SLICE_CHARS = 1 << 19

#: What the vocabulary splits off words, in text of Latin letters: contractions, marks, single digits.
PIECE = r"('(?:[stmd]|re|ve|ll)|[^\s\x0b\x{85}\x{A0}\p{L}\p{N}]+|\p{N})"
_white = re.compile(r"[ \t\n\r]")


class WordIds(dict):
    """Word to its ids as little-endian uint32 bytes. White space parts words for good in this vocabulary, so a
    text's ids are its words' ids in a row. Words and their pieces are encoded once and kept, up to a bound."""

    def __init__(self, path: str, max_words: int = MAX_WORDS):
        super().__init__()
        self.words = WordPieces(path)
        self.words.spec = {}  # read, and larger than all else here
        self.tokenize = self.words.library.model.tokenize
        self.of_piece: dict[str, bytes] = {}
        self.not_simple = "|".join([r"[^\x{00}-\x{24F}]|[\x1c-\x1f\x{130}]", *map(re.escape, self.words.special)])
        self.max_words = max_words

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.max_words:
            self.clear()
        if self.words.has_special(word):
            made = little_endian(self.words.library.encode(word, add_special_tokens=False).ids)
        else:
            made = b"".join(map(self.tokens, self.words.of(word)))
        self[word] = made
        return made

    def tokens(self, piece: str) -> bytes:
        return little_endian([t.id for t in self.tokenize(piece)])

    def piece(self, text: str) -> bytes:
        if (made := self.of_piece.get(text)) is None:
            if len(self.of_piece) >= self.max_words:
                self.of_piece.clear()
            plain = text.isascii() and text.isprintable()
            made = self.of_piece[text] = self.tokens(text if plain else "".join([self.words.byte_char[b] for b in text.encode()]))
        return made

    def of_text(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, words_of(text)))

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text. Texts of Latin letters are split into pieces by Arrow, and each piece that they have is looked up
        once; others go word by word."""
        slow = pc.match_substring_regex(texts, self.not_simple)
        lists = pc.utf8_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(pc.if_else(slow, "", texts)), PIECE, r" \1 "))
        pieces = lists.flatten().dictionary_encode()
        made = [self.piece(p) if p else b"" for p in pieces.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, made), np.int64, len(made)) // 4
        ids = np.frombuffer(b"".join(made), "<u4")
        starts = np.cumsum(sizes) - sizes
        which = pieces.indices.to_numpy()
        size = sizes[which]
        ends = np.concatenate([[0], np.cumsum(size)])
        found = ids[np.arange(ends[-1]) + np.repeat(starts[which] - ends[:-1], size)]
        bounds = ends[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])].tolist()
        out = [found[i:j].tobytes() for i, j in zip(bounds, bounds[1:], strict=False)]
        for i in np.flatnonzero(slow.to_numpy(zero_copy_only=False)).tolist():
            out[i] = self.of_text(texts[i].as_py())
        return out


def little_endian(ids: list[int]) -> bytes:
    own = array("I", ids)
    if sys.byteorder == "big":
        own.byteswap()
    return own.tobytes()


def slices(text: str, chars: int = SLICE_CHARS) -> Iterator[str]:
    """A text in parts of about `chars`, cut at white space, which belongs to no token."""
    at = 0
    while len(text) - at > chars and (m := _white.search(text, at + chars)):
        yield text[at : m.start()]
        at = m.end()
    yield text[at:]


_made: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _made:
        _made[path] = WordIds(path)
    return _made[path]


class Packer:
    """Packs the pieces of one partition. add() and close() return finished windows: (capacity, [piece, ...])
    with piece = [length, number, start], number that of a document."""

    def __init__(self, tiers: tuple[int, ...] = TIERS, buffer_tokens: int = BUFFER_TOKENS):
        self.tiers, self.buffer_tokens = tuple(sorted(tiers)), buffer_tokens
        self.waiting: list[list[list[int]]] = [[] for _ in self.tiers]
        self.tokens = 0

    def put(self, piece: list[int]) -> None:
        insort(self.waiting[next(i for i, t in enumerate(self.tiers) if piece[0] <= t)], piece)
        self.tokens += piece[0]

    def take(self, tier: int, i: int) -> list[int]:
        piece = self.waiting[tier].pop(i)
        self.tokens -= piece[0]
        return piece

    def add(self, number: int, length: int) -> list[tuple[int, list[list[int]]]]:
        top = self.tiers[-1]
        full = length // top
        done = [(top, [[top, number, i * top]]) for i in range(full)]
        if length - full * top:
            self.put([length - full * top, number, full * top])
        return done + (self.pack(self.buffer_tokens // 4) if self.tokens > self.buffer_tokens else [])

    def fill(self, tier: int, capacity: int) -> list[list[int]] | None:
        """A full window from this and shorter tiers."""
        window, gap = [], capacity
        while gap:
            for t in range(tier, -1, -1):  # the longest that fits
                own = self.waiting[t]
                if i := bisect_right(own, gap, key=lambda p: p[0]):
                    window.append(self.take(t, i - 1))
                    break
            else:
                t = next((t for t in range(tier + 1) if self.waiting[t]), None)
                if t is None:
                    for piece in window:
                        self.put(piece)
                    return None
                length, number, start = self.take(t, 0)
                window.append([gap, number, start])
                self.put([length - gap, number, start + gap])
            gap -= window[-1][0] if window else 0
        return window

    def pack(self, keep: int) -> list[tuple[int, list[list[int]]]]:
        done = []
        for tier in range(len(self.tiers) - 1, -1, -1):
            capacity = self.tiers[tier]
            while self.waiting[tier] and self.tokens > max(keep, capacity):
                if (window := self.fill(tier, capacity)) is None:
                    break
                done.append((capacity, window))
        return done

    def close(self) -> list[tuple[int, list[list[int]]]]:
        done = self.pack(0)
        capacity = self.tiers[-1]
        rest = sorted((p for own in self.waiting for p in own), reverse=True)
        left = sum(p[0] for p in rest)
        while left:  # falling powers of two
            while capacity > left:
                capacity //= 2
            window, gap = [], capacity
            while gap:
                length, number, start = rest[0]
                n = min(gap, length)
                window.append([n, number, start])
                gap -= n
                rest[:1] = [[length - n, number, start + n]] if length > n else []
            done.append((capacity, window))
            left -= capacity
        self.waiting = [[] for _ in self.tiers]
        self.tokens = 0
        return done


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row for each piece of a document: doc_id, start, length, doc_tokens, sequence_id, offset, tier (the
    window's length), place (of the window among those of its tier in the partition), step_group, token_ids (little-endian uint32).

    Windows of a tier and partition are dealt to step groups of step_tokens each; the last of each may have fewer. balanced_steps() deals
    them over all partitions.

    A null or empty text is its end id alone. Each input row is a document, also where ids are null or repeated, and texts
    of equal length are packed in the order of their rows.
    Partitions are packed where they lie: there is no shuffle, a task holds BUFFER_TOKENS and its longest text.
    Windows are numbered within their partition, so a task that runs again numbers them alike."""
    if sorted(tiers) != [t for t in sorted(tiers) if t & (t - 1) == 0]:
        raise ValueError("tiers are powers of two")

    source = id_text(docs, id_col, text_col)
    id_type = source.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, start long, length long, doc_tokens long, sequence_id long, offset long, tier long, place long, step_group long, token_ids binary"
    end = END_ID.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, packer = word_ids(tokenizer), Packer(tiers)
        base = TaskContext.get().partitionId() << 40
        held: dict[int, list] = {}  # document number: doc_id, ids, ids not packed yet
        windows = number = 0
        in_tier: dict[int, int] = {}
        id_arrow = None

        def rows(done: list) -> Iterator[pa.RecordBatch]:
            nonlocal windows
            out: list[tuple] = []
            size = 0
            for capacity, window in done:
                place = in_tier.get(capacity, 0)
                in_tier[capacity] = place + 1
                group = base + (capacity << 24) + place // max(1, step_tokens // capacity)
                offset = 0
                for length, which, start in window:
                    doc = held[which]
                    out.append((doc[0], start, length, len(doc[1]) // 4, base + windows, offset, capacity, place, group, doc[1][4 * start : 4 * (start + length)]))
                    offset += length
                    doc[2] -= length
                    if not doc[2]:
                        del held[which]
                windows += 1
                size += capacity
                if size >= 1 << 19:
                    yield batch_of(out)
                    out, size = [], 0
            if out:
                yield batch_of(out)

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            kinds = [id_arrow, *[pa.int64()] * 8, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "tier", "place", "step_group", "token_ids"])

        def tokenized(batch: pa.RecordBatch) -> Iterator[tuple]:
            """doc_id and ids of each row; short texts are taken together, long ones in slices."""
            texts = pc.fill_null(batch.column(1), "")
            size = pc.binary_length(texts).to_numpy()
            group = (np.cumsum(size, dtype=np.int64) - size) // GROUP_BYTES
            for own in np.split(np.arange(len(size)), np.flatnonzero(np.diff(group)) + 1):
                part = texts.slice(own[0], len(own))
                long = size[own] > GROUP_BYTES
                short = cache.encode(pc.if_else(pa.array(long), "", part))
                for doc_id, is_long, text, tokens in zip(batch.column(0).slice(own[0], len(own)).to_pylist(), long, part, short, strict=True):
                    yield doc_id, (b"".join(cache.encode(pa.array([x]))[0] for x in slices(text.as_py())) if is_long else tokens) + end

        for batch in batches:
            id_arrow = batch.column(0).type
            for doc_id, tokens in tokenized(batch) if batch.num_rows else ():
                held[number] = [doc_id, tokens, len(tokens) // 4]
                done = packer.add(number, len(tokens) // 4)
                number += 1
                if done:
                    yield from rows(done)
        if id_arrow is not None:
            yield from rows(packer.close())

    return map_batches(source, run, schema)


def balanced_steps(pieces: DataFrame, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """pieces (of pack_documents(), written and read again; token_ids may be left out) with step groups over all partitions: every group has step_tokens but the last of
    each tier.

    Only the numbers of windows by tier and partition are summed up and joined; no piece is sorted."""
    part = F.shiftright("sequence_id", 40)
    counts = pieces.where("offset = 0").groupBy("tier", part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("tier").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = checkpointed(counts.select("tier", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")))
    firsts = F.broadcast(firsts) if firsts.count() <= BROADCAST_ROWS else firsts
    per = F.greatest(F.floor(F.lit(step_tokens) / F.col("tier")), F.lit(1))
    group = F.shiftleft(F.col("tier"), 40) + F.floor((F.col("first") + F.col("place")) / per)
    return pieces.withColumn("part", part).join(firsts, ["tier", "part"]).withColumn("step_group", group.cast("long")).select(*pieces.columns)
