"""Token counts by a finite-state tokenizer (operator 9).

A byte-pair encoding is a rational function: after a prefix, all that later text can depend on are the
places where a vocabulary entry may still be open, and the token that ends at each of them. This module
compiles that function into a deterministic transducer whose transitions carry the number of tokens they
emit. Rows of the transition table are made when text first asks for them (a lazy determinisation), so a
vocabulary of any size costs only what the text visits; the table is thrown away and begun anew when it
reaches a set size, which bounds memory and changes no result.

A token sequence is the encoding of its text if and only if each of its neighbouring pairs is the encoding
of the pair's text. So the last token after a prefix is the one suffix that is a vocabulary entry and is
compatible with the last token before it; the transducer needs nothing else.

White space resets the transducer. The map of a chunk of text, from the state before it to the state after
it and the tokens emitted, is hence (text up to the first white space, tokens between, text after the last
white space): an associative composition, evaluated as a prefix scan over the chunks of a text.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlens.llm.common import id_text, map_batches

#: Python's str.split() also splits at these, the tokenizers' \s doesn't.
NOT_SPACE = "\x1c\x1d\x1e\x1f"
MAX_STATES = 400_000
MAX_WORDS = 1_000_000
CHUNK_CHARS = 1 << 16


def words_of(text: str) -> list[str]:
    """The runs between white space as the vocabulary's normaliser sees it."""
    if any(c in text for c in NOT_SPACE):
        return text.replace("\n", " ").split(" ")
    return text.split()


class WordPieces:
    """Splits words of word_bpe-like vocabularies (BPE with word ends, white space dropped) into pre-tokens."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        if self.spec["model"]["type"] != "BPE" or not any(n.get("type") == "Replace" for n in (self.spec["normalizer"] or {}).get("normalizers", [])):
            raise ValueError("needs a BPE whose normaliser folds white space")
        self.library = Tokenizer.from_file(path)
        self.special = [t["content"] for t in self.spec["added_tokens"]]
        pattern = self.spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(pattern)
        self.special_pattern = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.byte_char = byte_chars()

    def has_special(self, word: str) -> bool:
        return self.special_pattern is not None and self.special_pattern.search(word) is not None

    def of(self, word: str) -> list[str]:
        """The pre-tokens of a word without special strings, in the byte alphabet."""
        if word.isascii() and word.isprintable():
            return [word.lower()] if word.isalpha() else self.pieces.findall(word.lower())
        if max(word) < "ɐ":
            text = "".join(map(str.lower, unicodedata.normalize("NFC", word)))
            table = self.byte_char
            return ["".join([table[b] for b in p.encode()]) for p in self.pieces.findall(text)]
        # Other scripts: the library's own tables say what is a letter and how it is lower-cased.
        text = self.library.normalizer.normalize_str(word)
        return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text) if p]


class CountTransducer(WordPieces):
    """Counts the tokens of word_bpe-like vocabularies."""

    def __init__(self, path: str, max_states: int = MAX_STATES, max_words: int = MAX_WORDS):
        super().__init__(path)
        model = self.spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {p: i for i, p in enumerate(pairs)}
        cut = len(self.end)
        self.inner = {t for t in model["vocab"] if not t.endswith(self.end)}
        self.final = {t[:-cut] for t in model["vocab"] if t.endswith(self.end)}
        self.open = {t[:i] for s in (self.inner, self.final) for t in s for i in range(1, len(t))}
        self.max_states, self.max_words = max_states, max_words
        self.pair: dict[tuple[str, str], bool] = {}
        self.reset()

    def reset(self) -> None:
        #: A state: places that may still begin a token, latest last, each (text since, token that ended there or "", tokens since there).
        self.states: list[tuple] = [(("", "", 0),)]
        self.number = {self.states[0]: 0}
        self.step: dict[tuple[int, str], tuple[int, int]] = {}
        self.finish: dict[tuple[int, str], int] = {}
        self.words: dict[str, int] = {}

    def encode_pair(self, a: str, b: str, last: bool) -> list[str]:
        symbols = [*a, *b]
        if last:
            symbols[-1] += self.end
        while len(symbols) > 1:
            ranks = [self.rank.get(p, 1 << 60) for p in zip(symbols, symbols[1:], strict=False)]
            i = min(range(len(ranks)), key=ranks.__getitem__)
            if ranks[i] == 1 << 60:
                break
            symbols[i : i + 2] = ["".join(symbols[i : i + 2])]
        return symbols

    def compatible(self, a: str, b: str, last: bool) -> bool:
        """Whether a, then b, is what the encoding makes of their joint text."""
        key = (a, b + self.end if last else b)
        if (known := self.pair.get(key)) is None:
            if len(self.pair) >= 2 * self.max_states:
                self.pair.clear()
            known = self.pair[key] = self.encode_pair(a, b, last) == [x for x in key if x]
        return known

    def ends(self, state: tuple, c: str, vocabulary: set[str], last: bool) -> tuple[str, int]:
        """The token that ends with c, and the tokens emitted on balance."""
        for since, before, n in state:  # longest first
            token = since + c
            if token in vocabulary and self.compatible(before, token, last):
                return token, 1 - n
        raise AssertionError(f"no token ends {state} {c!r}")

    def advance(self, at: int, c: str) -> tuple[int, int]:
        state = self.states[at]
        token, made = self.ends(state, c, self.inner, False)
        live = tuple((since + c, before, n + made) for since, before, n in state if since + c in self.open)
        after = (*live, ("", token, 0))
        if (to := self.number.get(after)) is None:
            to = self.number[after] = len(self.states)
            self.states.append(after)
        self.step[at, c] = to, made
        return to, made

    def piece(self, text: str) -> int:
        """Tokens of one pre-token, in the byte alphabet."""
        at = n = 0
        step = self.step
        for c in text[:-1]:
            to = step.get((at, c))
            at, made = to if to is not None else self.advance(at, c)
            n += made
        key = (at, text[-1])
        if (made := self.finish.get(key)) is None:
            made = self.finish[key] = self.ends(self.states[at], text[-1], self.final, True)[1]
        if len(self.states) > self.max_states:
            self.states, self.number = self.states[:1], {self.states[0]: 0}
            self.step.clear()
            self.finish.clear()
        return n + made

    def count_word(self, word: str) -> int:
        if self.has_special(word):
            plain = self.special_pattern.split(word)
            return len(plain) - 1 + sum(self.count_word(p) for p in plain if p)
        return sum(map(self.piece, self.of(word)))

    def of_words(self, words: list[str]) -> int:
        known = self.words
        n = 0
        for w in words:
            k = known.get(w)
            if k is None:
                if len(known) >= self.max_words:
                    known.clear()
                k = known[w] = self.count_word(w)
            n += k
        return n

    def chunk_map(self, text: str) -> tuple:
        """(text,) if the chunk has no white space, else (head, tokens, tail)."""
        words = words_of(text)
        if not words:
            return ("", 0, "") if text else ("",)
        head = "" if text[0] != words[0][:1] else words[0]
        if len(words) == 1 and head == text:
            return (text,)
        tail = "" if text[-1] != words[-1][-1:] else words[-1]
        body = words[1 if head else 0 : -1 if tail else None]
        return head, self.of_words(body), tail

    def compose(self, a: tuple, b: tuple) -> tuple:
        if len(a) == 1 and len(b) == 1:
            return (a[0] + b[0],)
        if len(a) == 1:
            return a[0] + b[0], b[1], b[2]
        if len(b) == 1:
            return a[0], a[1], a[2] + b[0]
        joint = a[2] + b[0]
        return a[0], a[1] + (self.of_words([joint]) if joint else 0) + b[1], b[2]

    def count(self, text: str, chunk: int = CHUNK_CHARS) -> int:
        if len(text) <= chunk:
            return self.of_words(words_of(text))
        maps = [self.chunk_map(text[i : i + chunk]) for i in range(0, len(text), chunk)]
        while len(maps) > 1:  # the up-sweep of the scan; only the whole text's entry is asked for
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        m = maps[0]
        ends = [x for x in (m[0], m[-1] if len(m) == 3 else "") if x]
        return self.of_words(ends) + (m[1] if len(m) == 3 else 0)


def byte_chars() -> list[str]:
    """The printable character that stands for each byte: itself where it is visible, else the next from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(seen)]
    table = {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


_made: dict[str, CountTransducer] = {}


def transducer(path: str) -> CountTransducer:
    """One for each Python worker."""
    if path not in _made:
        _made[path] = CountTransducer(path)
    return _made[path]


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row, in one pass without a shuffle.

    A null text counts as empty: 0 bytes, 0 tokens. A long text is counted whole, in chunks. Null, repeated and tied ids stay as they are, one row out
    for each row in; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = transducer(tokenizer)
        for batch in batches:
            ids, texts = batch.columns
            n_bytes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            counts = pa.array([fst.count(t) if t else 0 for t in texts.to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, n_bytes, counts], ["doc_id", "n_bytes", "n_tokens"])

    source = id_text(docs, id_col, text_col)
    return map_batches(source, run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")


def with_limit(counts: DataFrame, limit: int) -> DataFrame:
    return counts.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
