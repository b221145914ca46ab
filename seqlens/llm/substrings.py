"""Removal of repeated byte strings by a depth-limited radix sort of suffixes (operator 7).

Two suffixes that agree through 50 bytes are a repeated window; deeper order is never asked for. Sorting every suffix of a
large corpus is not needed either: a suffix counts only if its first 50 bytes hold a key that other documents have, a key being
the least of 25 consecutive hashes of 26 bytes. Equal windows hold equal keys at equal places, so none is missed.

1. Texts are dealt to parts of about PART_BYTES. Each part sorts its keys and sends each distinct one once to the key's bucket (the first
   digit of the sort); buckets tell the parts which of their keys other documents have.
2. Parts send what stands around their shared keys (74 bytes: all windows that hold the key), each distinct one once, with its
   least doc_id. Buckets sort: first whole surroundings, which settles most, then the windows of what differs, by most-significant-digit passes
   that drop what stands alone after each digit. An equal group is a repeated window; its least doc_id keeps it.
3. Parts learn, for each of their surroundings, which windows a smaller doc_id has, and cut the texts. Surroundings are told
   by two independent hashes of 96 bits together.

A key of very many surroundings (a line that a third of all documents hold) is sorted by window instead: its windows go to the buckets of their own
hashes, each distinct one of a part once. So no bucket gets more than one entry of a key or window from each part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlens.llm.common import text_bytes

DEPTH = 50
KEY = 26
REACH = DEPTH - KEY  # bytes of a window on either side of its key, at most
AROUND = DEPTH + REACH
PART_BYTES = 8 << 20
CHUNK_BYTES = 1 << 17
#: Surroundings of a key, over all parts, beyond which its windows are sorted one by one.
HOT = 1_000_000
#: Bytes of a key that are sent. Keys only pick candidates, so what two texts share by chance costs a comparison and no more.
KEY_BYTES = 6
OUTSIDE = 0xFF  # in no UTF-8 text
LAST = np.iinfo(np.int64).max  # stands for a null doc_id: larger than all

_random = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODE = _random.integers(1, 2**63, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
DIGIT_CODE, CHECK_CODE = _random.integers(1, 2**63, (2, 16), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def key_places(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys, and the keys. inside: where KEY bytes of one text start."""
    powers = {n: BASE ** np.uint64(n) for n in (1, 2, 4, 8)}
    h1 = BYTE_CODE[data]
    h2 = h1[:-1] * powers[1] + h1[1:]
    h4 = h2[:-2] * powers[2] + h2[2:]
    h8 = h4[:-4] * powers[4] + h4[4:]
    h16 = h8[:-8] * powers[8] + h8[8:]
    n = len(data) - KEY + 1
    h24 = h16[: n + 2] * powers[8] + h8[16 : n + 18]
    h = mixed(h24[:n] * powers[2] + h2[24 : n + 24])
    h[~inside[:n]] = np.uint64(2**64 - 1)
    low = least_of(h, np.minimum)
    high = least_of(np.concatenate([np.zeros(REACH, np.uint64), low, np.zeros(REACH, np.uint64)]), np.maximum)
    at = np.flatnonzero((h[: len(high)] == high) & inside[: len(high)])
    return at, h[at]


def least_of(h: np.ndarray, least: np.ufunc) -> np.ndarray:
    """least over each REACH + 1 = 25 in a row."""
    size = 1
    while size < 16:
        h = least(h[:-size], h[size:])
        size *= 2
    return least(h[:-9], h[9:])


class Chunk:
    """Texts laid one after the other, AROUND bytes of OUTSIDE between them."""

    def __init__(self, texts: list[bytes], first: int):
        gap = bytes([OUTSIDE]) * AROUND
        self.data = np.frombuffer(gap + b"".join(t + gap for t in texts), np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.start = AROUND + np.concatenate([[0], np.cumsum(sizes + AROUND)[:-1]])
        self.size, self.first = sizes, first
        edge = np.zeros(len(self.data) + 1, np.int8)
        long = sizes >= DEPTH
        edge[self.start[long]] = 1
        edge[(self.start + sizes - KEY + 1)[long]] -= 1
        inside = np.cumsum(edge[:-1], dtype=np.int8) > 0
        self.at, key = key_places(self.data, inside)
        self.key = key >> np.uint64(8 * (8 - KEY_BYTES))
        self.doc = np.searchsorted(self.start, self.at, side="right") - 1

    def around(self, which: np.ndarray) -> np.ndarray:
        """The surroundings of these keys, a row each."""
        return self.data[(self.at[which] - REACH)[:, None] + np.arange(AROUND)]


def chunks(texts: list[bytes]) -> Iterator[Chunk]:
    own: list[bytes] = []
    size = first = 0
    for i, t in enumerate(texts):
        own.append(t)
        size += len(t)
        if size >= CHUNK_BYTES or i == len(texts) - 1:
            yield Chunk(own, first)
            own, size, first = [], 0, i + 1


def digits(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as big-endian 64-bit digits."""
    width = -(-rows.shape[1] // 8) * 8
    wide = np.zeros((len(rows), width), np.uint8)
    wide[:, : rows.shape[1]] = rows
    return wide.view(">u8").astype(np.uint64)


def row_hash(rows: np.ndarray, code: np.ndarray = DIGIT_CODE) -> np.ndarray:
    d = digits(rows)
    h = np.zeros(len(d), np.uint64)
    for i in range(d.shape[1]):
        h = mixed((h ^ d[:, i]) * code[i])
    return h


def row_check(rows: np.ndarray) -> np.ndarray:
    """A second hash, of 32 bits: rows whose first one is equal are told apart by it."""
    return (row_hash(rows, CHECK_CODE) >> np.uint64(32)).astype(np.uint32)


def equal_groups(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that others of their group equal, and the number of each one's equal group: a radix sort from the most significant
    digit on, which goes on with those only that are not alone yet."""
    d = digits(rows)
    active = np.arange(len(d))
    for i in range(d.shape[1]):
        if not len(active):
            break
        order = np.lexsort((d[active, i], group))
        active, group = active[order], group[order]
        now = d[active, i]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (now[1:] != now[:-1])])
        group = np.cumsum(new)
        more = np.bincount(group)[group] > 1
        active, group = active[more], group[more]
    return active, group


def pack(*arrays: np.ndarray) -> list[bytes]:
    return [np.ascontiguousarray(a).tobytes() for a in arrays]


def squeezed(data: np.ndarray) -> bytes:
    """Text is half as long with its letters' frequencies used, which the shuffle's own codec doesn't do."""
    return pa.compress(np.ascontiguousarray(data).tobytes(), codec="zstd", asbytes=True)


def unsqueezed(parts: list[bytes], rows: list[int], width: int) -> np.ndarray:
    codec = pa.Codec("zstd")
    return np.frombuffer(b"".join(codec.decompress(x, n * width, asbytes=True) for x, n in zip(parts, rows, strict=True)), np.uint8).reshape(-1, width)


def pack_keys(key: np.ndarray) -> bytes:
    return np.ascontiguousarray(key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]).tobytes()


def unpack_keys(data: bytes) -> np.ndarray:
    rows = np.frombuffer(data, np.uint8).reshape(-1, KEY_BYTES)
    wide = np.zeros((len(rows), 8), np.uint8)
    wide[:, :KEY_BYTES] = rows
    return wide.view("<u8").ravel().astype(np.uint64)


def by_bucket(key: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Bucket numbers and the places of their keys, in order of keys."""
    bucket = (key % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((key, bucket))
    edge = np.flatnonzero(np.diff(bucket[order])) + 1
    for own in np.split(order, edge) if len(order) else []:
        yield int(bucket[own[0]]), own


def least_ids(ids: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each distinct key (all of keys): one place, its least id, whether it has several ids; and each row's number."""
    order = np.lexsort((ids, *keys))
    k, i = [key[order] for key in keys], ids[order]
    new = np.concatenate([[True], np.logical_or.reduce([x[1:] != x[:-1] for x in k])]) if len(i) else np.zeros(0, bool)
    number = np.empty(len(i), np.int64)
    number[order] = np.cumsum(new) - 1
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(i))[: len(start)] - 1
    return order[start], i[start], i[end] != i[start], number


def part_rows(frame: pd.DataFrame) -> tuple[list[bytes], np.ndarray, list]:
    texts = [t if t is not None else b"" for t in frame["text"].tolist()]
    ids = frame["doc_id"].astype("Int64")
    return texts, ids.fillna(LAST).to_numpy(np.int64), frame["doc_id"].tolist()


def send_keys(buckets: int):
    """Step 1: a part's distinct keys by bucket, how often each occurs, and whether in several documents."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        texts, ids, _ = part_rows(frame)
        keys, owners = [], []
        for c in chunks(texts):
            keys.append(c.key)
            owners.append(ids[c.first + c.doc])
        key, owner = np.concatenate(keys), np.concatenate(owners)
        at, _, several, number = least_ids(owner, key)
        times = np.bincount(number, minlength=len(at))
        part = int(frame["part"].iloc[0])
        rows = [(b, part, pack_keys(key[at][own]), *pack(np.minimum(times[own], 2**16 - 1).astype(np.uint16), several[own])) for b, own in by_bucket(key[at], buckets)]
        return pd.DataFrame(rows, columns=["bucket", "part", "keys", "times", "several"])

    return run


def shared_keys(hot: int):
    """Step 1, at a bucket: for each part those of its keys that more than one document has, and which of them are hot."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        keys = [unpack_keys(x) for x in frame["keys"]]
        key = np.concatenate(keys)
        times = np.concatenate([np.frombuffer(x, np.uint16) for x in frame["times"]]).astype(np.int64)
        several = np.concatenate([np.frombuffer(x, bool) for x in frame["several"]])
        _, number = np.unique(key, return_inverse=True)
        shared = (np.bincount(number) > 1) | (np.bincount(number, several) > 0)
        many = np.bincount(number, times) > hot
        rows, start = [], 0
        for part, own in zip(frame["part"], keys, strict=True):
            mine = number[start : start + len(own)]
            start += len(own)
            kept = shared[mine]
            if kept.any():
                rows.append((int(part), pack_keys(own[kept]), *pack(many[mine][kept])))
        return pd.DataFrame(rows, columns=["part", "keys", "hot"])

    return run


def lookup(known: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The place of each asked key among sorted known ones, or -1."""
    if not len(known):
        return np.full(len(asked), -1, np.int64)
    at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    return np.where(known[at] == asked, at, -1)


def lookup_rows(known: tuple[np.ndarray, ...], rows: np.ndarray) -> np.ndarray:
    """The place of each row among known hashes and checks, sorted by both, or -1."""
    hashes, checks = known[:2]
    asked = row_hash(rows)
    at = lookup(hashes, asked)
    hit = np.flatnonzero(at >= 0)
    own, check, place = asked[hit], row_check(rows[hit]), at[hit]
    while len(wrong := np.flatnonzero((place >= 0) & (checks[place] != check))):  # another row of the same hash
        following = np.minimum(place[wrong] + 1, len(hashes) - 1)
        place[wrong] = np.where((following > place[wrong]) & (hashes[following] == own[wrong]), following, -1)
    at[hit] = place
    return at


def windows(around: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of one text in these surroundings: row, offset, bytes."""
    view = np.lib.stride_tricks.sliding_window_view(around, DEPTH, axis=1)
    valid = (around[:, : REACH + 1] != OUTSIDE) & (around[:, DEPTH - 1 :] != OUTSIDE)
    row, offset = np.nonzero(valid)
    return row, offset, view[row, offset]


WINDOWS_AT_ONCE = 200_000


def send_around(buckets: int):
    """Step 2: surroundings of a part's shared keys, and windows of its hot ones, by bucket."""

    def run(_, docs: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        columns = ["bucket", "part", "windowed", "data", "ids", "several", "keys"]
        if not len(docs) or not len(known):
            return pd.DataFrame([], columns=columns)
        key = np.concatenate([unpack_keys(x) for x in known["keys"]])
        hot = np.concatenate([np.frombuffer(x, bool) for x in known["hot"]])
        order = np.argsort(key)
        key, hot = key[order], hot[order]
        texts, ids, _ = part_rows(docs)
        part = int(docs["part"].iloc[0])
        found: dict[bool, list] = {False: [], True: []}
        for c in chunks(texts):
            at = lookup(key, c.key)
            which = np.flatnonzero(at >= 0)
            cold = which[~hot[at[which]]]
            around = c.around(cold)
            found[False].append((around, c.key[cold], row_hash(around), row_check(around), ids[c.first + c.doc[cold]], c.key[cold]))
            warm = which[hot[at[which]]]
            for i in range(0, len(warm), WINDOWS_AT_ONCE // (REACH + 1)):
                own = warm[i : i + WINDOWS_AT_ONCE // (REACH + 1)]
                row, _, data = windows(c.around(own))
                h, check, owner = row_hash(data), row_check(data), ids[c.first + c.doc[own]][row]
                at_, least, several, _ = least_ids(owner, check, h)
                # a chunk's distinct windows; several ids of one window are told by its least and its greatest
                most = -least_ids(-owner, check, h)[1]
                twice = np.concatenate([at_, at_[several]])
                found[True].append((data[twice], h[twice], h[twice], check[twice], np.concatenate([least, most[several]]), c.key[own][row[twice]]))
        rows = []
        for windowed, parts in found.items():
            if not parts:
                continue
            data, k, h, check, owner, key_ = (np.concatenate(x) for x in zip(*parts, strict=True))
            at, least, several, _ = least_ids(owner, check, h)
            data, k, key_ = data[at], k[at], key_[at]
            rows += [(b, part, windowed, squeezed(data[own]), *pack(least[own], several[own], key_[own] if windowed else key_[:0])) for b, own in by_bucket(k, buckets)]
        return pd.DataFrame(rows, columns=columns)

    return run


def sort_bucket(frame: pd.DataFrame) -> pd.DataFrame:
    """Step 2, at a bucket: for each part the hash of what a smaller doc_id has too, and the first and last offset of such windows."""
    rows: list[tuple] = []
    for windowed, own in frame.groupby("windowed", sort=False):
        width = DEPTH if windowed else AROUND
        sizes = [len(x) // 8 for x in own["ids"]]
        data = unsqueezed(own["data"].tolist(), sizes, width)
        ids = np.frombuffer(b"".join(own["ids"]), np.int64)
        several = np.frombuffer(b"".join(own["several"]), bool)
        low, high = sort_windows(data, ids) if windowed else sort_around(data, ids)
        h, check = row_hash(data), row_check(data)
        keys = np.frombuffer(b"".join(own["keys"]), np.uint64)
        start = 0
        for part, n in zip(own["part"], sizes, strict=True):
            mine = slice(start, start + n)
            start += n
            told = (high[mine] >= 0) | several[mine]
            if told.any():
                rows.append((int(part), bool(windowed), *pack(h[mine][told], check[mine][told], low[mine][told], high[mine][told], np.unique(keys[mine][told]) if windowed else keys[:0])))
    return pd.DataFrame(rows, columns=["part", "windowed", "hashes", "checks", "low", "high", "keys"])


def sort_windows(data: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = ids.copy()
    active, group = equal_groups(data, np.zeros(len(data), np.int64))
    if len(active):
        least = np.full(group.max() + 1, LAST)
        np.minimum.at(least, group, ids[active])
        first[active] = least[group]
    told = np.where(first < ids, 0, -1).astype(np.int8)
    return told, told


def sort_around(data: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and last offset of a window that a smaller doc_id has, or -1."""
    n = len(data)
    low, high = np.full(n, -1, np.int8), np.full(n, -1, np.int8)
    whole, number = equal_groups(data, np.zeros(n, np.int64))
    distinct = np.arange(n)  # the place that stands for each row's surroundings
    if len(whole):
        order = np.lexsort((ids[whole], number))
        whole, number = whole[order], number[order]
        new = np.concatenate([[True], number[1:] != number[:-1]])
        distinct[whole] = np.repeat(whole[new], np.diff(np.append(np.flatnonzero(new), len(whole))))
    heads = np.flatnonzero(distinct == np.arange(n))  # each with the least id of its surroundings
    valid = (data[:, : REACH + 1] != OUTSIDE) & (data[:, DEPTH - 1 :] != OUTSIDE)
    firsts = np.where(valid[heads], ids[heads][:, None], LAST)
    _, key = np.unique(row_hash(data[heads][:, REACH : REACH + KEY]), return_inverse=True)
    mixed_keys = np.bincount(key)[key] > 1
    some = np.flatnonzero(mixed_keys)
    for offset in range(REACH + 1):
        own = some[valid[heads[some], offset]]
        if not len(own):
            continue
        active, group = equal_groups(data[heads[own], offset : offset + DEPTH], key[own])
        if len(active):
            least = np.full(group.max() + 1, LAST)
            np.minimum.at(least, group, ids[heads[own[active]]])
            firsts[own[active], offset] = least[group]
    place = np.empty(n, np.int64)
    place[heads] = np.arange(len(heads))
    smaller = valid & (firsts[place[distinct]] < ids[:, None])
    any_ = smaller.any(axis=1)
    low[any_] = smaller[any_].argmax(axis=1)
    high[any_] = REACH - smaller[any_][:, ::-1].argmax(axis=1)
    return low, high


def cut(_, docs: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
    """Step 3: a part's texts without the bytes that smaller ids have."""
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
    if not len(docs):
        return pd.DataFrame([], columns=columns)
    texts, ids, names = part_rows(docs)
    known = {}
    for windowed, own in told.groupby("windowed", sort=False) if len(told) else ():
        h, check, low, high = (np.concatenate([np.frombuffer(x, t) for x in own[c]]) for c, t in (("hashes", np.uint64), ("checks", np.uint32), ("low", np.int8), ("high", np.int8)))
        order = np.lexsort((check, h))
        known[bool(windowed)] = (h[order], check[order], low[order], high[order])
    hot = np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x, np.uint64) for x in told["keys"])])) if len(told) else np.zeros(0, np.uint64)
    none = (np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int8), np.zeros(0, np.int8))
    made = list(chunks(texts))
    # The least id of each surrounding and window of this part that was told of.
    least = {w: np.full(len(known.get(w, none)[0]), LAST) for w in (False, True)}
    hits: list[list[tuple]] = []
    for c in made:
        own: list[tuple] = []
        for i in range(0, len(c.at), 50_000):
            which = np.arange(i, min(i + 50_000, len(c.at)))
            around = c.around(which)
            owner = ids[c.first + c.doc[which]]
            at = lookup_rows(known.get(False, none), around)
            hit = np.flatnonzero(at >= 0)
            np.minimum.at(least[False], at[hit], owner[hit])
            own.append((False, c.at[which[hit]] - REACH, at[hit], owner[hit], around[hit]))
            warm = np.flatnonzero(lookup(hot, c.key[which]) >= 0)
            for j in range(0, len(warm), WINDOWS_AT_ONCE // (REACH + 1)):
                sub = warm[j : j + WINDOWS_AT_ONCE // (REACH + 1)]
                row, offset, data = windows(around[sub])
                at = lookup_rows(known[True], data)
                hit = np.flatnonzero(at >= 0)
                np.minimum.at(least[True], at[hit], owner[sub][row[hit]])
                own.append((True, c.at[which[sub]][row[hit]] - REACH + offset[hit], at[hit], owner[sub][row[hit]], None))
        hits.append(own)
    out = []
    for c, own in zip(made, hits, strict=True):
        edge = np.zeros(len(c.data) + 1, np.int32)
        for windowed, place, at, owner, around in own:
            _, _, low, high = known.get(windowed, none)
            later = owner > least[windowed][at]
            lo, hi = low[at].astype(np.int64), high[at].astype(np.int64)
            if not windowed and len(at):
                valid = (around[:, : REACH + 1] != OUTSIDE) & (around[:, DEPTH - 1 :] != OUTSIDE)
                some = valid.any(axis=1)
                later &= some
                lo = np.where(later, valid.argmax(axis=1), lo)
                hi = np.where(later, REACH - valid[:, ::-1].argmax(axis=1), hi)
            elif windowed:
                lo, hi = np.where(later, 0, lo), np.where(later, 0, hi)
            go = hi >= 0
            np.add.at(edge, place[go] + lo[go], 1)
            np.add.at(edge, place[go] + hi[go] + DEPTH, -1)
        gone = np.cumsum(edge[:-1]) > 0
        for i, (start, size) in enumerate(zip(c.start.tolist(), c.size.tolist(), strict=True)):
            removed = gone[start : start + size]
            kept = c.data[start : start + size][~removed].tobytes()
            spans = int((removed[1:] & ~removed[:-1]).sum() + (removed[:1].sum() if size else 0))
            out.append((names[c.first + i], size, size - len(kept), spans, kept))
    return pd.DataFrame(out, columns=columns)


def cut_digest(key, docs: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
    frame = cut(key, docs, told)
    frame["kept"] = [hashlib.sha256(k).hexdigest() for k in frame["kept"]]
    return frame.rename(columns={"kept": "kept_sha256"})


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, part_bytes: int = PART_BYTES, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (or kept_sha256, with digest) of every row of docs.

    Removed is each byte that a 50-byte string covers which starts in a text with a smaller doc_id too; strings are those of the
    input. A null text is empty. Rows of one id do not cut each other; a null id is larger than all and cut by any other, so of copies the one with the least
    id stays. Ids are whole numbers, or strings of such: others are refused by the cast. A long text is one part's, whole. One row out for each row in; an empty table gives
    none; other columns are not read."""
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").cast("binary").alias("text"))
    parts = max(1, -(-text_bytes(docs, text_col) // part_bytes))
    part = F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(parts)).cast("int")
    dealt = source.withColumn("part", part).repartition(parts, "part")
    keys = dealt.groupBy("part").applyInPandas(send_keys(parts), "bucket int, part int, keys binary, times binary, several binary")
    shared = keys.groupBy("bucket").applyInPandas(shared_keys(hot), "part int, keys binary, hot binary")
    around = dealt.groupBy("part").cogroup(shared.groupBy("part")).applyInPandas(send_around(parts), "bucket int, part int, windowed boolean, data binary, ids binary, several binary, keys binary")
    told = around.groupBy("bucket").applyInPandas(sort_bucket, "part int, windowed boolean, hashes binary, checks binary, low binary, high binary, keys binary")
    made = dealt.groupBy("part").cogroup(told.groupBy("part"))
    if digest:
        return made.applyInPandas(cut_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return made.applyInPandas(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
