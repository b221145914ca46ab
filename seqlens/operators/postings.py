"""The nearest sets of a lane for a block of queries, by lists of the sets that have a k-mer, the rarest first.

A set that is first met in the list of a query's i-th k-mer has none of the k-mers before it, so it shares n - i at most; of which sizes it may then be to come before what
is found already is a range, which narrows from list to list until it is empty. So lists of k-mers that nearly all sets have are not read, and nothing is left out: the
result is that of all pairs, ties by id among it. Queries whose lists are so long that counting all sets is cheaper (long texts of few letters) count all."""

from __future__ import annotations

import numpy as np

from seqlens.operators.setparts import cuts, distinct, flat_of, letters_in, mixed, points_of, windows_of

#: Queries whose k-mers are in hand at once, and pairs looked at together.
BATCH, PAIRS = 4096, 1 << 20
#: Postings of a query's first stage, and how many times as many the next one has.
FIRST, MORE = 16, 4
#: Words of a signature: a bit that a set has and another lacks tells of a k-mer that is not shared.
WORDS = 8


def letters_of(*texts: list[str]) -> np.ndarray:
    return np.unique(np.concatenate([letters_in(points_of("".join(x))) for x in texts]))


def kmers_of(texts: list[str], letters: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The place in texts of each k-mer, and its number (or bytes, if there are too many). No k-mer crosses texts."""
    size = np.array([len(t) for t in texts], np.int64)
    number = np.maximum(size - k + 1, 0)
    every = windows_of(points_of("".join(texts)), letters, k)
    every = every if every.dtype.kind != "V" else every.view(f"S{4 * k}")  # these can be searched
    return np.repeat(np.arange(len(texts)), number), every[flat_of(np.cumsum(size) - size, number)]


def signatures(first: np.ndarray, size: np.ndarray, number: np.ndarray) -> list[np.ndarray]:
    """WORDS words for each set of so many numbers from first on."""
    filled = np.flatnonzero(size)
    out = [np.zeros(len(size), np.uint64) for _ in range(WORDS)]
    for s, e in cuts(size[filled], PAIRS):
        own = filled[s:e]
        hashed = mixed(number[first[own[0]] : first[own[-1]] + size[own[-1]]].astype(np.uint64))
        bit, word = np.uint64(1) << (hashed & np.uint64(63)), (hashed >> np.uint64(6)) % np.uint64(WORDS)
        for w in range(WORDS):
            out[w][own] = np.bitwise_or.reduceat(np.where(word == w, bit, np.uint64(0)), first[own] - first[own[0]])
    return out


class Lane:
    """Sets of texts, numbered by size, then by id, and for each k-mer the sets that have it. `place` has the sets' places in texts, `rank` those in the order of ids."""

    def __init__(self, ids: list, texts: list[str], letters: np.ndarray, k: int):
        self.k, self.letters, self.n = k, letters, len(texts)
        row, kmer = kmers_of(texts, letters, k)
        self.kmers = distinct(kmer)
        many = max(len(self.kmers), 1)
        key = np.searchsorted(self.kmers, kmer) * self.n + row
        del row, kmer
        key = distinct(key)
        size = np.bincount(key % self.n, minlength=self.n)
        rank = np.empty(self.n, np.int64)
        rank[sorted(range(self.n), key=ids.__getitem__)] = np.arange(self.n)
        self.place = np.lexsort((rank, size))
        number = np.empty(self.n, np.int64)
        number[self.place] = np.arange(self.n)
        self.size, self.rank = size[self.place], rank[self.place]
        self.by_id = np.argsort(self.rank)
        key += number[key % self.n] - key % self.n
        key.sort()  # by k-mer, then by set
        self.key, self.sets = key, (key % self.n).astype(np.int32)
        self.begin = np.searchsorted(key, np.arange(len(self.kmers) + 1) * self.n)  # where the list of each k-mer begins
        by_set = self.sets * np.int64(many) + key // self.n
        by_set.sort()
        self.codes, self.first = (by_set % many).astype(np.int32), np.cumsum(self.size) - self.size
        del by_set
        self.bits = signatures(self.first, self.size, self.codes)

class Batch:
    """Queries' k-mers that a lane has, of each query the rarest first."""

    def __init__(self, lane: Lane, texts: list[str]):
        self.n, self.width = len(texts), max(len(lane.kmers), 1)
        row, kmer = kmers_of(texts, lane.letters, lane.k)
        every, code = np.unique(kmer, return_inverse=True)
        row, code = np.divmod(np.unique(row * max(len(every), 1) + code), max(len(every), 1))
        self.size = np.bincount(row, minlength=self.n)
        at = np.minimum(np.searchsorted(lane.kmers, every), self.width - 1)
        have = lane.kmers[at] == every if len(lane.kmers) else np.zeros(len(every), bool)
        row, code = row[have[code]], at[code[have[code]]]
        self.keys = row * self.width + code  # ascend, as both unique() go by letters
        length = lane.begin[code + 1] - lane.begin[code]
        order = np.lexsort((code, length, row))
        self.code, self.length = code[order], length[order]
        known = np.bincount(row, minlength=self.n)
        self.stop = np.cumsum(known)
        self.start = self.stop - known
        self.bits = signatures(self.start, known, self.keys % self.width)
        self.lacking = self.size - known  # of k-mers that the lane lacks: the rarest of all
        self.before = np.concatenate([[0], np.cumsum(self.length)])


class Search:
    """The `top` nearest sets of a lane for the queries of a batch: `best` has them (-1: none), `common` how many k-mers are shared, a row for each query."""

    def __init__(self, lane: Lane, batch: Batch, top: int):
        self.lane, self.batch, self.top = lane, batch, top
        self.best = np.full((batch.n, top), -1, np.int64)
        self.common = np.zeros((batch.n, top), np.int64)
        self.run()
        self.fill()

    def limit(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shared k-mers and size of the union of the farthest that is found, 0 and 1 where there are too few."""
        r, s = self.best[q, -1], self.common[q, -1]
        return np.where(r < 0, 0, s), np.where(r < 0, 1, self.batch.size[q] + self.lane.size[r] - s)

    def run(self) -> None:
        lane, batch = self.lane, self.batch
        mean = len(lane.sets) / lane.n
        every = batch.before[batch.stop] - batch.before[batch.start]  # postings of a query
        at, budget = batch.start.copy(), FIRST
        active = np.flatnonzero(at < batch.stop)
        while len(active):
            end = np.searchsorted(batch.before, batch.before[at[active]] + budget, "right") - 1
            end = np.minimum(np.maximum(end, at[active] + 1), batch.stop[active])
            asked = batch.before[end] - batch.before[at[active]]
            # that many sets would have their k-mers counted, if no signature spoke against them
            long = (asked * mean > every[active] + lane.n) & (asked > lane.n // 8)
            for q in active[long]:
                self.count_all(q)
            active, end = active[~long], end[~long]
            for s, e in cuts(asked[~long], PAIRS):
                self.read(active[s:e], at[active[s:e]], end[s:e])
            at[active] = end
            active = active[end < batch.stop[active]]
            if len(active):
                low, high = self.sizes(active, at[active])
                active = active[(low <= high) & (low <= lane.size[-1]) & (high >= lane.size[0])]
            budget *= MORE

    def sizes(self, q: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest size of a set that has none of a query's k-mers before this one and may yet be as near as the farthest that is found."""
        n, (s, u) = self.batch.size[q], self.limit(q)
        most = self.most(q, token)
        found = s > 0
        high = np.where(found, most * u // np.maximum(s, 1) + most - n, self.lane.size[-1])
        return np.where(found, -(-s * n // u), 0), high

    def most(self, q: np.ndarray, token: np.ndarray) -> np.ndarray:
        """How many k-mers a set shares at most that has none before this one."""
        return self.batch.size[q] - self.batch.lacking[q] - (token - self.batch.start[q])

    def read(self, q: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Takes in the sets of the lists from start to end of these queries."""
        lane, batch = self.lane, self.batch
        token = flat_of(start, end - start)
        q = np.repeat(q, end - start)
        low, high = self.sizes(q, token)
        code = batch.code[token]
        begin, stop = lane.begin[code], lane.begin[code + 1]
        for cut, to, size, out in ((low > lane.size[0], low, "left", begin), (high < lane.size[-1], high, "right", stop)):
            i = np.flatnonzero(cut)
            out[i] = np.searchsorted(lane.key, code[i] * lane.n + np.searchsorted(lane.size, to[i], size))
        number = np.maximum(stop - begin, 0)
        for s, e in cuts(number, PAIRS):
            r = lane.sets[flat_of(begin[s:e], number[s:e])]
            each = np.repeat(np.arange(s, e), number[s:e])
            own = q[each]
            # no more can be shared than either set has besides the bits that the other lacks; what has a k-mer of an earlier list was looked at there
            more, other = (sum(np.bitwise_count(x[i] & ~y[j]).astype(np.int32) for x, y in zip(a, b, strict=True)) for a, i, b, j in ((batch.bits, own, lane.bits, r), (lane.bits, r, batch.bits, own)))
            shared = np.minimum(np.minimum(batch.size[own] - batch.lacking[own] - more, lane.size[r] - other), self.most(own, token[each]))
            near = self.near(own, r, shared)
            self.take(*np.divmod(np.unique(own[near] * lane.n + r[near]), lane.n))

    def near(self, q: np.ndarray, r: np.ndarray, shared: np.ndarray) -> np.ndarray:
        """Which pairs are as near as the farthest found, if they share so much."""
        s, u = self.limit(q)
        return shared * u >= s * (self.batch.size[q] + self.lane.size[r] - shared)

    def take(self, q: np.ndarray, r: np.ndarray) -> None:
        """Counts the pairs (each once, by query) and keeps the nearest of each query."""
        size = self.lane.size[r]
        for s, e in cuts(size, PAIRS):
            own, sets, number = q[s:e], r[s:e], size[s:e]
            asked = np.repeat(own, number) * self.batch.width + self.lane.codes[flat_of(self.lane.first[sets], number)]
            hit = self.batch.keys[np.minimum(np.searchsorted(self.batch.keys, asked), len(self.batch.keys) - 1)] == asked
            ends = np.cumsum(number)
            total = np.concatenate([[0], np.cumsum(hit)])
            shared = total[ends] - total[ends - number]
            near = self.near(own, sets, shared)
            self.keep(own[near], sets[near], shared[near])

    def keep(self, q: np.ndarray, r: np.ndarray, shared: np.ndarray) -> None:
        if not len(q):
            return
        touched = np.unique(q)
        old = self.best[touched]
        has = old >= 0
        q = np.concatenate([np.repeat(touched, has.sum(axis=1)), q])
        r, shared = np.concatenate([old[has], r]), np.concatenate([self.common[touched][has], shared])
        _, once = np.unique(q * self.lane.n + r, return_index=True)
        q, r, shared = q[once], r[once], shared[once]
        order = np.lexsort((self.lane.rank[r], self.distance(q, r, shared), q))
        q, r, shared = q[order], r[order], shared[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        ahead = rank < self.top
        self.best[q[ahead], rank[ahead]], self.common[q[ahead], rank[ahead]] = r[ahead], shared[ahead]

    def distance(self, q: np.ndarray, r: np.ndarray, shared: np.ndarray) -> np.ndarray:
        n, m = self.batch.size[q], self.lane.size[r]
        return np.where((n == 0) | (m == 0), 1.0, 1.0 - shared / np.maximum(n + m - shared, 1))

    def count_all(self, q: int) -> None:
        """Counts what a query shares with every set."""
        lane, batch = self.lane, self.batch
        code = batch.code[batch.start[q] : batch.stop[q]]
        shared = np.bincount(lane.sets[flat_of(lane.begin[code], lane.begin[code + 1] - lane.begin[code])], minlength=lane.n)
        d = self.distance(np.full(1, q), np.arange(lane.n), shared)
        near = np.flatnonzero(d <= np.partition(d, min(self.top, lane.n) - 1)[min(self.top, lane.n) - 1])
        near = near[np.lexsort((lane.rank[near], d[near]))][: self.top]
        self.best[q, : len(near)], self.common[q, : len(near)] = near, shared[near]

    def fill(self) -> None:
        """Sets that share nothing come last, by id."""
        lowest = self.lane.by_id[: 2 * self.top]
        for q in np.flatnonzero(self.best[:, -1] < 0):
            have = self.best[q][self.best[q] >= 0]
            more = lowest[~np.isin(lowest, have)][: self.top - len(have)]
            self.best[q, len(have) : len(have) + len(more)] = more


def nearest(asked: list[str], ids: list, texts: list[str], k: int, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query, ref, d: for each of asked the places of its `top` nearest texts by Jaccard distance of k-mers, ties by id."""
    out: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    if not texts or not asked:
        return out[0]
    lane = Lane(ids, texts, letters_of(asked, texts), k)
    for s in range(0, len(asked), BATCH):
        batch = Batch(lane, asked[s : s + BATCH])
        found = Search(lane, batch, top)
        query, rank = np.nonzero(found.best >= 0)
        ref = found.best[query, rank]
        out.append((query + s, lane.place[ref], found.distance(query, ref, found.common[query, rank])))
    return tuple(map(np.concatenate, zip(*out, strict=True)))
