"""The units of a memory that are most similar to queries, group by group: a kernel over rows sorted so that a group's queries come first."""

from __future__ import annotations

from bisect import insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bounds are compared with this slack, so that rounding loses no match; the second where single precision is used.
SLACK, COARSE = 1e-9, 1e-5
#: Pairs of a text and a query that are looked at together.
PAIRS = 2_000_000
#: The words of most queries, counted by a matrix product; the others by their lists.
FREQUENT = 256
#: Counters of a text's bigrams by hash, a power of two: what two texts share there is never less than what they share.
BUCKETS = 128
#: Pairs whose bigrams are compared together.
COMPARED = 20_000
#: Characters whose bigrams are numbered together, and entries of words' lists that are looked at together.
STEP = 2_000_000


def ragged(start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the places of all stretches, one after the other; where each stretch begins in that)."""
    at = np.cumsum(length) - length
    return np.arange(int(length.sum())) + np.repeat(start - at, length), at


def stretches(length: np.ndarray) -> list[np.ndarray]:
    """The places of all, in stretches of lengths that come to about STEP."""
    done = np.cumsum(length)
    cuts = np.unique(np.searchsorted(done, np.arange(STEP, int(done[-1]) if len(done) else 0, STEP), side="right"))
    return [x for x in np.split(np.arange(len(length)), cuts) if len(x)]


def occurrence(owner: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, code, how many like it came before) sorted by owner and code: with occurrences apart, a multiset is a set."""
    key = np.sort(owner.astype(np.int64) << 32 | code.astype(np.int64))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    before = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
    return key >> 32, key & 0xFFFFFFFF, before


def split(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """(the words of all texts, the text that each is in); words are parted by blanks."""
    lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    words, owner = lists.flatten(), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    full = pc.not_equal(words, "")
    return words.filter(full), owner[full.to_numpy(zero_copy_only=False)]


def bigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(a number for each pair of neighbouring characters of all texts, how many each text has); a single character stands for itself."""
    size = np.array([len(t) for t in texts])
    x = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    both = np.empty_like(x)
    both[:-1] = (x[:-1] + np.uint64(1)) << np.uint64(32) | x[1:]
    last = np.cumsum(size) - 1
    alone = last[size == 1]
    both[alone] = x[alone]
    keep = np.ones(len(x), bool)
    keep[last[size > 1]] = False
    return both[keep], np.maximum(1, size - 1)


def buckets(pairs: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Bigrams of each text by hash, one row a text."""
    to = (pairs * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(57)).astype(np.int64) % BUCKETS
    count = np.bincount(np.repeat(np.arange(len(n)) * BUCKETS, n) + to, minlength=len(n) * BUCKETS).reshape(len(n), BUCKETS)
    return count.astype(np.uint8 if count.max() < 1 << 8 else np.uint16 if count.max() < 1 << 16 else np.int64)


class Asked:
    """The queries of a group, indexed by word, and the best units found for each so far.

    Only pairs that share a word can score over one half. Each pair whose
    numbers of words and characters let it reach the query's bound is counted
    by words; those that still may are counted by buckets of bigrams, then
    exactly. The bound is ``least``, or the score of the query's last of
    ``k`` + 1 units (one may be the query's own).
    """

    def __init__(self, texts: dict[str, list[str]], least: float, k: int):
        own = sorted(texts, key=len)
        self.ids, self.least, self.most = [texts[t] for t in own], least, k + 1
        many = len(own)
        words, owner = split(own)
        coded = words.dictionary_encode()
        self.words = coded.dictionary
        owner, code, before = occurrence(owner, coded.indices.to_numpy(zero_copy_only=False))
        self.n_words = np.bincount(owner, minlength=many)
        # occurrence b of word c is number first[c] + b
        self.kinds = np.zeros(len(self.words), np.int64)
        np.maximum.at(self.kinds, code, before + 1)
        self.first = np.cumsum(self.kinds) - self.kinds
        flat = self.first[code] + before
        count = np.bincount(flat, minlength=int(self.kinds.sum()))
        self.place = np.empty(len(count), np.int64)
        self.place[np.argsort(-count, kind="stable")] = np.arange(len(count))
        flat, self.frequent = self.place[flat], min(FREQUENT, len(count))
        often = flat < self.frequent
        self.matrix = np.zeros((many, self.frequent), np.float32)
        self.matrix[owner[often], flat[often]] = 1
        flat, owner = flat[~often] - self.frequent, owner[~often]
        self.with_word = owner[np.argsort(flat, kind="stable")]
        self.word_n = np.bincount(flat, minlength=len(count) - self.frequent)
        self.word_at = np.cumsum(self.word_n) - self.word_n
        parts = [self._pairs([own[i] for i in x]) for x in stretches(np.array([len(t) for t in own]))]
        self.n_pairs, self.buckets, pair, self.pair_count, self.pair_n = (np.concatenate(x) for x in zip(*parts))
        self.pair, code = np.unique(pair, return_inverse=True)
        self.pair_id = code.astype(np.int32)
        self.pair_at = np.cumsum(self.pair_n) - self.pair_n
        self.best: list[list[tuple[float, str]]] = [[] for _ in own]
        self.bound = np.full(many, least)

    @staticmethod
    def _pairs(texts: list[str]) -> tuple[np.ndarray, ...]:
        """Bigrams of each text, their buckets, the different ones text by text, how often they occur there, and how many a text has."""
        pairs, n = bigrams(texts)
        kinds, code = np.unique(pairs, return_inverse=True)
        owner, code, before = occurrence(np.repeat(np.arange(len(n)), n), code)
        end = np.append(before[1:] == 0, True)  # the last of its kind has the count
        return n, buckets(pairs, n), kinds[code[end]], (before[end] + 1).astype(np.int32), np.bincount(owner[end], minlength=len(n))

    def meet(self, memory: dict[str, list[str]]) -> None:
        """Take the units of a memory into the best; memory: ids by text, the first k + 1 of each."""
        texts, step = sorted(memory, key=len), max(1, PAIRS // len(self.ids))
        for i in range(0, len(texts), step):
            self._meet(texts[i : i + step], memory)

    def found(self) -> list[tuple[str, str, float, int]]:
        """(query, unit, score, rank) of the best k units of each query but itself."""
        return [(q, u, -s, r + 1) for ids, best in zip(self.ids, self.best) for q in ids for r, (s, u) in enumerate([x for x in best if x[1] != q][: self.most - 1])]

    def _meet(self, texts: list[str], memory: dict[str, list[str]]) -> None:
        words, row = split(texts)
        n, size = np.bincount(row, minlength=len(texts)), np.array([max(1, len(t) - 1) for t in texts])
        # the queries that a text of these lengths can reach
        def near(x, y):
            z = np.clip(x, y.min(), y.max())
            return np.minimum(x, z) / (x + z)

        some = np.flatnonzero(near(self.n_words, n) + near(self.n_pairs, size) >= self.bound - SLACK)
        if not len(some):
            return
        code = pc.index_in(words, value_set=self.words)
        known = code.is_valid().to_numpy(zero_copy_only=False)
        row, code, before = occurrence(row[known], code.drop_null().to_numpy(zero_copy_only=False))
        has = before < self.kinds[code]
        row, number = row[has], self.place[self.first[code[has]] + before[has]]
        often = number < self.frequent
        matrix = np.zeros((len(texts), self.frequent), np.float32)
        matrix[row[often], number[often]] = 1
        common = matrix @ (self.matrix if len(some) == len(self.ids) else self.matrix[some]).T
        row, number = row[~often], number[~often] - self.frequent
        place = np.full(len(self.ids), -1)
        place[some] = np.arange(len(some))
        for x in stretches(self.word_n[number]):
            at, _ = ragged(self.word_at[number[x]], self.word_n[number[x]])
            of, to = np.repeat(row[x], self.word_n[number[x]]), place[self.with_word[at]]
            np.add.at(common.reshape(-1), of[to >= 0] * len(some) + to[to >= 0], np.float32(1))

        f = np.float32
        reach = np.minimum(size[:, None].astype(f), self.n_pairs[some].astype(f))
        reach /= size[:, None].astype(f) + self.n_pairs[some].astype(f)
        reach += common / (n[:, None].astype(f) + self.n_words[some].astype(f))
        at = np.flatnonzero(reach >= (self.bound[some] - COARSE).astype(f))
        r, q = at // len(some), some[at % len(some)]
        if not len(r):
            return
        share = 2.0 * common.reshape(-1)[at].astype(np.int64) / (self.n_words[q] + n[r])
        pairs, n_pairs = bigrams(texts)
        mine = buckets(pairs, n_pairs)
        both = np.concatenate([np.minimum(mine[r[i : i + COMPARED]], self.buckets[q[i : i + COMPARED]]).sum(1, dtype=np.int64) for i in range(0, len(r), COMPARED)])
        may = share + 2.0 * both / (self.n_pairs[q] + size[r]) >= 2 * self.bound[q] - SLACK
        r, q, share = r[may], q[may], share[may]
        if not len(r):
            return
        score = 0.5 * share + 0.5 * (2.0 * self._common_pairs(pairs, n_pairs, r, q) / (self.n_pairs[q] + size[r]))
        enough = score >= self.bound[q]
        r, q, score = r[enough], q[enough], score[enough]
        # a text scores no less than the last that a query needs of these
        order = np.lexsort((-score, q))
        r, q, score = r[order], q[order], score[order]
        begin = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
        length = np.diff(np.append(begin, len(q)))
        last = score[begin + np.minimum(length, self.most) - 1]
        top = score >= np.repeat(last, length)
        for k, to, s in zip(r[top].tolist(), q[top].tolist(), score[top].tolist()):
            self._enter(to, s, memory[texts[k]])

    def _common_pairs(self, pairs: np.ndarray, n_pairs: np.ndarray, r: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Bigrams that text r and query q share, for each two of them; r ascends."""
        rows, r = np.unique(r, return_inverse=True)
        of, _ = ragged((np.cumsum(n_pairs) - n_pairs)[rows], n_pairs[rows])
        mine, owner = pairs[of], np.repeat(np.arange(len(rows)), n_pairs[rows])
        at = np.searchsorted(self.pair, mine)
        at[at == len(self.pair)] = 0
        same = self.pair[at] == mine
        at, owner, many, out = at[same], owner[same], len(self.pair), []
        # texts whose counters are held together, and pairs that are compared together
        step = max(1, 4 * PAIRS // many)
        for low in range(0, len(rows), step):
            x, y = np.searchsorted(owner, [low, low + step])
            count = np.bincount((owner[x:y] - low) * many + at[x:y], minlength=min(step, len(rows) - low) * many).astype(np.int32)
            x, y = np.searchsorted(r, [low, low + step])
            for i in range(x, y, COMPARED):
                one, two = r[i : min(y, i + COMPARED)] - low, q[i : min(y, i + COMPARED)]
                of, begin = ragged(self.pair_at[two], self.pair_n[two])
                out.append(np.add.reduceat(np.minimum(self.pair_count[of], count[np.repeat(one * many, self.pair_n[two]) + self.pair_id[of]]), begin))
        return np.concatenate(out)

    def _enter(self, q: int, score: float, units: list[str]) -> None:
        best = self.best[q]
        for u in units:
            if len(best) < self.most or (-score, u) < best[-1]:
                insort(best, (-score, u))
                del best[self.most :]
        if len(best) == self.most:
            self.bound[q] = max(self.least, -best[-1][0])


def kernel(least: float, k: int):
    """A kernel for map_rows: (query_id, match_id, score, rank) of rows (project, target, slice, whether it asks, whether in the memory, text, id), sorted by the first four, what asks first.

    State is kept from batch to batch, the queries of one slice of a group at
    a time; the best of a slice come out at its end.
    """
    group, asked, waiting, memory, found = None, None, {}, {}, []

    def work():
        nonlocal asked
        if waiting:
            asked = asked or Asked(waiting, least, k)
            if memory:
                asked.meet(memory)
        memory.clear()

    def end():
        nonlocal asked
        work()
        if asked:
            found.extend(asked.found())
        asked = None
        waiting.clear()

    def out():
        made = [list(c) for c in zip(*found)] if found else [[], [], [], []]
        found.clear()
        return made

    def run(projects, targets, slices, asks, stored, texts, ids):
        nonlocal group
        for key, a, s, t, i in zip(zip(projects, targets, slices), asks, stored, texts, ids):
            if key != group:
                end()
                group = key
            if not t:
                continue
            if a:
                waiting.setdefault(t, []).append(i)
            if s and len(own := memory.setdefault(t, [])) <= k:
                own.append(i)
        if asked or not (asks and asks[-1]):  # else more queries may follow
            work()
        return out()

    def last():
        end()
        return out()

    run.last = last
    return run
