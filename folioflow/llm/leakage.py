"""Problem 9: evaluation texts leaking into training text.

Every batch of documents is a shard. Its words are numbered by the test
vocabulary and sorted into a suffix array by prefix doubling; each suffix of
each test item is looked up in it by binary search, which gives all places
that share at least ``seed`` words, and the longest verbatim match at each.
Matches on one diagonal, or nearly so, join into stretches. The test items are
numbered once a task; a shard's memory is bounded by its own size and by
SUFFIXES and PLACES, whatever the number of items.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.arrow import map_rows

#: A word, or one character of a script without word spaces.
WORD = re.compile(r"[぀-ヿ㐀-鿿฀-๿က-႟]|[^\W_぀-ヿ㐀-鿿฀-๿က-႟]+")
#: Invisible characters, dropped before words are cut.
INVISIBLE = re.compile("[­​-‏⁠️﻿]")

#: Documents of a shard at most.
SHARD = 4000

#: Test items handled at a time; the rest follow in further passes over the corpus.
BLOCK = 20_000


def words(text: str) -> list[str]:
    """Words in lower case, by compatibility forms, without invisible characters."""
    if not text.isascii():
        text = INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    return WORD.findall(text.lower())


def suffix_array(seq: np.ndarray, longest: int) -> np.ndarray:
    """The places of ``seq`` in the order of their suffixes, by prefix doubling.

    Negative entries are separators: each is a word of its own, so no suffix
    reaches across texts. Doubling ends when all suffixes differ, or when
    ``longest`` words are told apart, more than any suffix looked up has.
    """
    seq = seq.astype(np.int64)
    cuts = seq < 0
    first = seq.copy()
    first[cuts] = seq.max(initial=0) + 1 + np.arange(cuts.sum())
    kinds, rank = np.unique(first, return_inverse=True)
    n, h = len(seq), 1
    while h < longest and len(kinds) < n:
        ahead = np.full(n, -1, np.int64)
        ahead[: n - h] = rank[h:]
        kinds, rank = np.unique(rank * (n + 1) + ahead + 1, return_inverse=True)
        h *= 2
    return np.argsort(rank, kind="stable")


class Tests:
    """The test items, cut into words and numbered."""

    def __init__(self, items: list[tuple[int, str]], seed: int):
        self.ids = [i for i, _ in items]
        cut = [words(t or "") for _, t in items]
        vocabulary: dict[str, int] = {}
        for w in cut:
            for x in w:
                vocabulary.setdefault(x, len(vocabulary))
        self.vocabulary, self.seed = vocabulary, seed
        seq, item, pos = [], [], []
        for k, w in enumerate(cut):
            seq += [vocabulary[x] for x in w] + [-1]
            item += [k] * (len(w) + 1)
            pos += range(len(w) + 1)
        self.seq, self.item, self.pos = np.array(seq, np.int64), np.array(item, np.int64), np.array(pos, np.int64)
        self.length = np.array([len(w) for w in cut], np.int64)
        self.weight = [np.concatenate(([0], np.cumsum([len(x) for x in w]))) for w in cut]
        self.longest = int(self.length.max(initial=1))
        # suffixes that have seed words
        at = np.flatnonzero(self.seq >= 0)
        self.starts = at[self.pos[at] + seed <= self.length[self.item[at]]] if len(at) else at


#: Test suffixes searched, and pairs of places compared, at a time: the bound of a call's memory.
SUFFIXES, PLACES = 500_000, 2_000_000


def interval(train: np.ndarray, order: np.ndarray, tests: np.ndarray, q: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The ranges of the suffix array that begin with the ``depth`` words of ``tests`` at each of ``q``, by binary search for each word."""
    n = len(order)
    lo, hi = np.zeros(len(q), np.int64), np.full(len(q), n, np.int64)
    for k in range(depth):
        want = tests[q + k]

        def bound(right: bool):
            a, b = lo.copy(), hi.copy()
            while True:
                open_ = a < b
                if not open_.any():
                    return a
                mid = (a + b) >> 1
                at = order[np.minimum(mid, n - 1)] + k
                word = np.where(at < n, train[np.minimum(at, n - 1)], -1)
                # separators follow all words in the suffix order
                word = np.where(word < 0, np.iinfo(np.int64).max, word)
                down = word <= want if right else word < want
                a, b = np.where(open_ & down, mid + 1, a), np.where(open_ & ~down, mid, b)

        lo, hi = bound(False), bound(True)
    return lo, hi


def matches(texts: list[str | None], tests: Tests) -> list[np.ndarray]:
    """Maximal verbatim matches of at least ``seed`` words: columns document, place, item, place in it, words."""
    seq, doc, pos = [], [], []
    get = tests.vocabulary.get
    none = [np.empty(0, np.int64)] * 5
    for k, t in enumerate(texts):
        if not t:
            continue
        w = np.fromiter((get(x, -1) for x in words(t)), np.int64)
        if len(w) < tests.seed:
            continue
        # only runs of at least seed test words can hold a match
        known = np.concatenate(([0], (w >= 0).astype(np.int8), [0]))
        edge = np.flatnonzero(np.diff(known))
        for a, b in zip(edge[::2], edge[1::2]):
            if b - a >= tests.seed:
                seq.append(w[a:b]), seq.append([-1])
                doc.append(np.full(b - a + 1, k)), pos.append(np.arange(a, b + 1))
    if not seq or not len(tests.starts):
        return none
    train = np.concatenate(seq).astype(np.int64)
    doc, pos, n = np.concatenate(doc), np.concatenate(pos), len(train)
    order = suffix_array(train, tests.longest)
    found = []
    for a in range(0, len(tests.starts), SUFFIXES):
        some = tests.starts[a : a + SUFFIXES]
        lo, hi = interval(train, order, tests.seq, some, tests.seed)
        many = hi - lo
        some, lo, many = some[many > 0], lo[many > 0], many[many > 0]
        ends = np.cumsum(many)
        b = 0
        while b < len(some):
            # as many suffixes as have PLACES places, one at least
            e = max(b + 1, int(np.searchsorted(ends, (ends[b - 1] if b else 0) + PLACES, "right")))
            m = many[b:e]
            q = np.repeat(some[b:e], m)
            p = order[np.repeat(lo[b:e], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)]
            b = e
            # left-maximal matches only
            before_q = np.where(q > 0, tests.seq[q - 1], -1)
            before_p = np.where(p > 0, train[p - 1], -1)
            keep = (before_q < 0) | (before_p < 0) | (before_q != before_p)
            q, p = q[keep], p[keep]
            size = np.full(len(q), tests.seed, np.int64)
            live = np.arange(len(q))
            while len(live):
                x, y = p[live] + size[live], q[live] + size[live]
                same = (x < n) & (y < len(tests.seq))
                same &= train[np.minimum(x, n - 1)] == tests.seq[np.minimum(y, len(tests.seq) - 1)]
                same &= train[np.minimum(x, n - 1)] >= 0
                live = live[same]
                size[live] += 1
            found.append((doc[p], pos[p], tests.item[q], tests.pos[q], size))
    return [np.concatenate(c) for c in zip(*found)] if found else none


def stretches(place: np.ndarray, at: np.ndarray, size: np.ndarray, gap: int) -> list[tuple[int, int, int, int, int, int]]:
    """Matches of one document and item joined: (item start, item end, words matched, matches, document start, document end).

    A match joins the stretch that ends at most ``gap`` words before it on
    both sides, or overlaps its end on nearly the same diagonal.
    """
    out: list[list[int]] = []
    for i in np.lexsort((place, at)):
        a, p, n = int(at[i]), int(place[i]), int(size[i])
        best = None
        for s in out:
            da, dp = a - s[1], p - s[4]
            if -n < da <= gap and -n < dp <= gap and abs(da - dp) <= gap and a + n > s[1] and (best is None or abs(da - dp) < abs(a - best[1] - p + best[4])):
                best = s
        if best is None:
            out.append([a, a + n, n, 1, p + n, p])
        else:
            best[2] += a + n - max(a, best[1])
            best[1], best[4], best[3] = a + n, p + n, best[3] + 1
    return [(s[0], s[1], s[2], s[3], s[5], s[4]) for s in out]


def coverage(tests: Tests, item: int, parts: list[tuple[int, int, int, int, int, int]], least: int) -> tuple[float, int, int, int, int]:
    """(share of the item's characters in stretches, longest stretch in words, stretches that count, the longest's first word in the document, and its end).

    A stretch counts from ``least`` words on, single characters half, and only
    if most of its words are matched.
    """
    hit = np.zeros(int(tests.length[item]), bool)
    w = tests.weight[item]
    half = np.concatenate(([0], np.cumsum(np.where(np.diff(w) > 1, 1.0, 0.5))))
    longest = n = start = end = 0
    for a, b, matched, _, x, y in parts:
        if half[b] - half[a] >= least and matched * 2 >= b - a:
            hit[a:b] = True
            n += 1
            if b - a > longest:
                longest, start, end = b - a, x, y
    return float((np.diff(w) * hit).sum() / max(1, w[-1])), longest, n, start, end


def find_leaks(docs: DataFrame, items: DataFrame, share: float = 0.5, seed: int = 3, gap: int = 4, least: int = 10) -> DataFrame:
    """Documents that hold at least ``share`` of a test item: doc_id, item_id, share, longest, stretches, start_word, end_word.

    start_word and end_word are the place of the longest stretch in the
    document, in words from 0, the end exclusive. docs: doc_id, text; items: item_id, text. Case, compatibility forms,
    punctuation, spacing and invisible characters don't count; single changed
    words are bridged. The items are the stated query set: they are fetched to
    the driver in blocks of ``BLOCK`` ordered by item_id, every block is
    matched against every document, and documents are never gathered. Null and
    empty texts and items give no row; repeated rows of one document or item
    come once; empty tables give no row.
    """
    query = items.where("text IS NOT NULL AND item_id IS NOT NULL").groupBy("item_id").agg(F.min("text").alias("text")).orderBy("item_id")
    found, block = None, []

    def search(block):
        made = []

        def make():
            if not made:
                made.append(Tests(block, seed))
            tests = made[0]

            def kernel(ids, texts):
                d, p, i, a, n = matches(texts, tests)
                out = [[] for _ in range(7)]
                if len(d):
                    group = d * len(tests.ids) + i
                    order = np.argsort(group, kind="stable")
                    group = group[order]
                    edges = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1))
                    # exact bounds: what stretches cover lies between the first and the last match, and has twice the matched words at most
                    first, last = np.minimum.reduceat(a[order], edges), np.maximum.reduceat((a + n)[order], edges)
                    matched = np.add.reduceat(n[order], edges)
                    ends = np.append(edges[1:], len(order))
                    for e0, e1, lo, hi, m in zip(edges, ends, first, last, matched):
                        part = order[e0:e1]
                        item = int(i[part[0]])
                        w = tests.weight[item]
                        if m * 2 < least or w[hi] - w[lo] < share * w[-1]:
                            continue
                        s, longest, k, x, y = coverage(tests, item, stretches(p[part], a[part], n[part], gap), least)
                        if s >= share:
                            for col, v in zip(out, (ids[int(d[part[0]])], tests.ids[item], s, longest, k, x, y)):
                                col.append(v)
                return out

            return kernel

        return map_rows(docs.select("doc_id", "text"), "doc_id bigint, item_id bigint, share double, longest int, stretches int, start_word int, end_word int", make, rows=SHARD)

    for row in query.toLocalIterator():
        block.append((row.item_id, row.text))
        if len(block) == BLOCK:
            part = search(block)
            found, block = part if found is None else found.union(part), []
    if block or found is None:
        part = search(block)
        found = part if found is None else found.union(part)
    best = F.max(F.struct("share", "longest", "stretches", "start_word", "end_word")).alias("x")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "x.*")


def remove_leaks(docs: DataFrame, leaks: DataFrame) -> DataFrame:
    """The documents without any leak; rows with a null doc_id stay."""
    return docs.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti")
