"""Problem 2: sentence boundaries across languages and scripts.

A linear-chain model tags the places where a sentence may end as boundary or
inside. Its emissions are log-odds of what stands left and right of the place,
trained without labels: the ends and beginnings of whole texts show what ends
and begins sentences, and expectation maximisation parts the places within
the texts. Thai, which writes no stops, is seen with its stops taken out.
Viterbi decoding keeps quoted speech in the sentence that frames it.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.arrow import map_rows

#: Closing marks that belong to the sentence before them.
CLOSERS = "\"'”’»)\\]）」』〉》】"
THAI, BURMESE, HAN = "฀-๿", "က-႟", "぀-ヿ㐀-鿿ー々〇"
#: Where a sentence may end: after stops and closing marks, at a space in Thai, at a line break.
PLACE = re.compile(
    rf"(?:[.!?…。！？။؟।]+(?:[\s  ]?[»”](?![^\s.,])|“(?=\s|$)|[{CLOSERS}])*|(?<=[”」』»])(?=\s|[^\W_])|(?<=[{THAI}ๆฯ\d)”\"a-zA-Z.])(?= +[“\"(]?[{THAI}A-Za-z])|(?=\n))(\s*)"
)
QUOTE = re.compile("[“”„«»「」『』（）()\"]")
PAIRS = {"“": "”", "«": "»", "「": "」", "『": "』", "(": ")", "（": "）", "„": "“"}
#: What stands left of a place: the last word with its stops, or the last letters of scripts without word spaces.
LEFT = re.compile(rf"(?:[{THAI}]{{1,5}}|[{BURMESE}]{{1,6}}|[{HAN}]{{1,3}}|[^\W{THAI}{BURMESE}{HAN}][\w.'’-]*|\d[\d.,:]*)?[^\w\s]*$")
RIGHT = re.compile(rf"[“«„\"「『(（¿¡]|[{THAI}]{{1,4}}|[{BURMESE}]{{1,5}}|[{HAN}]{{1,2}}|[^\W\d{THAI}{BURMESE}{HAN}]+|\d+")
DIGITS = re.compile(r"\d+")
KINDS = (("th", re.compile(f"[{THAI}]")), ("my", re.compile(f"[{BURMESE}]")), ("cj", re.compile(f"[{HAN}]")))


def kind_of(text: str) -> str:
    """The writing of a stretch, each of which has a chain of its own."""
    if not text.isascii():
        for k, rx in KINDS:
            if rx.search(text):
                return k
    return "la"


SURE = re.compile(r"[!?。！？။؟।]+[^\w\s]*$|[.…]+ ?[”»“\"』」]+$|[”»“\"]+[.…]+$|[”»」』]+$")


STOPS = ".!?…。！？။؟।\"'”“’»)]）」』〉》】"

#: Stops after a Thai letter, which the features don't see.
THAI_STOP = re.compile(rf"(?<=[{THAI}])[.!?…。！？]+(?=[^\w\s]*$)")


def left_of(text: str) -> str:
    """The left feature, in training and decoding: a short word also has the class of what stands before it; Thai has no stops."""
    if not text.isascii():
        text = THAI_STOP.sub("", text)
    m = LEFT.search(text)
    x = DIGITS.sub("0", m.group())
    sure = SURE.search(x)
    if sure:  # the stop says enough; which word it follows would only thin the counts
        return sure.group()
    if len(x) <= 4:
        before = text[: m.start()].rstrip()[-1:]
        x = ("0 " if before.isdigit() else "w " if before.isalpha() else "s " if not before or before in STOPS else "") + x
    return x


class Place:
    """A candidate: where the sentence would end and the next begin, its features, and whether it is ruled out."""

    __slots__ = ("end", "start", "left", "right", "gap", "shut", "opens", "kind", "then", "dist")

    def __init__(self, end, start, left, right, gap, shut, opens, kind, then):
        self.end, self.start, self.left, self.right, self.gap, self.shut, self.opens = end, start, left, right, gap, shut, opens
        self.kind, self.then = kind, then  # the writing before and after
        self.dist = 0  # characters since the last place that isn't shut, or the text's beginning


def spans_of_quotes(text: str) -> list[tuple[int, int]]:
    """(opening, closing) positions of outermost quotations and brackets; one left open runs to the end."""
    stack: list[tuple[str, int]] = []
    out: list[tuple[int, int]] = []
    for m in QUOTE.finditer(text):
        c, p = m.group(), m.start()
        if stack and c == stack[-1][0]:
            _, a = stack.pop()
            if not stack:
                out.append((a, p))
        elif c == '"':
            stack.append(('"', p))
        elif c in PAIRS:
            stack.append((PAIRS[c], p))
    if stack and text[stack[0][1]] not in '("（':
        out.append((stack[0][1], len(text)))
    return out


NAME = re.compile(rf"[A-Z][A-Za-z]+( ?[{THAI}]{{1,3}}| ?[{BURMESE}]{{1,3}}| ?[{HAN}]{{1,2}})")


def right_of(text: str, at: int) -> str:
    """The right feature; a name in Latin letters counts by the other script's letters that follow it."""
    name = NAME.match(text, at)
    if name:
        return "A" + name.group(1)
    r = RIGHT.match(text, at)
    return DIGITS.sub("0", r.group()) if r else text[at]


def places(text: str) -> list[Place]:
    """The candidates of a text, in order."""
    out: list[Place] = []
    quotes = spans_of_quotes(text)
    q, n = 0, len(text)
    thai = bool(re.search(f"[{THAI}]", text))
    last = -1
    for m in PLACE.finditer(text):
        e, s = m.start(1), m.end()
        if e == last or e == 0:
            continue
        if s >= n or not text[:e].strip():
            break
        c = text[s]
        stop = text[e - 1]
        gap = "\n" if "\n" in m.group(1) else " " if m.group(1) else ""
        if stop not in STOPS and gap != "\n" and not thai:
            continue
        if gap != "\n" and (c.islower() or c in "(（[,;:、，；：၊-–—.…!?。！？။"):
            continue
        if not gap and (c.isdigit() or stop == "." and not (c.isupper() or ord(c) > 0x0E00 or c in "¿¡«“„") or stop in "'’)" and c.isascii()):
            continue
        while q < len(quotes) and quotes[q][1] < e - 1 and quotes[q][1] < e:
            # the quote closes before this place unless it is among the closing marks
            if quotes[q][1] >= m.start():
                break
            q += 1
        inside = q < len(quotes) and quotes[q][0] < e and quotes[q][1] >= e
        after = None
        if q < len(quotes) and quotes[q][0] < e and not inside and quotes[q][1] >= min(m.start(), e - 1) and text[quotes[q][0]] not in "(（":
            after = quotes[q][0]
        elif m.start(1) == m.start() and q and quotes[q - 1][1] == e - 1 and text[quotes[q - 1][0]] not in "(（":
            after = quotes[q - 1][0]
        kind, then = kind_of(text[max(0, e - 40) : e]), kind_of(text[s : s + 14])
        if stop not in STOPS and gap != "\n" and "th" not in (kind, then):
            continue
        glued = out[-1].start if out and not out[-1].gap and stop in STOPS else 0  # the word of a place may not run over one without a space
        left, right = left_of(text[max(glued, e - 32) : e]), right_of(text, s)
        last = e
        out.append(Place(e, s, left, right, gap, inside, after, kind, then))
    return out


def open_places(text: str) -> list[Place]:
    """The candidates outside quotations, each with its distance from the one before."""
    out = [p for p in places(text) if not p.shut]
    at = len(text) - len(text.lstrip())
    for p in out:
        p.dist = p.end - at
        at = p.start
    return out


#: Upper ends of the classes of distance, in characters.
DISTANCES = (3, 8)


def ends(text: str) -> tuple[str, str] | None:
    """What ends and what begins a whole text."""
    t = text.strip()
    if not t:
        return None
    return left_of(t[-32:]), right_of(t, 0)


def shape(left: str) -> str:
    """The class of a left context, for those too rare to know."""
    first = "s" if left.startswith("s ") else ""  # a short word that would be a sentence
    left = left.removeprefix("0 ").removeprefix("w ").removeprefix("s ")
    word = left.rstrip("".join(CLOSERS) + ".!?…。！？။") or left
    tail = left[len(word) :]
    stop = next((c for c in tail if c in ".!?…。！？။"), " ")
    if len(tail) - len(tail.lstrip(".")) > 1:
        stop = "…"
    kind = "0" if word[-1:].isdigit() else "A" if len(word) == 1 and word.isupper() else "a" if len(word) <= 3 and word.isascii() else "w"
    return f"{first}{kind}{stop}"


class Chain:
    """Emission log-odds of one writing, and the transition weights from boundary to boundary by distance.

    Texts without a candidate inside are sentences: how long they are, against
    how far apart candidates are, weighs a boundary right after a boundary.
    """

    #: Rounds of expectation maximisation, steps in each, and the share of texts from which an edge counts.
    ROUNDS, STEPS, FEW = 5, 60, 2e-5

    def __init__(self, left: dict[str, float], right: dict[str, float], shapes: dict[str, float], gaps: dict[str, float], next_: list[float] | None = None):
        self.left, self.right, self.shapes, self.gaps = left, right, shapes, gaps
        self.next = next_ or [0.0] * (len(DISTANCES) + 1)

    def transition(self, dist: int) -> float:
        """Weight of a boundary ``dist`` characters after a boundary."""
        return self.next[bisect_left(DISTANCES, dist)]

    @staticmethod
    def transitions(single: list[int], dists: list[int]) -> list[float]:
        """Log ratios of lengths of whole sentences to distances of candidates, by class; never over 0."""
        k = len(DISTANCES) + 1
        a = np.bincount([bisect_left(DISTANCES, n) for n in single], minlength=k) + 0.5
        b = np.bincount([bisect_left(DISTANCES, n) for n in dists], minlength=k) + 0.5
        return np.minimum(0.0, np.log(a / a.sum()) - np.log(b / b.sum())).tolist()

    def before(self, p: Place) -> float:
        a = self.left.get(p.left)
        if a is None:
            a = self.shapes.get(shape(p.left), 0.0)
        return a + self.gaps.get(p.gap, 0.0)

    def after(self, p: Place) -> float:
        return self.right.get(p.right, -1.0 if p.right[:1].isdigit() else 0.0)

    @classmethod
    def train(cls, cand: list[Place], e_left: Counter, e_right: Counter, single: list[int]) -> Chain:
        """Expectation maximisation over candidates, with the ends and beginnings of texts as known boundaries."""
        if not cand:
            return cls({}, {}, {}, {})
        li = {x: i for i, x in enumerate(dict.fromkeys([p.left for p in cand] + list(e_left)))}
        ri = {x: i for i, x in enumerate(dict.fromkeys([p.right for p in cand] + list(e_right)))}
        gi = {x: i for i, x in enumerate(("", " ", "\n"))}
        names = [shape(x) for x in li]
        si = {x: i for i, x in enumerate(dict.fromkeys(names))}
        of_left = np.array([si[x] for x in names])
        L, R, G = (np.array([ix[getattr(p, k)] for p in cand]) for ix, k in ((li, "left"), (ri, "right"), (gi, "gap")))
        eL, eR = np.zeros(len(li)), np.zeros(len(ri))
        for x, n in e_left.items():
            eL[li[x]] = n
        for x, n in e_right.items():
            eR[ri[x]] = n
        # to begin with, a place is a boundary if its left ends texts and its right begins them
        known_l, known_r = eL[L] > cls.FEW * eL.sum(), eR[R] > cls.FEW * eR.sum()
        post = np.where(known_l & known_r, 0.95, np.where(known_l | known_r, 0.15, 0.02))
        weights = [np.zeros(len(x)) for x in (li, ri, gi, si)]
        of_place = of_left[L]
        size = [np.bincount(i, minlength=len(w)) + e for i, w, e in zip((L, R, G, of_place), weights, (eL, eR, 0, 0))]
        for _ in range(cls.ROUNDS):
            for _ in range(cls.STEPS):
                # a Newton-like step for each weight by itself, damped because four share a place
                z = weights[0][L] + weights[1][R] + weights[2][G] + weights[3][of_place]
                err = post - 1 / (1 + np.exp(-z))
                grads = [np.bincount(i, err, len(w)) for i, w in zip((L, R, G, of_place), weights)]
                grads[0] += eL / (1 + np.exp(weights[0] + weights[3][of_left]))
                grads[1] += eR / (1 + np.exp(weights[1]))
                for w, g, n, ridge in zip(weights, grads, size, (0.3, 0.3, 0.01, 0.01)):
                    w += (g - ridge * w) / (0.25 * n + ridge + 1) * 0.5
            z = weights[0][L] + weights[1][R] + weights[2][G] + weights[3][of_place]
            post = 1 / (1 + np.exp(-np.clip(1.5 * z, -30, 30)))
        full = weights[0] + weights[3][of_left]
        return cls(dict(zip(li, full)), dict(zip(ri, weights[1])), dict(zip(si, weights[3])), dict(zip(gi, weights[2])), cls.transitions(single, [p.dist for p in cand]))


class Model:
    """A chain for each writing."""

    def __init__(self, chains: dict[str, Chain]):
        self.chains = chains

    def odds(self, p: Place) -> float:
        a, b = self.chains.get(p.kind), self.chains.get(p.then)
        return (a.before(p) if a else 0.0) + (b.after(p) if b else 0.0)

    def transition(self, p: Place) -> float:
        chain = self.chains.get(p.kind)
        return chain.transition(p.dist) if chain else 0.0

    @classmethod
    def train(cls, texts: list[str]) -> Model:
        cand: dict[str, list[Place]] = {}
        lefts: dict[str, Counter] = {}
        rights: dict[str, Counter] = {}
        single: dict[str, list[int]] = {}
        for t in texts:
            got = ends(t)
            if got:
                t_ = t.strip()
                lefts.setdefault(kind_of(t_[-40:]), Counter())[got[0]] += 1
                rights.setdefault(kind_of(t_[:14]), Counter())[got[1]] += 1
            inner = open_places(t)
            if got and not inner:
                single.setdefault(kind_of(t_[:14]), []).append(len(t_))
            for p in inner:
                if p.kind == p.then:
                    cand.setdefault(p.kind, []).append(p)
        return cls({k: Chain.train(v, lefts.get(k, Counter()), rights.get(k, Counter()), single.get(k, [])) for k, v in cand.items()})


def viterbi(text: str, model: Model) -> list[tuple[int, int]]:
    """Ranges of the sentences of a text."""
    n = len(text)
    first = n - len(text.lstrip())
    if first >= n:
        return []
    cand = open_places(text)
    # score of the best path that has the place inside or as a boundary, and the path's last boundary
    inside, bound = -math.inf, 0.0
    at = first
    back: list[tuple[bool, bool]] = []
    for p in cand:
        s = model.odds(p)
        # a quotation that opens the sentence is framed by what follows
        framed = p.opens is not None and p.opens == at
        b_from_b = -math.inf if framed else bound + model.transition(p)
        to_in, to_b = max(inside, bound), max(inside, b_from_b) + s
        back.append((bound > inside, b_from_b > inside))
        inside, bound = to_in, to_b
        at = p.start
    state = bound > inside
    cuts = []
    for p, (in_from_b, b_from_b) in zip(reversed(cand), reversed(back)):
        if state:
            cuts.append(p)
        state = b_from_b if state else in_from_b
    out, a = [], first
    for p in reversed(cuts):
        if text[a : p.end].strip():
            out.append((a, p.end))
            a = p.start
    end = len(text.rstrip())
    if a < end:
        out.append((a, end))
    return out


#: Bound of the training sample, in texts in the mean: a hash of the block's id chooses them.
SAMPLE_TEXTS = 24_000


def train(blocks: DataFrame) -> Model:
    """A model from at most about SAMPLE_TEXTS texts of paragraphs and quotes. Runs a count and a bounded collect."""
    n = blocks.count()
    rows = (
        blocks.where(F.pmod(F.xxhash64("block_id"), F.lit(max(1, n * 2 // SAMPLE_TEXTS))) == 0)
        .where("kind IN ('paragraph', 'quote')")
        .select("block_id", "source_text", "translated_text")
        .collect()
    )
    return Model.train(sorted({t for _, a, b in rows for t in (a, b) if t and "-\n" not in t}))


def split_sentences(texts: DataFrame, model: Model) -> DataFrame:
    """(block_id, side, start_pos, end_pos): the sentences of each text, in code points, the end exclusive.

    texts: block_id, source_text, translated_text. Null texts and texts
    without visible characters give no row; every other text gives at least
    one. Repeated rows give repeated results. There is no shuffle.
    """

    def make():
        memo: dict[str, list] = {}

        def spans(t):
            got = memo.get(t)
            if got is None:
                if len(memo) > 50_000:
                    memo.clear()
                got = memo[t] = viterbi(t, model)
            return got

        def kernel(block, source, translated):
            out = [[], [], [], []]
            for b, s, t in zip(block, source, translated):
                for side, x in (("source", s), ("translated", t)):
                    if x:
                        got = spans(x)
                        out[0] += [b] * len(got)
                        out[1] += [side] * len(got)
                        out[2] += [a for a, _ in got]
                        out[3] += [z for _, z in got]
            return out

        return kernel

    return map_rows(texts.select("block_id", "source_text", "translated_text"), "block_id string, side string, start_pos int, end_pos int", make)
