"""Problem 10: template residue and error-page text.

Character n-gram models of stand-in text, error pages and script notices stand
against one of the corpus's prose and one of prose that merely speaks of such
things; windows of a text (its sentences) whose likelihood ratio is high are
residue. A window whose words no model of the corpus's words expects, or that
only repeats itself, is stand-in text. Unfilled fields have a model of shapes
(delimiters around a name) and one of names. What a text shows as its subject,
in quotation marks, backticks or fenced code, is taken out of the windows first.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.arrow import map_rows
from folioflow.llm import ngrams
from folioflow.llm import residue_texts as made
from folioflow.tables import settle

KINDS = ("filler", "error_page", "script_notice")

#: Windows shorter than this prove nothing; bits of the hashed tables of prose and of the made-up texts; share of a kind's model in its mix with prose.
SHORTEST, PROSE_BITS, KIND_BITS, SHARE = 6, 20, 18, 0.9
#: A window is residue if its mean log ratio a character is over RATIO and leads that of the mentions by LEAD.
RATIO, LEAD = 0.35, 0.45
#: Least sum of the log ratio over the window.
EVIDENCE = 12.0
#: Invented words: a window of STRANGE_WORDS words at least is strange if its words lie STRANGE_SPELT deviations and its characters STRANGE_READ under
#: the medians of its script, and at most COMMON_SHARE of its words are common (COMMON of all words). Strengths of a text's strange windows must sum up to STRANGE.
STRANGE_WORDS, STRANGE_SPELT, STRANGE_READ, COMMON, COMMON_SHARE, STRANGE = 6, 4.0, 5.0, 1e-4, 0.25, 2.5
#: A window that repeats: at least REPEATS words, each REPEATS times in the mean.
REPEATS = 4

FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
SHOWN = re.compile(r"`[^`\n]*`|“[^”\n]*”|„[^“\n]*“|«\s[^»\n]*\s»|«[^»\n{}$<%\[]*\s[^»\n]*»|「[^」\n]*」|\"[^\"\n{}]*\"")
CUTS = re.compile(r"(?<=[.!?。！？။…])[\"”’)]*\s+|(?<=[。！？။])|\n+|\s\|\s|<[^<>\n]{1,40}>")
NUMBER = re.compile(r"\d+")
ADDRESS = re.compile(r"(?:https?://|www\.)\S+")
WORD = re.compile(r"[^\W\d_]{2,}")
SCRIPTS = (("th", re.compile("[฀-๿]")), ("my", re.compile("[က-႟]")), ("cj", re.compile("[぀-ヿ㐀-鿿]")), ("cy", re.compile("[Ѐ-ӿ]")))


def clean(text: str) -> str:
    return " ".join(NUMBER.sub("0", text.replace('"', " ").lower()).split())


def windows(text: str) -> list[str]:
    """The sentences of a text without what it only shows."""
    t = FENCE.sub("\n", text)
    if "{" in t:  # quotation marks of data show nothing
        t = "\n".join(x.replace('"', " ") if x.lstrip().startswith("{") else x for x in t.split("\n"))
    t = "\n".join(without_fields(x, soft=False) if bare(x) else x for x in ADDRESS.sub(" ", SHOWN.sub(" ", t)).split("\n"))
    t = NUMBER.sub("0", t.lower())
    return [x for w in CUTS.split(t) if len(w) >= SHORTEST and len(x := " ".join(w.split())) >= SHORTEST]


def script(text: str) -> str:
    return "la" if text.isascii() else next((k for k, rx in SCRIPTS if rx.search(text)), "la")


# --- fields ---------------------------------------------------------------------------------------------------------
#: Delimiters of template fields, and those that only templates use.
STRONG = [("{{", "}}"), ("{%", "%}"), ("<%=", "%>"), ("<%", "%>"), ("${", "}"), ("#{", "}"), ("<<", ">>"), ("[[", "]]"), ("%(", ")s"), ("%(", ")d"), ("##", "##"), ("@@", "@@")]
WEAK = [("{", "}"), ("[", "]"), ("<", ">"), ("&lt;", "&gt;"), ("«", "»"), ("$", "$"), ("%", "%"), ("__", "__"), (":", ":"), ("(", ")")]
#: Shapes of names in fields (letters a, capital words A, capitals N), and how often weak delimiters hold one.
NAMES = ["a", "a_a", "a_a_a", "A", "AA", "aA", "N", "N_N", "a.a", "a a", "A A", "A a", "N N", "N N N", "a a a", "a | a", "a:a", "a-a"]
#: Shapes of the same delimiters in prose, marked-up text and program text.
OTHERS = [
    "[0]", "[0,0]", "[0-0]", "[0, a. 0]", "[a]", "[…]", "[A 0]", "[A, 0]", "[a a a a a a]", "[a, a a]", "[a a](a", "[A a](a", "[A](a", "[0](#a", "[x]", "[ ]", "(a)", "(0)", "(a. 0)", "(a 0)", "(A 0)", "(A)", "(N)", "(a a a a)", "(a a)", "(a a a)", "(a, a)", "(a, a a a)",
    "<a>", "</a>", "<a/>", "<a a=", "<A>", "<0", "< 0", "a<a>", "a(a)", "a.a(a)", "a[0]", "a[a]", "{a: a}", "{a:0}", "{ a:", "{a}", "{0}", "$0", "0$", "0%", "0 %", "%0", "50% of", "0:0", ":0", "a: a", "A: a", ":)", "a: a:", "«A a a a»", "«a»", "«A»", "«a a»", "__a__", "__A a__", "__init__", "(a_a)", "a__a", "$a", "$A",
]
_NAME = r"(?!\s)[^\n{{}}<>\[\]$%@«»&|#():]{{1,40}}?(?:\s*\|\s*\w+)?"
#: Every alternative begins with a plain character, which lets the search leap.
FIELD = re.compile("|".join(
    rf"{re.escape(a)}\s?{_NAME.format()}\s?{re.escape(b)}" for a, b in STRONG) + "|" + "|".join(
    rf"{re.escape(a)}(?<![\w{re.escape(a[0])}]{re.escape(a)}){_NAME.format()}{re.escape(b)}(?![\w{re.escape(b[-1])}(])" for a, b in WEAK)
    + r"|%(?<![\w%]%)[sd](?!\w)|\{(?<!\w\{)\d\}(?!\w)|_(?<![\w]_)_{4,}(?![\w_])|\[_{2,}\]|X(?<!\wX)X{3,}\b|Y(?<!\wY)Y{3,}\b|T(?<!\wT)(?:ODO|BD|BC)\b(?:[:-][A-Z]+)?|F(?<!\wF)IXME\b|X(?<!\wX)XX\b"
)
DATE = re.compile(r"\b(?:[DdMmJjTtXxAa]{2}[/.-]){2}[AaYyJjTtXx]{4}\b|\b[Yy]{4}-[Mm]{2}-[Dd]{2}\b")
DATED = ("XX", "xx", "YY", "yy", "JJ", "jj", "AA", "aa")


def fields_in(line: str) -> list[re.Match]:
    """What has the form of a field, in order."""
    out = list(FIELD.finditer(line))
    if any(x in line for x in DATED):
        dates = list(DATE.finditer(line))
        out = sorted([m for m in out if not any(d.start() <= m.start() < d.end() for d in dates)] + dates, key=lambda m: m.start())
    return out


def without_fields(line: str, soft: bool = True) -> str:
    """The line with blanks for what has the form of a field; without ``soft``, what could also be prose stays."""
    at, parts = 0, []
    for m in fields_in(line):
        if m.start() >= at and (soft or not (m.group()[0] in "(«:" or m.group().isalpha())):
            parts += [line[at : m.start()], " "]
            at = m.end()
    return "".join([*parts, line[at:]])


BRACKETS = re.compile(r"^\W+|\W+[sd]?$")
#: A line can hold fields only if it has one of these characters or strings; round brackets, quotation marks and colons aren't taken out of windows.
MARKS, HINTS = frozenset("{}<>$@[%#&_"), ("XX", "xx", "YY", "yy", "JJ", "jj", "AA", "aa", "TBD", "TBC", "TODO", "FIXME")
SOFT = frozenset("(«:")


def bare(line: str) -> bool:
    """Whether windows() has to look for fields in the line."""
    return not MARKS.isdisjoint(line) or any(x in line for x in HINTS)


def triggered(line: str) -> bool:
    """Whether the line can hold a field."""
    return not SOFT.isdisjoint(line) or bare(line)


#: Program text by its shape: keywords at the start, calls, arrows, assignments, flags, statement ends.
CODE = re.compile(r"^(?: {4}|\t)|^\s*(?:const|let|var|def|class|import|from \w+ import|return|for|while|if|else|SELECT|INSERT|UPDATE|CREATE|function|public|private|echo|print|curl|git|pip|npm)\b.*[(){}=;:*]|=>|->|[;{]\s*$|\w\.\w+\(|\w\(\w*\)|\s--\w+|\b[fr]\"[^\"]*\{|\w\s*[:+]?=\s*[\[{\"'\w]", re.M)
#: Stands for a field that was found.
HOLE = "\x00"
QUOTE_BEFORE, QUOTE_AFTER = re.compile(r"[“„«「‘'\"]\s?$"), re.compile(r"\s?[”“»」’'\"]")
#: What a name of shapes is made of.
RUN = re.compile(r"[^\W\d_]+|\d+")


def shape(text: str) -> str:
    """The symbols of a field: letters as a, A or N (all capitals), digits as 0, all else as it is."""
    return RUN.sub(lambda m: "0" if m.group()[0].isdigit() else "N" if len(m.group()) > 1 and m.group().isupper() else "A" if m.group()[0].isupper() and not m.group()[1:].isupper() and not re.search(r"[a-z][A-Z]", m.group()) else "AA" if m.group()[0].isupper() else "aA" if re.search(r"[a-z][A-Z]", m.group()) else "a", text)


class Fields:
    """Whether a span is a field left unfilled: log ratios of its shape and of its name."""

    #: A span is a field from this log ratio on; what a field without a name counts; what brackets of prose count less.
    LEAST, NAMELESS, ROUND = 4.0, 5.0, 4.0

    def __init__(self):
        positive = [f"{a}{n}{b}" for a, b in STRONG for n in NAMES for _ in (0, 1)] + [f"{a}{n}{b}" for a, b in WEAK for n in NAMES]
        self.yes, self.no = ngrams.Model(positive, 14), ngrams.Model([x for x in OTHERS for _ in range(8)], 14)
        self.names = ngrams.Model([clean(x) for x in made.FIELD_NAMES.split("\n")], KIND_BITS)
        self.asides = ngrams.Model([clean(x) for x in made.ASIDES.split("\n")], KIND_BITS)
        self.memo: dict[str, float] = {}

    def ratio(self, span: str, prose: ngrams.Model) -> float:
        got = self.memo.get(span)
        if got is None:
            got = self.memo[span] = self._ratio(span, prose)
        return got

    def _ratio(self, span: str, prose: ngrams.Model) -> float:
        name = clean(BRACKETS.sub("", span).replace("_", " ").replace(".", " "))
        if not RUN.search(name) or re.fullmatch(r"%[sd]|\{\d\}|[XY]{4,}|\W*(?:[DdMmJjTtXxAaYy]{2,4}[/.-]){2}[AaYyJjTtXxDd]{2,4}\W*|(?:TODO|TBD|TBC|FIXME|XXX)\b.*", span):
            return self.NAMELESS
        x, at = ngrams.codes([shape(span)])
        h = ngrams.all_grams(x, 14)
        form = float(ngrams.sums(self.yes.ratio(h, self.no.log(h), 0.99), at)[0])
        name = clean(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", BRACKETS.sub("", span)).replace("_", " ").replace(".", " "))
        x, at = ngrams.codes([name])
        h = ngrams.all_grams(x, PROSE_BITS)
        low, lp = [g >> PROSE_BITS - KIND_BITS for g in h], prose.log(h)
        said, aside = (float(ngrams.sums(m.ratio(low, lp, 0.5), at)[0]) for m in (self.names, self.asides))
        said -= max(0.0, aside)
        return form + said - (self.ROUND if span[0] == "(" else 0.0)

    def unfilled(self, text: str, prose: ngrams.Model) -> list[tuple[str, str, str]]:
        """(field, its line without fields, its line with HOLE for its fields): outside code, and outside backticks and quotation marks that show them."""
        if not triggered(text):
            return []
        t = re.sub(r"`[^`\n]*`", " ", FENCE.sub("\n", text))
        out = []
        for line in t.split("\n"):
            if not triggered(line):
                continue
            spans = [m for m in fields_in(line) if self.ratio(m.group(), prose) >= self.LEAST]
            if spans and not CODE.search(rest := without_fields(line)):
                bare_ = [m for m in spans if not (QUOTE_BEFORE.search(line[: m.start()]) and QUOTE_AFTER.match(line[m.end() :]))]
                holed = line
                for m in reversed(bare_):
                    holed = f"{holed[: m.start()]} {HOLE} {holed[m.end() :]}"
                out += [(m.group(), clean(rest), holed) for m in bare_]
        return out


# --- models ---------------------------------------------------------------------------------------------------------
@functools.cache
def _kinds() -> list[ngrams.Model]:
    """The models of each kind of residue and of mentions, made of fixed texts."""
    return [ngrams.Model([clean(x) for x in t.split("\n")], KIND_BITS) for t in (made.FILLER, made.ERROR, made.NOTICE, made.MENTION)]


class Models:
    """The models of prose, words, each kind of residue and mentions; fields have theirs.

    sentences: windows of a small corpus, residue among them; fit() makes
    models of tables. Each half is first judged by models of the other half, so that no text
    vouches for itself; what is residue by that leaves the prose before the
    final models are made.
    """

    def __init__(self, sentences: list[str]):
        self.fields = Fields()
        self.kinds = _kinds()
        ws = sorted(set(sentences))
        count = Counter(sentences)
        half = np.array([zlib.crc32(w.encode()) & 1 for w in ws], np.int64)
        bad = np.zeros(len(ws), bool)
        for k in (0, 1):
            here, there = np.flatnonzero(half == k), np.flatnonzero(half != k)
            if not len(here):
                continue
            self._fit([ws[i] for i in there], count)
            part = [ws[i] for i in here]
            bad[here] = self.judge(part, words=False)[0] > 1
        self._fit([w for w, b in zip(ws, bad) if not b], count)

    def _fit(self, sentences: list[str], count: Counter) -> None:
        self.prose = ngrams.Model(sentences, PROSE_BITS)
        seen: Counter = Counter()
        for s in sentences:
            for w in WORD.findall(s):
                seen[w] += count[s]
        every = sorted(seen)
        self.words = ngrams.Model(every, KIND_BITS, np.array([seen[w] for w in every], np.float64)) if every else None
        total = sum(seen.values())
        self.common = {w for w, n in seen.items() if n >= COMMON * total}
        spelt = self.spelt(sentences)
        read = self.read(sentences)
        scripts = np.array([script(s) if n >= STRANGE_WORDS else "" for s, (_, n, _) in zip(sentences, spelt)])
        self.usual: dict[str, tuple[float, float, float, float]] = {}
        for k in set(scripts.tolist()) - {""}:
            at = np.flatnonzero(scripts == k)
            if len(at) >= 50:
                self.usual[k] = (*_middle(np.array([spelt[i][0] for i in at])), *_middle(read[at]))

    @classmethod
    def counted(cls, prose: tuple, spelling: tuple, common: set[str]) -> Models:
        """Models of the grams of windows and of words, as ngrams.tally() counts them."""
        out = cls.__new__(cls)
        out.fields, out.kinds, out.prose, out.common, out.usual = Fields(), _kinds(), ngrams.Model.of(prose, PROSE_BITS), common, {}
        out.words = ngrams.Model.of(spelling, KIND_BITS) if len(spelling[0]) else None
        return out

    def __getstate__(self):
        """What is made of fixed texts is made again by the workers."""
        return {k: v for k, v in self.__dict__.items() if k not in ("fields", "kinds")}

    def __setstate__(self, state):
        self.__dict__ |= state | {"fields": Fields(), "kinds": _kinds()}

    def read(self, ws: list[str]) -> np.ndarray:
        """Mean log probability a character of each window."""
        if not ws:
            return np.zeros(0)
        x, at = ngrams.codes(ws)
        return ngrams.sums(self.prose.log(ngrams.all_grams(x, PROSE_BITS)), at) / np.array([len(w) + 1 for w in ws])

    def spelt(self, ws: list[str]) -> list[tuple[float, int, float]]:
        """(mean log probability a character of the window's words, words, share of common ones) of each window."""
        words = [WORD.findall(w) for w in ws]
        every = list({x for w in words for x in w})
        if not every or self.words is None:
            return [(0.0, 0, 0.0)] * len(ws)
        x, at = ngrams.codes(every)
        score = dict(zip(every, ngrams.sums(self.words.log(ngrams.all_grams(x, KIND_BITS)), at)))
        return [(sum(score[y] for y in w) / sum(len(y) + 1 for y in w), len(w), sum(y in self.common for y in w) / len(w)) if w else (0.0, 0, 0.0) for w in words]

    def strange(self, ws: list[str], read: np.ndarray) -> np.ndarray:
        """How strange each window is, from 1; 0 for the others."""
        out = np.zeros(len(ws))
        if not self.usual:
            return out
        # only what reads strangely is looked at word by word
        most = max(u[2] - STRANGE_READ * u[3] for u in self.usual.values())
        odd = [int(i) for i in np.flatnonzero(read < most)]
        for i, (v, k, c) in zip(odd, self.spelt([ws[i] for i in odd])):
            if k >= STRANGE_WORDS and c <= COMMON_SHARE and (u := self.usual.get(script(ws[i]))):
                z = min((u[0] - v) / u[1] / STRANGE_SPELT, (u[2] - read[i]) / u[3] / STRANGE_READ)
                out[i] = z if z > 1 else 0.0
        return out

    def judge(self, ws: list[str], words: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(strength, kind, mention, strange) of each window.

        Strength over 1 is residue of that kind; mention is the log ratio of
        mentions; strange is of invented words, looked at only with ``words``.
        """
        best, kind, mention, read = self.weigh(ws)
        strange = self.strange(ws, read) if words and ws else np.zeros(len(ws))
        return best, kind, mention, np.where(best > 1, 0.0, strange)

    def weigh(self, ws: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(strength, kind, mention, mean log probability a character) of each window."""
        if not ws:
            return np.zeros(0), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        x, at = ngrams.codes(ws)
        h = ngrams.all_grams(x, PROSE_BITS)
        lp = self.prose.log(h)
        low = [g >> PROSE_BITS - KIND_BITS for g in h]
        n = np.array([len(w) + 1 for w in ws])
        r = np.stack([ngrams.sums(m.ratio(low, lp, SHARE), at) / n for m in self.kinds])
        mention = r[-1]
        strength = np.minimum(np.minimum(r[:-1] / RATIO, (r[:-1] - mention) / LEAD), r[:-1] * n / EVIDENCE)
        kind, best = strength.argmax(axis=0), strength.max(axis=0)
        for i, w in enumerate(ws):
            if strange_only(w):
                best[i], kind[i] = max(best[i], 2.0), 0
        return best, kind, mention, ngrams.sums(lp, at) / n


def _middle(v: np.ndarray) -> tuple[float, float]:
    """(median, spread as of a normal distribution)."""
    m = float(np.median(v))
    return m, max(0.05, 1.4826 * float(np.median(np.abs(v - m))))


def strange_only(w: str) -> bool:
    """True for a window that only repeats itself."""
    words = WORD.findall(w)
    return len(words) >= REPEATS and len(set(words)) * REPEATS <= len(words)


# --- models of a table ------------------------------------------------------------------------------------------------
def side(text: str) -> int:
    """The half of the corpus that a window is in: 0 or 1, by its own characters, so that all of a kind are in one."""
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) & 1


def window_counts(docs: DataFrame) -> DataFrame:
    """(side, w, n): every window of all texts, once, its half, and how often it occurs."""

    def make():
        def kernel(texts):
            seen: Counter = Counter()
            for t in texts:
                if t:
                    seen.update(windows(t))
            return [list(map(side, seen)), list(seen), list(seen.values())]

        return kernel

    return map_rows(docs.select("text"), "side int, w string, n bigint", make, rows=5000).groupBy("side", "w").agg(F.sum("n").alias("n"))


#: Steps of the counts of mean log probabilities in one unit of them; grams that a task holds before it hands them on.
STEPS, HELD = 500, 2_000_000
_COUNTED = "what string, side int, high bigint, low bigint, word string, n bigint"


def counts(every: DataFrame, first: list[Models] | None = None) -> DataFrame:
    """What models are made of, summed up over all windows of window_counts(): rows (what, side, high, low, word, n).

    what: prose, spelling (grams of windows, once each, and of words, as often
    as they occur), word, and total (of all words), for each half. With
    ``first``, models of the halves, windows that those of the other half take
    for residue are left out, and all counts are side 0's.
    """

    def make():
        held: dict[tuple[str, int], list] = {}
        plain: Counter = Counter()

        def grams(what, s, counted):
            held.setdefault((what, s), []).append(counted)

        def flush():
            out = [[] for _ in range(6)]
            for s in (0, 1):
                ws = [(w, n) for (what, k, w), n in plain.items() if what == "word" and k == s]
                if ws:
                    grams("spelling", s, ngrams.tally(*ngrams.codes([w for w, _ in ws]), np.array([n for _, n in ws], np.int64)))
            for (what, s), parts in held.items():
                high, low, n = ngrams.merged(*map(np.concatenate, zip(*parts)))
                for col, v in zip(out, ([what] * len(n), [s] * len(n), high.tolist(), low.tolist(), [None] * len(n), n.tolist())):
                    col += v
            for (what, s, w), n in plain.items():
                for col, v in zip(out, (what, s, None, None, w, n)):
                    col.append(v)
            held.clear(), plain.clear()
            return out

        def kernel(sides, texts, ns):
            for s in (0, 1):
                ws, n = [w for w, k in zip(texts, sides) if k == s], [n for n, k in zip(ns, sides) if k == s]
                if not ws:
                    continue
                to = s
                if first:
                    good, to = np.flatnonzero(first[1 - s].weigh(ws)[0] <= 1).tolist(), 0
                    ws, n = [ws[i] for i in good], [n[i] for i in good]
                grams("prose", to, ngrams.tally(*ngrams.codes(ws)))
                for w, k in zip(ws, n):
                    said = WORD.findall(w)
                    plain["total", to, None] += k * len(said)
                    for x in said:
                        plain["word", to, x] += k
            for key, parts in held.items():
                if len(parts) > 20:
                    held[key] = [ngrams.merged(*map(np.concatenate, zip(*parts)))]
            return flush() if sum(len(p[0]) for parts in held.values() for p in parts) + len(plain) > HELD else [[] for _ in range(6)]

        kernel.last = flush
        return kernel

    rows = map_rows(every.select("side", "w", "n"), _COUNTED, make)
    return rows.groupBy("what", "side", "high", "low", "word").agg(F.sum("n").alias("n"))


def _models(counted: DataFrame, sides: tuple[int, ...]) -> list[Models]:
    """The models of counts(), of each side; what is usual is still open. Of the words only those move to the driver that are common."""
    counted = settle(counted)
    total = {r.side: r.n for r in counted.where("what = 'total'").collect()}
    common = F.col("n") >= F.when(F.col("side") == 0, F.lit(COMMON * total.get(0, 0))).otherwise(F.lit(COMMON * total.get(1, 0)))
    got = counted.where("what <> 'total'").where((F.col("what") != "word") | common).toArrow().to_pydict()
    of: dict[tuple[str, int], list[int]] = {}
    for i, k in enumerate(zip(got["what"], got["side"])):
        of.setdefault(k, []).append(i)
    table = lambda what, s: tuple(np.array([got[c][i] for i in of.get((what, s), [])], np.int64) for c in ("high", "low", "n"))
    return [Models.counted(table("prose", s), table("spelling", s), {got["word"][i] for i in of.get(("word", s), [])}) for s in sides]


def usual(every: DataFrame, models: Models) -> dict[str, tuple[float, float, float, float]]:
    """Medians and spreads of what the words and characters of all windows of STRANGE_WORDS words or more score, by script, to a step of 1 / STEPS.

    Residue is among them; it is rare, and a median bears that.
    """

    def make():
        def kernel(texts):
            ws = [w for w in texts if len(WORD.findall(w)) >= STRANGE_WORDS]
            seen: Counter = Counter()
            for w, v, (u, _, _) in zip(ws, models.read(ws).tolist(), models.spelt(ws)):
                seen[k := script(w), True, round(v * STEPS)] += 1
                seen[k, False, round(float(u) * STEPS)] += 1
            return [*map(list, zip(*seen)), list(seen.values())] if seen else [[], [], [], []]

        return kernel

    by: dict[tuple[str, bool], list[tuple[int, int]]] = {}
    for r in map_rows(every.select("w"), "script string, read boolean, step bigint, n bigint", make).groupBy("script", "read", "step").agg(F.sum("n").alias("n")).collect():
        by.setdefault((r.script, r.read), []).append((r.step, r.n))
    middle = {k: _middle_of(v / STEPS, n) for k, x in by.items() for v, n in [np.array(sorted(x), np.int64).T] if n.sum() >= 50}
    return {k: (*middle[k, False], *middle[k, True]) for k, read in middle if read}


def _middle_of(v: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """_middle() of values that occur n times each."""

    def median(x):
        by = np.argsort(x)
        return float(x[by][np.searchsorted(np.cumsum(n[by]), n.sum() / 2)])

    m = median(v)
    return m, max(0.05, 1.4826 * median(np.abs(v - m)))


#: Up to so many characters a table's halves would know too few words.
SMALL_CHARS = 3_000_000


#: A table of up to so many characters is fitted in the driver.
SMALL_CHARS = 3_000_000


def fit(docs: DataFrame) -> Models:
    """Models(all windows of all texts of a table), from counts over the table where that is large. Runs actions."""
    if (docs.agg(F.sum(F.length("text"))).first()[0] or 0) <= SMALL_CHARS:
        return Models([w for w, n in window_counts(docs).select("w", "n").collect() for _ in range(n)])
    every = settle(window_counts(docs))
    models = _models(counts(every, _models(counts(every), (0, 1))), (0,))[0]
    models.usual = usual(every, models)
    return models


def sample(docs: DataFrame) -> list[str]:
    """All windows of all texts of a small table, in the driver; no query uses it, they fit() their models."""
    return [w for (t,) in docs.where("text IS NOT NULL").select("text").collect() for w in windows(t)]


def find_residue(docs: DataFrame, models: Models) -> DataFrame:
    """(doc_id, residue, coverage, n_windows, longest): documents with residue, a row for each kind.

    coverage is the share of the text's windows' characters that are residue
    of that kind. Null, empty and blank texts give no row; repeated rows of a
    document repeat its result. Whole texts are judged; there is no shuffle.
    """

    def make():
        memo: dict[str, tuple[float, int, float]] = {}

        def verdicts(ws):
            new = list({w for w in ws if w not in memo})
            if len(memo) > 100_000:
                memo.clear()
                new = list(set(ws))
            best, kind, _, strange = models.judge(new)
            memo.update(zip(new, zip(best.tolist(), kind.tolist(), strange.tolist())))
            return [memo[w] for w in ws]

        def kernel(ids, texts):
            out = [[] for _ in range(5)]

            def emit(*row):
                for col, v in zip(out, row):
                    col.append(v)

            owner, win, total = [], [], {}
            fields = []
            for k, t in enumerate(texts):
                if t and not t.isspace():
                    ws = windows(t)
                    total[k] = sum(map(len, ws))
                    got = models.fields.unfilled(t, models.prose)
                    fields += [(k, f, rest) for f, rest, _ in got]
                    # a sentence with a field is a template's, whatever else it says
                    holed = {" ".join(w.replace(HOLE, " ").split()) for x in {x for _, _, x in got} for w in windows(x) if HOLE in w}
                    ws = [w for w in ws if w not in holed]
                    owner += [k] * len(ws)
                    win += ws
            spoken = models.judge(list(rests))[2] if (rests := dict.fromkeys(r for _, _, r in fields)) else []
            about = {r for r, m in zip(rests, spoken) if m > RATIO}
            kept: dict[int, list[str]] = {}
            for k, f, rest in fields:
                if rest not in about:
                    kept.setdefault(k, []).append(f)
            for k, fs in kept.items():
                emit(ids[k], "placeholder", min(1.0, sum(map(len, fs)) / max(1, len(texts[k]))), len(fs), max(fs, key=len))
            found: dict[tuple[int, int], list[str]] = {}
            odd: dict[int, dict[str, float]] = {}
            for k, w, (best, kind, strange) in zip(owner, win, verdicts(win)):
                if best > 1:
                    found.setdefault((k, kind), []).append(w)
                elif strange:
                    odd.setdefault(k, {})[w] = strange
            for k, o in odd.items():
                if sum(o.values()) >= STRANGE:
                    found.setdefault((k, 0), []).extend(o)
            for (k, c), ws in found.items():
                emit(ids[k], KINDS[c], sum(map(len, ws)) / max(1, total[k]), len(ws), max(ws, key=len))
            return out

        return kernel

    return map_rows(docs.select("doc_id", "text"), "doc_id bigint, residue string, coverage double, n_windows int, longest string", make, rows=1000)


def exclude(docs: DataFrame, residue: DataFrame, coverage: float = 0.0) -> DataFrame:
    """The documents without residue, or with no more than ``coverage`` of any kind."""
    return docs.join(residue.where(F.col("coverage") > coverage).select("doc_id").distinct(), "doc_id", "left_anti")
