"""Language of a text by scripts and function words, in one pass over its characters."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.arrow import map_rows
from folioflow.functions import text as T

#: Characters examined, fewest letters, words examined, and hints for texts without function words.
SAMPLE, LETTERS, WORDS = 6000, 8, 400
HINTS = [("[äöüß]", "de"), ("[ãõ]", "pt"), ("[ñ¿¡]", "es"), ("[ăâêôơưđ]", "vi")]
BY_SCRIPT = {"myanmar": "my", "thai": "th", "devanagari": "hi", "hangul": "ko", "kana": "ja", "cyrillic": "ru"}
SPLIT = re.compile(r"[^\W_]+")


def class_table() -> np.ndarray:
    """The number of each character's script, from 1 in the order of SCRIPTS; 0 for all others and white space."""
    every = [chr(i) for i in range(0x10000) if not 0xD800 <= i < 0xE000]
    table = np.zeros(0x10000, np.uint8)
    for k, cls in reversed(list(enumerate(T.SCRIPTS.values(), 1))):
        own = re.compile("[" + re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: re.escape(chr(int(m[1], 16))), cls) + "]")
        for c in every:
            if own.match(c):
                table[ord(c)] = k
    for c in every:
        if c.isspace() or c == "﻿":
            table[ord(c)] = 0
    return table


class Detector:
    """Code and confidence of a text."""

    def __init__(self):
        self.table, self.kinds = class_table(), list(T.SCRIPTS)
        self.votes: dict[str, list[int]] = {}
        for i, ws in enumerate(T.STOPWORDS.values()):
            for w in ws:
                self.votes.setdefault(w, []).append(i)
        self.hints = [(re.compile(p), code) for p, code in HINTS]

    def __call__(self, text: str | None) -> tuple[str, float]:
        s = (text or "")[:SAMPLE]
        x = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
        count = np.bincount(self.table[x[x < 0x10000]], minlength=len(self.kinds) + 1)[1:]
        letters = int(count.sum())
        if letters < LETTERS:
            return "unknown", 0.0
        share = dict(zip(self.kinds, (count / letters).tolist()))
        top, factor = self.kinds[int(count.argmax())], min(1.0, letters / 40)
        code, sure = self.judge(s, top, share, factor)
        return code, round(min(1.0, max(0.0, sure)) * 1000 + 1e-9) / 1000

    def judge(self, s: str, top: str, share: dict[str, float], factor: float) -> tuple[str, float]:
        tempered = lambda v: v * (0.75 + 0.25 * factor)
        if top in ("persian", "arabic"):
            persian, arabic = share["persian"], share["arabic"]
            return "fa" if persian > 0.02 and persian >= arabic * 0.4 else "ar", (persian + arabic) * 0.95
        if top == "han":
            if share["kana"] > 0.03:
                return "ja", min(0.95, share["han"] + share["kana"])
            simple, trad = sum(map(s.count, T.SIMPLIFIED)), sum(map(s.count, T.TRADITIONAL))
            return "zh-Hant" if trad / max(1, simple + trad) > 0.35 else "zh", share["han"] * 0.95
        if top == "latin":
            return self.latin(s, share["latin"], factor)
        if top == "kana":
            return "ja", tempered(share["kana"] + share["han"])
        extra = 0.0
        if top == "myanmar":
            extra = min(0.15, sum(p in s for p in T.BURMESE) * 0.03)
        elif top == "cyrillic":
            extra = 0.1 if len(set(SPLIT.findall(s.lower())).intersection(T.RUSSIAN)) >= 3 else 0.0
        return BY_SCRIPT[top], tempered(share[top]) + extra

    def latin(self, s: str, share: float, factor: float) -> tuple[str, float]:
        window = SPLIT.findall(s.lower())[:WORDS]
        votes = [0] * len(T.STOPWORDS)
        for w in window:
            for i in self.votes.get(w, ()):
                votes[i] += 1
        best = max(votes)
        hint = next((code for rx, code in self.hints if rx.search(s)), None)
        code = list(T.STOPWORDS)[votes.index(best)] if best else hint or "en"
        evidence = best / len(window) if best else 0.04 if hint else 0.0
        return code, (0.35 + min(0.55, evidence * 6) * (0.7 + 0.3 * factor)) * share if evidence else 0.35


def detect(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, code, confidence): unknown with 0 for too few letters; null counts as empty.

    The script of most letters decides first (ties in the order of the class
    list); Latin letters are told apart by the share of function words among
    the first WORDS words of the first SAMPLE characters, as the rule has it.
    Only those reach the kernel.
    """

    def make():
        judge = Detector()

        def kernel(keys, texts):
            got = [judge(t) for t in texts]
            return [keys, [c for c, _ in got], [v for _, v in got]]

        return kernel

    kind = dict(df.dtypes)[key]
    return map_rows(df.select(key, F.left(text, F.lit(SAMPLE)).alias("text")), f"{key} {kind}, code string, confidence double", make)
