"""Problem 1: cutting oversized items at natural boundaries."""

from __future__ import annotations

import math
import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.arrow import map_rows

#: The strength of a cut after the match, strongest first.
BOUNDARIES = (
    (5, re.compile(r"\n[^\S\n]*\n\s*")),
    (4, re.compile(r"\n")),
    (3, re.compile(r"[.!?…]+[\"'”’»)\]]*\s+|[。！？।။]+[”’」』）]*\s*|[!?]+(?=[぀-鿿])")),
    (2, re.compile(r"[,;:、，；：၊]\s*|(?<=[฀-๿]) (?=[฀-๿])")),
    (1, re.compile(r"\s+")),
)


def strengths(text: str, lo: int, hi: int) -> dict[int, int]:
    """Position → strength of the natural boundaries with lo <= position <= hi."""
    found: dict[int, int] = {}
    a = max(0, lo - 64)
    part = text[a : hi + 2]
    for s, rx in BOUNDARIES:
        for m in rx.finditer(part):
            p = a + m.end()
            if lo <= p <= hi:
                found.setdefault(p, s)
    return found


def _solid(text: str, p: int) -> bool:
    """True if a cut at p would part a base from its marks or joiners."""
    if not 0 < p < len(text):
        return False
    c = text[p]
    return unicodedata.combining(c) > 0 or unicodedata.category(c) in ("Mn", "Mc", "Me") or c in "‍️" or text[p - 1] == "‍"


def cut(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Ranges of pieces of at most ``limit`` characters; each begins ``overlap`` before the last one's end.

    The fewest pieces are tried first, with equal targets; a cut goes to the
    strongest boundary in the part of its neighbourhood from which all limits
    can still be kept, ties to the nearest. A cut without any boundary there
    adds a piece, up to half as many again; then it falls between characters,
    never inside a combining sequence if that can be helped.
    """
    n = len(text)
    if limit <= 0:
        raise ValueError("limit must be positive")
    overlap = max(0, min(overlap, limit - 1))
    if n <= limit:
        return [(0, n)]
    step = limit - overlap
    least = max(2, math.ceil((n - overlap) / step))
    most = least + max(1, least // 2)
    for k in range(least, most + 1):
        found = _place(text, limit, overlap, k, strict=k < most)
        if found:
            return found
    return _place(text, limit, overlap, most, strict=False)


def _place(text: str, limit: int, overlap: int, k: int, strict: bool) -> list[tuple[int, int]] | None:
    n, start, out = len(text), 0, []
    for i in range(1, k):
        rest = k - i
        hi = min(start + limit, n - 1)
        lo = max(start + overlap + 1, n - rest * (limit - overlap))
        lo = min(max(lo, start + overlap + 1), hi)
        target = min(max(start + round((n - start + rest * overlap) / (rest + 1)), lo), hi)
        reach = max(1, (limit - overlap) // 3)
        a, b = max(lo, target - reach), min(hi, target + reach)
        marks = strengths(text, a, b) or strengths(text, lo, hi)
        if marks:
            p = max(marks, key=lambda q: (marks[q], -abs(q - target), -q))
        elif strict:
            return None
        else:
            p = target
            while p > lo and _solid(text, p):
                p -= 1
            if _solid(text, p):
                p = target
        out.append((start, p))
        start = p - overlap
        if n - start <= limit:
            return [*out, (start, n)]
    if n - start > limit:
        return None
    return [*out, (start, n)]


def split_oversized(items: DataFrame, limits: DataFrame) -> DataFrame:
    """Pieces of the items longer than their kind's limit.

    items: item_kind, document_id, item_no, text, and optionally updated_at
    and ingested_at; limits: item_kind, max_chars, overlap_chars. Other columns
    are ignored. Of an item's versions that are too long the newest is cut
    (ties to the greater text), so an item is a case if any version is. Result: one row per
    piece with piece_no (from 0), n_pieces, start_pos, end_pos and the piece's
    text. Null and empty texts and kinds without a limit give no row; repeated
    items come once; an overlap of the limit or more counts as limit - 1.
    The length filter runs before the texts move or reach Python.
    """
    few = limits.where("item_kind IS NOT NULL AND max_chars > 0").groupBy("item_kind").agg(F.min("max_chars").alias("_max"), F.max(F.coalesce("overlap_chars", F.lit(0))).alias("_overlap"))
    age = [c for c in ("updated_at", "ingested_at") if c in items.columns]
    big = (
        items.select("item_kind", "document_id", "item_no", "text", *age)
        .join(F.broadcast(few), "item_kind")  # a row per kind of item
        .where(F.length("text") > F.col("_max"))
        .groupBy("item_kind", "document_id", "item_no", "_max", "_overlap")
        .agg(F.max(F.struct(*age, "text")).alias("_last"))
        .select("item_kind", "document_id", "item_no", "_max", "_overlap", F.col("_last.text").alias("text"))
    )

    def make():
        def kernel(kind, doc, no, text, most, overlap):
            out = [[] for _ in range(8)]
            for row in zip(kind, doc, no, text, most, overlap):
                spans = cut(row[3], row[4], row[5])
                for i, (a, b) in enumerate(spans):
                    for col, v in zip(out, (row[0], row[1], row[2], i, len(spans), a, b, row[3][a:b])):
                        col.append(v)
            return out

        return kernel

    return map_rows(big.select("item_kind", "document_id", "item_no", "text", "_max", "_overlap"), "item_kind string, document_id string, item_no int, piece_no int, n_pieces int, start_pos int, end_pos int, text string", make)
