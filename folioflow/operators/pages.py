"""Pagination: wrapping lines by a width function, synthetic pages, and render plans."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.arrow import map_rows

#: Page size, margin, line height and sizes of headings in points.
WIDTH, HEIGHT, MARGIN, LEADING, BODY = 595.0, 842.0, 56.0, 1.4, 11.0
HEADINGS = (26.0, 22.0, 18.0, 16.0, 14.0, 13.0)


def width_of(text: str, size: float) -> float:
    """A fixed metric: wide characters an em, others half of one, combining marks nothing."""
    return sum(0.0 if unicodedata.combining(c) or unicodedata.category(c) == "Mn" else size if unicodedata.east_asian_width(c) in "WF" or "က" <= c <= "႟" else size * 0.5 for c in text)


def wrap(text: str, size: float, room: float, width: Callable[[str, float], float] = width_of) -> list[str]:
    """Lines of at most ``room``: at spaces where possible, else between characters, never before a combining mark."""
    out: list[str] = []
    for para in text.split("\n"):
        line = ""
        for word in para.split():
            tried = f"{line} {word}" if line else word
            if width(tried, size) <= room:
                line = tried
                continue
            if line:
                out.append(line)
            line = ""
            for c in word:
                if line and width(line + c, size) > room and not (unicodedata.combining(c) or unicodedata.category(c) in ("Mn", "Mc")):
                    out.append(line)
                    line = ""
                line += c
        out.append(line)
    return out


def paginate(blocks: list[dict]) -> list[tuple[int, int, float, int, bool]]:
    """(page, block position, y, lines placed, continued) of a document's blocks in order.

    A block that fits a page but not the rest of this one moves whole; longer
    ones go on over the following pages.
    """
    out, page, y = [], 0, MARGIN
    bottom = HEIGHT - MARGIN
    for pos, b in enumerate(blocks):
        size = HEADINGS[min(6, max(1, b["level"] or 1)) - 1] if b["kind"] == "heading" else BODY
        step = size * LEADING
        lines = max(1, len(wrap(b["text"] or "", size, WIDTH - 2 * MARGIN)))
        if y > MARGIN and y + lines * step > bottom and MARGIN + lines * step <= bottom:
            page, y = page + 1, MARGIN
        more = False
        while lines:
            fit = max(1, int((bottom - y) // step)) if y + step <= bottom or y == MARGIN else 0
            if not fit:
                page, y = page + 1, MARGIN
                continue
            n = min(fit, lines)
            out.append((page, pos, y, n, more))
            y, lines, more = y + n * step, lines - n, True
            if lines:
                page, y = page + 1, MARGIN
        y += step / 2
    return out


def render_plan(blocks: DataFrame) -> DataFrame:
    """(document_id, page_no, pos, y, n_lines, continued): where each block of a document stands.

    blocks: document_id, pos, kind, level, text; a document is the unit of work.
    """
    docs = blocks.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("pos", "kind", "level", "text"))).alias("bs"))

    def make():
        def kernel(ids, lists):
            out = [[] for _ in range(6)]
            for i, bs in zip(ids, lists):
                for page, k, y, n, more in paginate(bs):
                    for col, v in zip(out, (i, page, bs[k]["pos"], y, n, more)):
                        col.append(v)
            return out

        return kernel

    return map_rows(docs, "document_id string, page_no int, pos int, y double, n_lines int, continued boolean", make)
