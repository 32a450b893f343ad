"""Page layout: runs to lines, tables, paragraphs and classified blocks, one page at a time."""

from __future__ import annotations

import math
import re
from collections import Counter
from statistics import median

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.arrow import map_rows

#: Shapes of list markers, captions and page numbers, and a table cell's limits.
MARKER = re.compile(r"(?:([•●▪◦‣·⁃*+\-–—])|(\(?(?:\d{1,3}|[a-zA-Z]|[ivxIVX]{1,5})[.)]|\(?[၀-၉]{1,4}\)?[.)။]))\s+")
CAPTION = re.compile(r"(?i:fig(?:ure)?|tab(?:le)?|chart|graph|plate|schema)\s*\.?\s*\d|ရုပ်|ဇယား")
PAGE_NUMBER = re.compile(r"[0-9]{1,4}|[IVXLivxl]{1,6}")
LEVELS = ((2.0, 1), (1.6, 2), (1.4, 3), (1.28, 4))
CELL_WORDS, CELL_CHARS = 4, 40
#: Points between a caption and what it hugs, least (boxes may overlap a little) and most.
CAPTION_GAPS = (-4, 32)


def lines_of(runs: list[dict]) -> list[dict]:
    """Runs on one baseline as lines, with parts where the gaps are wide."""
    todo = sorted(((r["y"] + 0.8 * r["height"], r["x"], i, r) for i, r in enumerate(runs) if r["text"] or r["width"] > 0), key=lambda t: t[:3])
    groups: list[list] = []
    for base, _, _, r in todo:
        g = groups[-1] if groups else None
        if g and not g[0] and abs(base - g[1]) <= max(2, 0.35 * min(r["font_size"], g[2])):
            g[3].append(r)
            g[0] = bool(r.get("has_eol"))
        else:
            groups.append([bool(r.get("has_eol")), base, r["font_size"], [r]])
    return [x for _, base, _, rs in groups if (x := _line(base, sorted(rs, key=lambda r: r["x"])))]


def _line(base: float, rs: list[dict]) -> dict | None:
    parts, right, text = [], None, ""
    for r in rs:
        gap = 0.0 if right is None else r["x"] - right
        blank = not r["text"].strip() and r["width"] > 0
        wide = gap + (r["width"] if blank else 0) >= max(8, 1.4 * r["font_size"])
        spaced = gap + (r["width"] if blank else 0) >= max(0.5, 0.12 * r["font_size"])
        if (wide or spaced) and text and not text.endswith(" "):
            text += " "
        if not blank:
            if parts and not wide and parts[-1] is not None:
                p = parts[-1]
                p["text"] += (" " if spaced and not p["text"].endswith(" ") else "") + r["text"]
                p["right"] = max(p["right"], r["x"] + r["width"])
            else:
                parts.append({"text": r["text"], "x": r["x"], "right": r["x"] + r["width"]})
            text += r["text"]
        elif wide:
            parts.append(None)
        right = r["x"] + r["width"]
    parts = [p | {"text": p["text"].strip()} for p in parts if p and p["text"].strip()]
    fonts = Counter()
    for r in rs:
        fonts[r.get("font_key")] += len(r["text"].strip())
    text = text.strip()
    x, top = min(r["x"] for r in rs), min(r["y"] for r in rs)
    if not text and max(r["x"] + r["width"] for r in rs) <= x:
        return None
    m = MARKER.match(text)
    return {
        "text": text, "parts": parts, "x": x, "y": top, "right": max(r["x"] + r["width"] for r in rs), "bottom": max(r["y"] + r["height"] for r in rs), "baseline": base,
        "size": max(r["font_size"] for r in rs) or 10.0, "font": fonts.most_common(1)[0][0], "bold": any(r.get("bold") for r in rs), "list": None if not m else bool(m[2]),
    }


def tables_of(lines: list[dict]) -> tuple[list[list[dict]], list[dict]]:
    """(groups of lines that are tables, the other lines): neighbours whose short parts stand under the first one's."""

    def candidate(x):
        return x["list"] is None and len(x["parts"]) >= 2 and all(len(p["text"].split()) <= CELL_WORDS and len(p["text"]) <= CELL_CHARS for p in x["parts"])

    def under(a, b):
        free = list(b["parts"])
        for p in a["parts"]:
            hit = next((q for q in free if min(abs(p["x"] - q["x"]), abs(p["x"] + p["right"] - q["x"] - q["right"]) / 2) <= max(6, 0.25 * (q["right"] - q["x"]))), None)
            if hit is None:
                return False
            free.remove(hit)
        return not free

    found, rest, run = [], [], []
    for x in [*sorted(lines, key=lambda x: (x["baseline"], x["x"])), None]:
        ok = x is not None and candidate(x)
        if ok and run and x["baseline"] - run[-1]["baseline"] <= 1.75 * max(x["size"], run[-1]["size"]) and under(x, run[0]):
            run.append(x)
            continue
        (found.append(run) if len(run) >= 2 else rest.extend(run))
        run = [x] if ok else []
        if x is not None and not ok:
            rest.append(x)
    return found, rest


def paragraphs_of(lines: list[dict]) -> list[list[dict]]:
    """Runs of lines with like type and close baselines."""
    out: list[list[dict]] = []
    for x in sorted(lines, key=lambda x: (x["baseline"], x["x"])):
        p = out[-1][-1] if out else None
        size = max(x["size"], p["size"]) if p else 0
        if p and (x["list"] is None) == (p["list"] is None) and x["bold"] == p["bold"] and abs(x["size"] - p["size"]) <= 0.12 * size and x["baseline"] - p["baseline"] <= (1.8 if x["list"] is not None else 1.95) * size:
            out[-1].append(x)
        else:
            out.append([x])
    return out


def classify(ls: list[dict], body: float, height: float, above: float, below: float) -> tuple[str, int | None, str | None]:
    """(kind, heading level, flag) of a paragraph."""
    size, chars, text = median(x["size"] for x in ls), sum(len(x["text"]) for x in ls), ls[0]["text"]
    ratio = size / body if body else 1.0
    edge = min(x["y"] for x in ls) <= height * 0.06 or max(x["bottom"] for x in ls) >= height * 0.94
    if len(ls) == 1 and PAGE_NUMBER.fullmatch(text) and (edge or above > size * 2):
        return "other", None, "page_number"
    if len(ls) <= 2 and chars <= 90 and edge and size <= body * 1.1:
        return "other", None, "header_footer"
    if ls[0]["list"] is not None:
        return "list", None, None
    short = chars <= 220 and len(ls) <= 3
    level = next((n for least, n in LEVELS if max(ratio, 1.2) >= least), 5)
    apart = above >= size * 0.4 or below >= size * 0.4
    capital = len(ls) <= 2 and ratio >= 1.05 and re.search("[A-Za-z]", text) and text == text.upper()
    if short and (ratio >= 1.2 or ratio >= 1.08 and any(x["bold"] for x in ls) and apart or capital):
        return "heading", level, None
    if chars <= 200 and len(ls) <= 2 and CAPTION.match(text):
        return "caption", None, None
    return "paragraph", None, None


def alignment(ls: list[dict], width: float) -> str:
    """left, center, right or justify, by the spread of the lines' edges."""
    if len(ls) < 2:
        return "left"
    room = max(3, width * 0.02)
    spread = lambda f: max(map(f, ls)) - min(map(f, ls)) <= room
    left, right, mid = spread(lambda x: x["x"]), spread(lambda x: x["right"]), spread(lambda x: (x["x"] + x["right"]) / 2)
    return "justify" if len(ls) >= 3 and left and right else "left" if left else "center" if mid else "right" if right else "left"


#: Bands of a page that vote for gutters, narrowest gutter in points, most columns, share of the lines whose votes a gutter needs.
BANDS, GUTTER, COLUMNS, VOTES = 8, 12, 4, 0.2


def gaps_between(spans: list[tuple[float, float]], width: float) -> list[tuple[float, float]]:
    """Vertical strips that none of the spans (left, right) touches, between the first and the last, of GUTTER points at least, on the page's raster."""
    step = max(2, math.floor(width / 240 + 0.5))
    left, right = min(a for a, _ in spans), max(b for _, b in spans)
    if right <= left:
        return []
    free = np.ones(math.floor(right / step) + 2, bool)
    for a, b in spans:
        free[max(0, math.floor(a / step)) : math.floor(b / step) + 1] = False
    edge = np.flatnonzero(np.diff(np.concatenate(([0], free.astype(np.int8), [0]))))
    found = [(a * step, min(b * step, math.ceil(right))) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()) if b - a >= max(2, math.ceil(GUTTER / step))]
    return [(a, b) for a, b in found if a >= left and b <= right]


def columns_of(lines: list[dict], width: float) -> list[tuple[float, float]]:
    """The page's column regions (left, right): bands of lines vote for gutters with their number of lines."""
    if not lines:
        return [(0, width)]
    step = max(2, math.floor(width / 240 + 0.5))
    band = max(1.0, max(x["bottom"] for x in lines) / BANDS)
    by_band: dict[int, list[dict]] = {}
    for x in lines:
        if 0 <= x["baseline"] < band * BANDS:
            by_band.setdefault(math.floor(x["baseline"] / band), []).append(x)
    votes: dict[tuple[int, int], list] = {}
    for _, ls in sorted(by_band.items()):
        spans = [(p["x"], p["right"]) for x in ls for p in x["parts"]]
        for a, b in gaps_between(spans, width) if len(ls) >= 2 and spans else ():
            votes.setdefault((math.floor(a / step + 0.5), math.floor(b / step + 0.5)), [0, a, b])[0] += len(ls)
    enough = max(3, math.ceil(len(lines) * VOTES))
    best = sorted((v for v in votes.values() if v[0] >= enough), key=lambda v: (-v[0], v[1] - v[2]))[: COLUMNS - 1]
    out, at = [], 0.0
    for _, a, b in sorted(best, key=lambda v: v[1]):
        if a > at:
            out.append((at, a))
        at = b
    out = [(a, b) for a, b in [*out, (at, width)] if b - a >= GUTTER]
    return out or [(0, width)]


def column_at(x: float, columns: list[tuple[float, float]]) -> int:
    """The column nearest to x, ties to the left."""
    return min(range(len(columns)), key=lambda i: (max(columns[i][0] - x, x - columns[i][1], 0), i))


def by_column(lines: list[dict], columns: list[tuple[float, float]]) -> list[dict]:
    """The lines with their column; a line whose parts stand in several is cut there, its parts joined by spaces."""
    middle = lambda x: column_at((x["x"] + x["right"]) / 2, columns)
    out = []
    for x in lines:
        groups: dict[int, list[dict]] = {}
        if len(columns) > 1 and len(x["parts"]) > 1:
            for p in x["parts"]:
                groups.setdefault(middle(p), []).append(p)
        if len(groups) < 2:
            out.append(x | {"column": middle(x)})
            continue
        for c, ps in sorted(groups.items()):
            out.append(x | {"column": c, "parts": ps, "text": " ".join(p["text"] for p in ps), "x": min(p["x"] for p in ps), "right": max(p["right"] for p in ps)})
    return out


def beside(a: dict, b: dict) -> bool:
    """Whether a block hugs an image or table: 40 % of the narrower one's width in common, and right above or below it."""
    common = min(a["right"], b["right"]) - max(a["x"], b["x"])
    near = lambda gap: CAPTION_GAPS[0] <= gap <= CAPTION_GAPS[1]
    return common >= 0.4 * min(a["right"] - a["x"], b["right"] - b["x"]) and (near(a["y"] - b["bottom"]) or near(b["y"] - a["bottom"]))


def shared(a: dict, b: dict) -> float:
    """The larger of the shares that the common area has of each box."""
    w, h = min(a["right"], b["right"]) - max(a["x"], b["x"]), min(a["bottom"], b["bottom"]) - max(a["y"], b["y"])
    area = lambda r: max(1.0, (r["right"] - r["x"]) * (r["bottom"] - r["y"]))
    return max(w * h / area(a), w * h / area(b)) if w > 0 and h > 0 else 0.0


def box_of(ls: list[dict]) -> dict:
    return {"x": min(a["x"] for a in ls), "y": min(a["y"] for a in ls), "right": max(a["right"] for a in ls), "bottom": max(a["bottom"] for a in ls)}


def page_state(runs: list[dict], width: float, height: float, images: list[dict] = (), links: list[dict] = (), rotation: int = 0) -> dict:
    """A page's blocks in reading order, its warnings, characters, and whether it needs OCR.

    images and links are boxes (x, y, right, bottom; links have url). Warnings
    are rotated, needs_ocr, empty, dense, columns, tables, mixed_fonts.
    """
    lines = lines_of(runs)
    chars = sum(len(x["text"]) for x in lines)
    scanned = chars < 3 and len(images) > 0
    weight: Counter = Counter()
    for x in lines:
        weight[math.floor(x["size"] * 2 + 0.5) / 2] += len(x["text"])
    body = max(weight, key=lambda s: (weight[s], -s)) if weight else 12.0
    tables, rest = tables_of(lines)
    columns = columns_of(rest, width)
    # cells that stand in several columns are column text that only looks aligned
    torn = [t for t in tables if len(columns) > 1 and any(len({column_at((p["x"] + p["right"]) / 2, columns) for p in x["parts"]}) > 1 for x in t)]
    tables = [t for t in tables if t not in torn]
    flow = by_column(rest + [x for t in torn for x in t], columns)
    blocks = []
    for c in range(len(columns)):
        paras = paragraphs_of([x for x in flow if x["column"] == c])
        boxes = [box_of(ls) for ls in paras]
        above = [math.inf if i == 0 else boxes[i]["y"] - boxes[i - 1]["bottom"] for i in range(len(paras))]
        for i, ls in enumerate(paras):
            below = above[i + 1] if i + 1 < len(paras) else math.inf
            kind, level, flag = classify(ls, body, height, above[i], below)
            text = "\n".join(x["text"] for x in ls) if kind == "list" else " ".join(x["text"] for x in ls)
            blocks.append(boxes[i] | {"column": c, "lines": ls, "kind": kind, "level": level, "flag": flag, "text": text, "ordered": ls[0]["list"] if kind == "list" else None})
    for ls in tables:
        box = box_of(ls)
        blocks.append(box | {"column": column_at((box["x"] + box["right"]) / 2, columns), "lines": ls, "kind": "table", "level": None, "flag": None, "ordered": None, "text": "\n".join(" | ".join(p["text"] for p in x["parts"]) for x in ls)})
    hugged = [*images, *(b for b in blocks if b["kind"] == "table")]
    for b in blocks:
        if b["kind"] == "paragraph" and len(b["lines"]) <= 2 and sum(len(x["text"]) for x in b["lines"]) <= 200 and any(beside(b, t) for t in hugged):
            b["kind"] = "caption"
    for link in links:
        share, i = max(((shared(b, link), -i) for i, b in enumerate(blocks)), default=(0.0, 0))
        if share >= 0.5 and link.get("url"):
            blocks[-i]["link"] = link["url"]
    out = []
    for b in blocks:
        out.append({k: b.get(k) for k in ("kind", "level", "flag", "text", "ordered", "link", "column", "x", "y", "right", "bottom")} | {"n_lines": len(b["lines"]), "alignment": alignment(b["lines"], b["right"] - b["x"]), "wide": b["right"] - b["x"] >= 0.6 * width})
    band = 0
    for b in sorted(out, key=lambda b: (b["y"], b["x"])):
        band += b["wide"]
        b["band"] = band
    out.sort(key=lambda b: (b["band"], not b["wide"], b["column"], b["y"], b["x"]))
    warnings = [
        name
        for name, holds in (
            ("rotated", rotation % 360 != 0), ("needs_ocr", scanned), ("empty", chars < 3 and not scanned), ("dense", len(out) > 60 or len(lines) > 150),
            ("columns", len(columns) > 1 and not scanned), ("tables", bool(tables)), ("mixed_fonts", sum(n >= 8 for n in weight.values()) >= 5),
        )
        if holds
    ]
    return {"blocks": out, "warnings": warnings, "requires_ocr": scanned, "chars": chars, "columns": len(columns)}


def analyze(runs: list[dict], width: float, height: float) -> list[dict]:
    """The blocks of a page in reading order: bands opened by wide blocks, within them column by column, top to bottom."""
    return page_state(runs, width, height)["blocks"]


def analyze_pages(runs: DataFrame, width: float = 595.0, height: float = 842.0) -> DataFrame:
    """(document_id, page_index, reading_order, kind, level, flag, ordered, n_lines, alignment, text) of each page.

    runs: document_id, page_index, text, x, y, width, height, font_size, font_key.
    A page is the unit of work; pages without runs give no row.
    """
    cols = ["text", "x", "y", "width", "height", "font_size", "font_key"]
    pages = runs.groupBy("document_id", "page_index").agg(F.sort_array(F.collect_list(F.struct(*[F.coalesce(c, F.lit("" if c in ("text", "font_key") else 0.0)).alias(c) for c in cols]))).alias("rs"))

    def make():
        def kernel(docs, indexes, lists):
            out = [[] for _ in range(10)]
            for d, p, rs in zip(docs, indexes, lists):
                for i, b in enumerate(analyze(rs, width, height)):
                    for col, v in zip(out, (d, p, i, b["kind"], b["level"], b["flag"], b["ordered"], b["n_lines"], b["alignment"], b["text"])):
                        col.append(v)
            return out

        return kernel

    return map_rows(pages, "document_id string, page_index int, reading_order int, kind string, level int, flag string, ordered boolean, n_lines int, alignment string, text string", make)


def page_states(runs: DataFrame, width: float = 595.0, height: float = 842.0) -> DataFrame:
    """(document_id, page_index, warnings, requires_ocr, chars, columns, blocks) of each page of analyze_pages()' input."""
    cols = ["text", "x", "y", "width", "height", "font_size", "font_key"]
    pages = runs.groupBy("document_id", "page_index").agg(F.sort_array(F.collect_list(F.struct(*[F.coalesce(c, F.lit("" if c in ("text", "font_key") else 0.0)).alias(c) for c in cols]))).alias("rs"))

    def make():
        def kernel(docs, indexes, lists):
            out = [[] for _ in range(7)]
            for d, p, rs in zip(docs, indexes, lists):
                got = page_state(rs, width, height)
                for col, v in zip(out, (d, p, got["warnings"], got["requires_ocr"], got["chars"], got["columns"], len(got["blocks"]))):
                    col.append(v)
            return out

        return kernel

    return map_rows(pages, "document_id string, page_index int, warnings array<string>, requires_ocr boolean, chars int, columns int, blocks int", make)
