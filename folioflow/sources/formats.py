"""Text, Markdown, HTML and DOCX sources: raw documents to structured blocks.

Each parser is a pure function from text to blocks; ``parse_documents`` runs
them over a table in Arrow batches.
"""

from __future__ import annotations

import html
import io
import re
import xml.etree.ElementTree as ET
import zipfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.arrow import map_rows

#: Accepted extensions and size limits in bytes.
EXTENSIONS = ("pdf", "docx", "txt", "md", "markdown", "html", "htm", "json", "csv")
MOST_BYTES, MOST_TEXT_BYTES = 200 * 1024 * 1024, 64 * 1024 * 1024

#: The line forms of Markdown.
HEADING = re.compile(r"(#{1,6})\s+(.+?)\s*#*\s*")
RULE = re.compile(r"\s{0,3}(?:-{3,}|\*{3,}|_{3,})\s*")
UNDERLINE = re.compile(r"\s{0,3}(?:=+|-+)\s*")
FENCE = re.compile(r"\s{0,3}(```|~~~)")
ITEM = re.compile(r"(\s*)(?:(\d{1,3})[.)]|([၀-၉]{1,4})[.)။]|([-*+]))\s+(.*)")
SEPARATOR = re.compile(r"\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*")
QUOTE = re.compile(r"\s*>")
SCHEMA = "pos int, kind string, text string, level int, ordered boolean, table_rows array<array<string>>, bold boolean, italic boolean"


def block(kind: str, text: str, level=None, ordered=None, rows=None, bold=None, italic=None) -> dict:
    return {"kind": kind, "text": text, "level": level, "ordered": ordered, "table_rows": rows, "bold": bold, "italic": italic}


def unmarked(line: str) -> str:
    """A line without the marks of quotes, emphasis and code."""
    line = re.sub(r"^\s*>\s?", "", line)
    for mark in (r"\*\*", "__", r"\*", "_", "`"):
        inner = mark[-1]
        line = re.sub(rf"{mark}([^{inner}]+){mark}", r"\1", line)
    return line.strip()


def item_of(line: str) -> tuple[bool, str, int] | None:
    """(ordered, line with its marker, depth) of a list line."""
    m = ITEM.fullmatch(line)
    if not m or m[4] and RULE.fullmatch(line):
        return None
    marker = f"{m[2]}." if m[2] else f"{m[3]}။" if m[3] else m[4]
    return bool(m[2] or m[3]), f"{marker} {m[5]}", min(6, len(m[1]) // 2)


def cells(line: str) -> list[str]:
    line = line.strip()
    return [c.strip() for c in line[line.startswith("|") : len(line) - line.endswith("|") if len(line) > 1 else None].split("|")]


class Lines:
    """Lines with a position, read in runs."""

    def __init__(self, raw: str):
        self.all = re.sub(r"\r\n?", "\n", raw).split("\n")
        self.at = 0

    def peek(self, ahead: int = 0) -> str | None:
        i = self.at + ahead
        return self.all[i] if i < len(self.all) else None

    def while_(self, test) -> list[str]:
        start = self.at
        while self.at < len(self.all) and test(self.all[self.at]):
            self.at += 1
        return self.all[start : self.at]


def parse_markdown(raw: str) -> list[dict]:
    """Blocks by precedence: fence, heading, underlined heading, rule, table, quote, list, paragraph."""
    src, out, open_ = Lines(raw), [], []

    def close():
        text = " ".join(map(unmarked, open_)).strip()
        if text:
            out.append(block("paragraph", text))
        open_.clear()

    while (line := src.peek()) is not None:
        after = src.peek(1)
        if m := FENCE.match(line):
            close()
            src.at += 1
            body = src.while_(lambda x, f=m[1]: not x.strip().startswith(f))
            src.at += 1
            out.append(block("code", "\n".join(body), bold=False))
        elif m := HEADING.fullmatch(line):
            close()
            out.append(block("heading", unmarked(m[2]), level=len(m[1]), bold=True))
            src.at += 1
        elif line.strip() and after is not None and UNDERLINE.fullmatch(after):
            close()
            out.append(block("heading", unmarked(line), level=1 if "=" in after else 2, bold=True))
            src.at += 2
        elif RULE.fullmatch(line):
            close()
            src.at += 1
        elif "|" in line and after is not None and SEPARATOR.fullmatch(after):
            close()
            src.at += 2
            out.append(block("table", "", rows=[cells(line), *map(cells, src.while_(lambda x: "|" in x))]))
        elif QUOTE.match(line):
            close()
            out.append(block("quote", "\n".join(map(unmarked, src.while_(QUOTE.match))), italic=True))
        elif item := item_of(line):
            close()
            run = src.while_(lambda x, o=item[0]: (i := item_of(x)) is not None and i[0] == o)
            out.append(block("list", "\n".join("  " * d + t for _, t, d in map(item_of, run)), ordered=item[0]))
        elif not line.strip():
            close()
            src.at += 1
        else:
            open_.append(line.strip())
            src.at += 1
    close()
    return out


def parse_html(raw: str) -> list[dict]:
    """The text of a page: scripts, styles and comments dropped, block ends as line ends, then as Markdown."""
    t = re.sub(r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ", raw)
    t = re.sub(r"(?i)</(?:p|div|h[1-6]|li|tr|section|article|header|footer|blockquote)>|<br\s*/?>", "\n", t)
    t = re.sub(r"(?i)<li[^>]*>", "\n- ", t)
    t = re.sub(r"(?i)<h([1-6])[^>]*>", lambda m: "\n" + "#" * int(m[1]) + " ", t)
    t = html.unescape(re.sub(r"<[^>]+>", " ", t)).replace("\xa0", " ")
    lines = (re.sub(r"[ \t]+", " ", x).strip() for x in t.split("\n"))
    return parse_markdown(re.sub(r"\n{3,}", "\n\n", "\n".join(lines)))


def parse_plain(raw: str) -> list[dict]:
    """Paragraphs parted by blank lines, lists, and a capital line among the first blocks as a heading."""
    src, out = Lines(raw), []
    while (line := src.peek()) is not None:
        if not line.strip():
            src.at += 1
        elif item := item_of(line.strip()):
            run = src.while_(lambda x, o=item[0]: bool(x.strip()) and (i := item_of(x.strip())) is not None and i[0] == o)
            out.append(block("list", "\n".join(item_of(x.strip())[1] for x in run), ordered=item[0]))
        else:
            run = [x.strip() for x in src.while_(lambda x: bool(x.strip()) and item_of(x.strip()) is None)]
            text = " ".join(run)
            if len(run) == 1 and len(text) <= 80 and text == text.upper() and re.search("[A-Z]", text) and len(out) < 3:
                out.append(block("heading", text, level=min(3, len(out) + 1), bold=True))
            else:
                out.append(block("paragraph", text))
    return out


_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def parse_docx(data: bytes) -> list[dict]:
    """Paragraphs, headings, lists and tables of a DOCX file, in order; cell paragraphs belong to their table."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_WORD}body")

    def text(node) -> str:
        return "".join(x.text or "" if x.tag == f"{_WORD}t" else "\t" if x.tag == f"{_WORD}tab" else "\n" if x.tag == f"{_WORD}br" else "" for x in node.iter())

    out = []
    for node in body if body is not None else ():
        if node.tag == f"{_WORD}tbl":
            rows = [["\n".join(text(p) for p in c.iter(f"{_WORD}p")) for c in r.iter(f"{_WORD}tc")] for r in node.iter(f"{_WORD}tr")]
            out.append(block("table", "", rows=rows))
        elif node.tag == f"{_WORD}p" and (t := text(node).strip()):
            style = node.find(f".//{_WORD}pStyle")
            name = (style.get(f"{_WORD}val") or "") if style is not None else ""
            m = re.match(r"(?i)heading\s*([1-6])", name)
            if m:
                out.append(block("heading", t, level=int(m[1]), bold=True))
            elif node.find(f".//{_WORD}numPr") is not None:
                out.append(block("list", t, ordered=False))
            else:
                out.append(block("paragraph", t))
    return out


def format_of(name: Column) -> Column:
    """markdown, html, docx or text by the file's extension; a null name is text."""
    low = F.lower(F.coalesce(name, F.lit("")))
    return F.when(low.rlike(r"\.(md|markdown)$"), "markdown").when(low.rlike(r"\.html?$"), "html").when(low.endswith(".docx"), "docx").otherwise("text")


def rejection(name: Column, size: Column) -> Column:
    """Why a file isn't accepted (type, size, empty), or null."""
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    text = ~ext.isin("pdf", "docx")
    return F.when(~F.coalesce(ext, F.lit("")).isin(*EXTENSIONS), "unsupported_type").when((size > MOST_BYTES) | (text & (size > MOST_TEXT_BYTES)), "too_large").when(F.coalesce(size, F.lit(0)) == 0, "empty")


PARSERS = {"markdown": parse_markdown, "html": parse_html, "text": parse_plain}


def parse_documents(docs: DataFrame) -> DataFrame:
    """(document_id, pos, kind, text, level, ordered, table_rows, bold, italic) of text documents.

    docs: document_id, format, raw. Null and empty texts give no row; unknown
    formats are read as plain text.
    """

    def make():
        def kernel(ids, formats, raws):
            out = [[] for _ in range(9)]
            for i, f, r in zip(ids, formats, raws):
                for pos, b in enumerate(PARSERS.get(f, parse_plain)(r) if r else ()):
                    for col, v in zip(out, (i, pos, *b.values())):
                        col.append(v)
            return out

        return kernel

    return map_rows(docs.select("document_id", "format", "raw"), "document_id string, " + SCHEMA, make)


#: Fixed value: bytes of a text file, at most.
MOST_BYTES = 64 * 1024 * 1024


def decode(files: DataFrame) -> DataFrame:
    """The files with text and state: ok, too_large, or undecodable (null or not UTF-8); a byte order mark is dropped."""
    text = F.regexp_replace(F.try_validate_utf8(F.col("content").cast("string")), "^\ufeff", "")
    big = F.length("content") > MOST_BYTES
    return files.withColumn("state", F.when(big, "too_large").when(text.isNull(), "undecodable").otherwise("ok")).withColumn("text", F.when(~big, text))
