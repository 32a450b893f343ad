"""Export: blocks joined with their translations, rendered as text, Markdown, HTML, JSON and DOCX, and checked."""

from __future__ import annotations

import io
import zipfile
from html import escape

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.arrow import map_rows
from folioflow.functions import text as T


def shown(translated: Column, source: Column) -> Column:
    """The translation, or the source where there is none."""
    return F.coalesce(F.when(T.trim(translated) != "", translated), source)


def numbered(blocks: DataFrame) -> DataFrame:
    """Blocks with counter: the number of an ordered list item, which anything else resets."""
    w = Window.partitionBy("document_id").orderBy("order_index")
    is_item = F.coalesce(F.col("list_ordered"), F.lit(False)) & F.col("heading").isNull()
    b = blocks.withColumn("_item", is_item.cast("int")).withColumn("_run", F.sum(1 - F.col("_item")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("document_id", "_run").orderBy("order_index").rowsBetween(Window.unboundedPreceding, 0)
    return b.withColumn("counter", F.sum("_item").over(run)).drop("_item", "_run")


def text_lines(b: DataFrame) -> Column:
    """The plain-text rendering of a block."""
    t, h = F.col("text"), F.col("heading")
    rule = F.repeat(F.when(h <= 2, F.lit("=")).otherwise(F.lit("-")), F.least(F.lit(60), F.greatest(F.lit(3), F.length(t))))
    link = F.when(F.col("link").isNotNull() & ~F.contains(t, F.col("link")), F.concat(t, F.lit(" <"), F.col("link"), F.lit(">"))).otherwise(t)
    return (
        F.when(h.isNotNull(), F.concat(t, F.lit("\n"), rule, F.lit("\n\n")))
        .when(F.col("is_table"), F.concat(t, F.lit("\n\n")))
        .when(F.col("list_ordered"), F.concat(F.col("counter").cast("string"), F.lit(". "), t, F.lit("\n")))
        .when(~F.col("list_ordered"), F.concat(F.lit("• "), t, F.lit("\n")))
        .otherwise(F.concat(link, F.lit("\n\n")))
    )


def markdown_lines(b: DataFrame) -> Column:
    """The Markdown rendering of a block."""
    t, h = F.col("text"), F.col("heading")
    linked = F.when(F.col("link").isNotNull(), F.concat(F.lit("["), t, F.lit("]("), F.col("link"), F.lit(")"))).otherwise(t)
    return (
        F.when(h.isNotNull(), F.concat(F.repeat(F.lit("#"), h), F.lit(" "), t, F.lit("\n\n")))
        .when(F.col("is_table"), F.concat(F.col("md_table"), F.lit("\n\n")))
        .when(F.col("list_ordered"), F.concat(F.col("counter").cast("string"), F.lit(". "), linked, F.lit("\n")))
        .when(~F.col("list_ordered"), F.concat(F.lit("- "), linked, F.lit("\n")))
        .otherwise(F.concat(linked, F.lit("\n\n")))
    )


def html_table(cells: Column, text: Column) -> Column:
    """A table of rows and cells, the first row as its head; the escaped text as one cell where there are none."""
    none = F.array().cast("array<string>")

    def row(r, tag):
        return F.concat(F.lit("<tr>"), F.array_join(F.transform(F.coalesce(r, none), lambda c: F.concat(F.lit(f"<{tag}>"), T.escape_html(F.coalesce(c, F.lit(""))), F.lit(f"</{tag}>"))), ""), F.lit("</tr>\n"))

    body = F.array_join(F.transform(F.slice(cells, 2, F.greatest(F.lit(0), F.size(cells) - 1)), lambda r: row(r, "td")), "")
    full = F.concat(F.lit("<table>\n<thead>\n"), row(F.get(cells, F.lit(0)), "th"), F.lit("</thead>\n<tbody>\n"), body, F.lit("</tbody>\n</table>\n"))
    return F.when(F.coalesce(F.size(cells), F.lit(0)) > 0, full).otherwise(F.concat(F.lit("<table>\n<tbody>\n<tr><td>"), text, F.lit("</td></tr>\n</tbody>\n</table>\n")))


def html_lines(b: DataFrame) -> Column:
    """The HTML rendering of a block; lists open and close by their neighbours."""
    w = Window.partitionBy("document_id", "page_index").orderBy("order_index")
    lo = F.when(F.col("heading").isNull() & ~F.col("is_table"), F.col("list_ordered"))
    tag = F.when(lo, "ol").when(~lo, "ul")
    before, after = F.lag(tag).over(w), F.lead(tag).over(w)
    opens = F.when(tag.isNotNull() & ~tag.eqNullSafe(before), F.concat(F.lit("<"), tag, F.lit(">\n"))).otherwise("")
    shuts = F.when(tag.isNotNull() & ~tag.eqNullSafe(after), F.concat(F.lit("</"), tag, F.lit(">\n"))).otherwise("")
    t = T.escape_html(F.col("text"))
    content = F.when(F.col("link").isNotNull(), F.concat(F.lit('<a href="'), T.escape_html(F.col("link")), F.lit('">'), t, F.lit("</a>"))).otherwise(t)
    style = F.when(F.coalesce(F.col("alignment"), F.lit("left")) == "left", "").otherwise(F.concat(F.lit(' style="text-align:'), F.col("alignment"), F.lit('"')))
    h = F.col("heading").cast("string")
    return (
        F.when(h.isNotNull(), F.concat(F.lit("<h"), h, F.lit(">"), t, F.lit("</h"), h, F.lit(">\n")))
        .when(F.col("is_table"), html_table(F.col("cells"), t))
        .when(tag.isNotNull(), F.concat(opens, F.lit("<li>"), content, F.lit("</li>\n"), shuts))
        .otherwise(F.concat(F.lit("<p"), style, F.lit(">"), content, F.lit("</p>\n")))
    )


def render(blocks: DataFrame, documents: DataFrame, kind: str) -> DataFrame:
    """(document_id, body): each document in one format: text, markdown or html.

    blocks: document_id, page_index, order_index, text, heading, is_table,
    md_table, cells (array<array<string>>), list_ordered, link, alignment. Blocks are joined in order, pages
    parted by the format's separator; documents without blocks keep their head.
    """
    lines = {"text": text_lines, "markdown": markdown_lines, "html": html_lines}[kind]
    between = {"text": "\f\n", "markdown": "\n---\n\n", "html": '<hr class="page">\n'}[kind]
    b = numbered(blocks if "cells" in blocks.columns else blocks.withColumn("cells", F.lit(None).cast(MEMBERS["cells"])))
    b = b.withColumn("line", lines(b))
    pages = b.groupBy("document_id", "page_index").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("order_index", "line"))), lambda x: x["line"]), "").alias("page"))
    bodies = pages.groupBy("document_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_index", "page"))), lambda x: x["page"]), between).alias("body"))
    title, target = F.coalesce("title", F.lit("")), F.coalesce("target_language", F.lit(""))
    head = {
        "text": F.concat(title, F.lit("\n"), target, F.lit("\n\n")),
        "markdown": F.concat(F.lit("# "), title, F.lit("\n\n"), target, F.lit("\n\n")),
        "html": F.concat(F.lit('<!DOCTYPE html>\n<html lang="'), T.escape_html(target), F.lit('">\n<head><meta charset="utf-8"><title>'), T.escape_html(title), F.lit("</title></head>\n<body>\n")),
    }[kind]
    tail = "</body>\n</html>\n" if kind == "html" else ""
    docs = documents.groupBy("document_id").agg(F.max("title").alias("title"), F.max("target_language").alias("target_language"))
    full = F.concat(head, F.coalesce("body", F.lit("")), F.lit(tail))
    return docs.join(bodies, "document_id", "left").select("document_id", (full if kind == "html" else F.regexp_replace(full, r"\n{3,}", "\n\n")).alias("body"))


#: The members of a block in the envelope, with their types.
MEMBERS = {
    "order_index": "int", "page_index": "int", "kind": "string", "text": "string", "heading": "int", "list_ordered": "boolean", "link": "string", "alignment": "string", "flags": "array<string>",
    "bbox": "struct<x:double,y:double,width:double,height:double>", "font": "struct<family:string,size:double,bold:boolean,italic:boolean>", "cells": "array<array<string>>",
}


def serialize(blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """(document_id, json): a versioned envelope of each document's pages and blocks; members of MEMBERS that blocks lacks are null."""
    member = [(F.col(k) if k in blocks.columns else F.lit(None)).cast(t).alias(k) for k, t in MEMBERS.items()]
    b = blocks.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct(*member))).alias("blocks"))
    docs = documents.groupBy("document_id").agg(F.max("title").alias("title"), F.max("source_language").alias("source_language"), F.max("target_language").alias("target_language"))
    j = docs.join(b, "document_id", "left")
    return j.select("document_id", F.to_json(F.struct(F.lit("document-export").alias("format"), F.lit(1).alias("version"), "document_id", "title", "source_language", "target_language", F.coalesce("blocks", F.array().cast(dict(j.dtypes)["blocks"])).alias("blocks"))).alias("json"))


def restore(serialized: DataFrame) -> DataFrame:
    """Blocks from serialize()'s envelopes; malformed ones and other versions give no row."""
    inner = ",".join(f"{k}:{t}" for k, t in MEMBERS.items())
    x = serialized.select(F.from_json("json", f"format string, version int, document_id string, blocks array<struct<{inner}>>").alias("d")).where("d.format = 'document-export' AND d.version = 1 AND d.document_id IS NOT NULL")
    return x.select("d.document_id", F.explode("d.blocks").alias("b")).select("document_id", "b.*")


def probe(files: DataFrame) -> DataFrame:
    """(name, kind, valid): whether a rendered file is what it claims to be: JSON that parses, HTML with its tags, others not empty."""
    body = F.col("body")
    ok = F.when(F.col("kind") == "json", F.try_parse_json(body).isNotNull()).when(F.col("kind") == "html", F.contains(body, F.lit("<html")) & F.contains(body, F.lit("</html>"))).otherwise(F.length(body) > 0)
    return files.select("name", "kind", (F.coalesce(F.length(body) > 0, F.lit(False)) & F.coalesce(ok, F.lit(False))).alias("valid"))


_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(blocks: list[dict]) -> bytes:
    """A DOCX file of a document's blocks: headings, numbered and plain lists, tables, links, a page break before each later page."""
    links: list[str] = []

    def runs(text):
        return "<w:br/>".join(f'<w:t xml:space="preserve">{escape(x, quote=False)}</w:t>' for x in (text or "").split("\n"))

    def para(b):
        style = ""
        if b.get("heading"):
            style = f'<w:pPr><w:pStyle w:val="Heading{b["heading"]}"/></w:pPr>'
        elif b.get("list_ordered") is not None:
            style = f'<w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="{1 if b["list_ordered"] else 2}"/></w:numPr></w:pPr>'
        run = f"<w:r>{runs(b['text'])}</w:r>"
        if b.get("link"):
            links.append(b["link"])
            run = f'<w:hyperlink r:id="l{len(links)}">{run}</w:hyperlink>'
        return f"<w:p>{style}{run}</w:p>"

    def grid(b):
        rows = ("".join(f"<w:tc><w:p><w:r>{runs(c)}</w:r></w:p></w:tc>" for c in r or [""]) for r in b["cells"])
        return f"<w:tbl>{''.join(f'<w:tr>{r}</w:tr>' for r in rows)}</w:tbl>"

    parts, page = [], None
    for b in blocks:
        if page is not None and b.get("page_index") is not None and b["page_index"] != page:
            parts.append('<w:p><w:r><w:br w:type="page"/></w:r></w:p>')
        page = b.get("page_index", page)
        parts.append(grid(b) if b.get("is_table") and b.get("cells") else para(b))
    base = "application/vnd.openxmlformats-officedocument.wordprocessingml"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    rels = "http://schemas.openxmlformats.org/package/2006/relationships"
    level = lambda n, kind, mark: f'<w:abstractNum w:abstractNumId="{n}"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="{kind}"/><w:lvlText w:val="{mark}"/></w:lvl></w:abstractNum>'
    files = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        f'<Override PartName="/word/document.xml" ContentType="{base}.document.main+xml"/><Override PartName="/word/numbering.xml" ContentType="{base}.numbering+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{rels}"><Relationship Id="r1" Type="{office}/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/document.xml": f'<w:document {_W} xmlns:r="{office}"><w:body>{"".join(parts)}</w:body></w:document>',
        "word/numbering.xml": f'<w:numbering {_W}>{level(0, "decimal", "%1.")}{level(1, "bullet", "•")}<w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="1"/></w:num></w:numbering>',
        "word/_rels/document.xml.rels": f'<Relationships xmlns="{rels}"><Relationship Id="n1" Type="{office}/numbering" Target="numbering.xml"/>'
        + "".join(f'<Relationship Id="l{i}" Type="{office}/hyperlink" Target="{escape(u)}" TargetMode="External"/>' for i, u in enumerate(links, 1))
        + "</Relationships>",
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, part in files.items():
            z.writestr(zipfile.ZipInfo(name), f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>{part}')
    return out.getvalue()


def render_docx(blocks: DataFrame) -> DataFrame:
    """(document_id, content): each document as a DOCX file."""
    b = blocks.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("order_index", *[c for c in ("page_index", "text", "heading", "list_ordered", "link", "is_table", "cells") if c in blocks.columns]))).alias("bs"))

    def make():
        return lambda ids, lists: [ids, [docx(x) for x in lists]]

    return map_rows(b, "document_id string, content binary", make)


def findings(documents: DataFrame, blocks: DataFrame) -> DataFrame:
    """(document_id, code, severity, n): what would stop or mar an export.

    no_pages, title_missing, missing_text (blocks without any text) and
    untranslated (blocks shown in the source's words).
    """
    docs = documents.groupBy("document_id").agg(F.max("title").alias("title"))
    per = blocks.groupBy("document_id").agg(
        F.count("*").alias("blocks"), F.count_if(F.coalesce(T.trim(F.col("text")), F.lit("")) == "").alias("missing"), F.count_if(F.coalesce(T.trim(F.col("translated_text")), F.lit("")) == "").alias("untranslated")
    )
    j = docs.join(per, "document_id", "left")
    f = lambda code, severity, n: F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), n.cast("bigint").alias("n"))
    every = F.array(
        f("no_pages", "error", F.when(F.col("blocks").isNull(), 1)), f("title_missing", "warning", F.when(F.coalesce(T.trim(F.col("title")), F.lit("")) == "", 1)),
        f("missing_text", "error", F.col("missing")), f("untranslated", "warning", F.col("untranslated")),
    )
    return j.select("document_id", F.explode(F.filter(every, lambda x: x["n"] > 0)).alias("f")).select("document_id", "f.*")
