"""Problem 3: text cut off by field limits.

The ends of all texts show which last words and shapes finish a text; the
lengths of all texts, recounted in other encodings and escapings, show hidden
limits at which unfinished texts pile up in one source. A record is truncated
if its end is broken by itself (a replacement character, an open quotation,
bracket, JSON string or object), or stands at such a limit, or is a fragment
that finishes nothing elsewhere.
"""

from __future__ import annotations

import html
import json
import math
import re
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.arrow import map_rows

THAI, BURMESE, HAN = "฀-๿", "က-႟", "぀-ヿ㐀-鿿ー々〇"
#: Marks that close a text.
STOP = re.compile(r"[.!?。！？။।؟:;)\]}>\"'”’»」』）`|*_]$")
OPEN = {"“": "”", "«": "»", "「": "」", "『": "』", "„": "“", "(": ")", "（": "）"}
SHUT = set("”»」』“)）")

#: Lengths recounted: how a limit may have counted the text it cut.
COUNTS = {
    "chars": len,
    "utf8": lambda t: len(t.encode("utf-8", "replace")),
    "utf16": lambda t: len(t.encode("utf-16-le", "replace")) // 2,
    "entities": lambda t: len(html.escape(t)),
    "json": lambda t: len(json.dumps(t, ensure_ascii=False)) - 2,
    "json_ascii": lambda t: len(json.dumps(t)) - 2,
    "crlf": lambda t: len(t) + t.count("\n"),
}


def open_marks(text: str) -> int:
    """Quotations and brackets left open at the end, by a stack; stray closing marks are passed over."""
    stack: list[str] = []
    for c in text:
        if c in SHUT and stack and c == stack[-1]:
            stack.pop()
        elif c in OPEN:
            stack.append(OPEN[c])
        elif c == "\n" and stack and stack[-1] in ")）":
            pass
    return len(stack)


def json_end(text: str) -> str | None:
    """'open' if a JSON value begins in the text and doesn't end, 'done' if it does, None if none begins."""
    starts = [p for p in (text.find("{"), text.find("[{")) if p >= 0]
    if not starts:
        return None
    depth, inside, escaped = 0, False, False
    for c in text[min(starts) :]:
        if inside:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                inside = False
        elif c == '"':
            inside = True
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if depth == 0:
                return "open" if text.count("```") % 2 else "done"
    return "open"


def tail_key(text: str) -> str:
    """What ends the text, for counting: its last word with digits as 0, or the last letters of scripts without spaces (six, three of Han and kana)."""
    t = text.rstrip()
    if re.search(f"[{THAI}{BURMESE}{HAN}]", t[-6:]):
        x = re.sub(r"\d+", "0", re.sub(rf"[^\w{THAI}{BURMESE}]+$", "", t[-24:]))
        if x.endswith("0"):
            return x[-4:]
        return x[-3:] if re.search(f"[{HAN}]", x[-3:]) else x[-6:]
    m = re.search(r"[^\W_][\w'’.,-]*[^\w\s]*$|\S+$", t[-48:])
    return re.sub(r"\d", "0", re.sub(r"[^\w]+$", "", m.group()) if m else "")[-32:]


def line_key(text: str) -> str:
    """The shape of the last line: its marks and number of cells, with the length of digits in the last one."""
    line = text.rstrip().rsplit("\n", 1)[-1]
    if "|" in line:
        cells = line.split("|")
        return f"|{len(cells)}|{re.sub(r'[0-9]', '0', cells[-1].strip() or cells[-2].strip())[-8:]}"
    return ""


def assess(text: str, structured: bool) -> tuple[str, str, bool]:
    """(verdict, key, stopped): verdict 'cut', 'whole' or 'ask'; key counts the end; stopped if a mark closes the text."""
    t = text.rstrip()
    if not re.search(r"\w", t):
        return "whole", "", False
    if structured:
        state = json_end(t)
        if state == "open":
            return "cut", "", False
        if state == "done":
            return "whole", "", True
    if t[-1] == "�":
        return "cut", "", False
    last = t.rsplit("\n\n", 1)[-1]
    if t.endswith("…") and not t.endswith("……"):
        return ("ask" if re.search(r"\s…$|[.!?]…$", t) else "cut"), tail_key(t[:-1]), False
    if t.endswith("..."):
        return "cut", "", False
    if CODE_LINE.search(last.rsplit("\n", 1)[-1]):
        return "whole", "", bool(STOP.search(t))  # program text may end anyhow
    key = line_key(last) or tail_key(last)
    if open_marks(last):
        return "cut", key, False
    return "ask", key, bool(STOP.search(t))


#: A line of program text: statement ends, arrows, calls, flags of commands, keywords before names; brackets in it may stay open.
CODE_LINE = re.compile(r"[{};]$|=>|->|\(\)|\w\.\w+\(|\s--\w|^\s*(?:const|let|var|def|class|import|return|for|while|if|SELECT|INSERT|UPDATE)\s+\w+.*[=({*;]")

#: A limit is a length, round or not, at which a source has so many unfinished texts, and more than the rate of the lengths within NEAR
#: of it explains: a Poisson count of that rate is as high with a probability of at most CHANCE.
LIMIT_TEXTS, NEAR, CHANCE = 3, 10, 1e-5


def records(results: DataFrame, blocks: DataFrame, calls: DataFrame) -> DataFrame:
    """(record_kind, record_id, provider, project_id, structured, text) of both kinds; each result once.

    blocks must already be the newest rows. Null texts are left out; results
    without a known call have a null project.
    """
    r = results.where("result_id IS NOT NULL AND text IS NOT NULL").select("result_id", "call_id", "provider_id", "structured", "text").dropDuplicates(["result_id"])
    c = calls.where("call_id IS NOT NULL").groupBy("call_id").agg(F.max("project_id").alias("project_id"))
    r = r.join(c, "call_id", "left").select(
        F.lit("generate_result").alias("record_kind"), F.col("result_id").alias("record_id"), F.col("provider_id").alias("provider"), "project_id", F.coalesce("structured", F.lit(False)).alias("structured"), "text"
    )
    b = blocks.where("translated_text IS NOT NULL").select(
        F.lit("export_block").alias("record_kind"), F.col("block_id").alias("record_id"), F.lit(None).cast("string").alias("provider"), "project_id", F.lit(False).alias("structured"), F.col("translated_text").alias("text")
    )
    return r.unionByName(b)


MEASURED = "record_kind string, record_id string, provider string, project_id string, verdict string, key string, stopped boolean, counts array<string>, text_hash bigint"


def measure_text(text: str, structured: bool) -> tuple:
    """(verdict, key, stopped, counts, text_hash) of one text; counts of texts of any length, but only where a limit could have cut them."""
    verdict, key, stopped = assess(text, structured)
    counts = [f"{n}={f(text)}" for n, f in COUNTS.items()] if not stopped and verdict != "whole" else None
    return verdict, key if verdict == "ask" else None, stopped, counts, zlib.crc32(text.encode("utf-8", "surrogatepass"))


def measure(texts: DataFrame) -> DataFrame:
    """Each record's verdict by its own end, key, and recounted lengths, without its text."""

    def make():
        def kernel(kind, rid, provider, project, structured, text):
            made = [measure_text(t, s) for t, s in zip(text, structured)]
            return [kind, rid, provider, project, *map(list, zip(*made))]

        return kernel

    return map_rows(texts.select("record_kind", "record_id", "provider", "project_id", "structured", "text"), MEASURED, make)


def hidden_limits(measured: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(record_kind, source, unit, length, n, n_near): lengths at which unfinished texts of a source pile up.

    Unfinished is what breaks off by its own end or ends as no text is known
    to end (known, of final_keys()): headings of one length are no limit. Only
    different texts count, as a short text that comes again and again says
    nothing of a limit. n_near counts the texts within NEAR, n among them. The rate is that of the
    other lengths there, with one text more, so that an empty neighbourhood
    has a rate too; the probability is Chernoff's bound, never too small.
    """
    source = F.coalesce("provider", "project_id", F.lit(""))
    known = (final_keys(measured) if known is None else known).select("key", F.lit(True).alias("is_known"))
    at = (
        measured.where("NOT stopped AND counts IS NOT NULL AND verdict <> 'whole'")
        .join(known, "key", "left")
        .where("verdict = 'cut' OR is_known IS NULL")
        .select("record_kind", source.alias("source"), "text_hash", F.explode("counts").alias("c"))
        .select("record_kind", "source", "text_hash", F.split_part("c", F.lit("="), F.lit(1)).alias("unit"), F.split_part("c", F.lit("="), F.lit(2)).cast("int").alias("length"))
        .groupBy("record_kind", "source", "unit", "length", "text_hash")
        .agg(F.lit(1).alias("one"))
        .groupBy("record_kind", "source", "unit", "length")
        .agg(F.count("*").alias("n"))
    )
    from pyspark.sql import Window

    w = Window.partitionBy("record_kind", "source", "unit").orderBy("length").rangeBetween(-NEAR, NEAR)
    rate = (F.col("n_near") - F.col("n") + 1) / (2 * NEAR)
    excess = F.col("n") * F.log(F.col("n") / rate) - F.col("n") + rate
    return at.withColumn("n_near", F.sum("n").over(w)).where((F.col("n") >= LIMIT_TEXTS) & (F.col("n") > rate) & (excess >= -math.log(CHANCE)))


#: An end finishes texts if it has a closing mark in this share of the closed texts of its writing, or none in this share of
#: the open ones; texts without word spaces end in fewer ways. CLOSED_LEAST and OPEN_LEAST texts at least.
CLOSED_SHARE, OPEN_SHARE, OPEN_SHARE_UNSPACED, CLOSED_LEAST, OPEN_LEAST = 1e-4, 1.5e-3, 5e-3, 2, 3


def final_keys(measured: DataFrame) -> DataFrame:
    """(key, closed): ends that finish texts: some with a closing mark (closed), or many without."""
    keys = measured.where("verdict = 'ask' AND key IS NOT NULL AND key <> ''").groupBy("key").agg(F.count_if("stopped").alias("n_stopped"), F.count_if(~F.col("stopped")).alias("n_open"))
    row = F.col("key").startswith("|")
    kind = F.when(row | F.col("key").rlike(r"^[\d|., ]*$"), "row").when(F.col("key").rlike("[฀-๿]"), "th").when(F.col("key").rlike("[က-႟]"), "my").when(F.col("key").rlike("[぀-ヿ㐀-鿿]"), "han").otherwise("spaced")
    keys = keys.withColumn("kind", kind)
    every = keys.groupBy("kind").agg(F.sum("n_stopped").alias("_closed"), F.sum("n_open").alias("_open"))
    share = F.when(F.col("kind") == "spaced", OPEN_SHARE).otherwise(OPEN_SHARE_UNSPACED)
    return (
        keys.join(F.broadcast(every), "kind")  # five rows
        .withColumn("closed", (F.col("n_stopped") >= F.greatest(F.lit(CLOSED_LEAST), F.col("_closed") * CLOSED_SHARE)) | F.col("key").startswith("|"))
        .where(F.col("closed") | (F.col("n_open") >= F.greatest(F.lit(OPEN_LEAST), F.col("_open") * share)) | (F.col("kind") == "row"))
        .select("key", "closed")
    )


def truncated(measured: DataFrame) -> DataFrame:
    """The truncated records: record_kind, record_id, provider, project_id, reason ('end', 'limit' or 'fragment').

    measured: of measure(); every row is judged against counts over all rows.
    A closing mark makes a text whole unless its own end says otherwise; an end
    that never has one elsewhere counts as cut at a hidden limit, and otherwise
    only if it is rare. Texts
    without a word are whole. An empty table gives no row.
    """
    ask = measured.where("verdict = 'ask' AND NOT stopped")
    known = final_keys(measured)
    limits = hidden_limits(measured, known).select("record_kind", "source", F.concat_ws("=", "unit", F.col("length").cast("string")).alias("c")).distinct()
    source = F.coalesce("provider", "project_id", F.lit(""))
    at_limit = (
        ask.where("counts IS NOT NULL").select("record_kind", "record_id", source.alias("source"), F.explode("counts").alias("c")).join(limits, ["record_kind", "source", "c"], "left_semi").select("record_kind", "record_id").distinct().withColumn("at_limit", F.lit(True))
    )
    asked = ask.join(known, "key", "left").join(at_limit, ["record_kind", "record_id"], "left").where("key <> '' AND (closed IS NULL OR (at_limit AND NOT closed))")
    cols = ("record_kind", "record_id", "provider", "project_id")
    return (
        measured.where("verdict = 'cut'")
        .select(*cols, F.lit("end").alias("reason"))
        .unionByName(asked.select(*cols, F.when(F.col("at_limit"), "limit").otherwise("fragment").alias("reason")))
    )


def rates(measured: DataFrame, cut: DataFrame) -> DataFrame:
    """(record_kind, provider, project_id, n, n_truncated, share, n_end, n_limit, n_fragment): per provider and per project, with the rows that each reason gives."""
    m = measured.select("record_kind", "record_id", "provider", "project_id").join(cut.select("record_kind", "record_id", "reason"), ["record_kind", "record_id"], "left")
    return (
        m.groupingSets([["record_kind", "provider"], ["record_kind", "project_id"]], "record_kind", "provider", "project_id")
        .agg(F.count("*").alias("n"), F.count("reason").alias("n_truncated"), *[F.count_if(F.col("reason") == r).alias(f"n_{r}") for r in ("end", "limit", "fragment")])
        .withColumn("share", F.col("n_truncated") / F.col("n"))
    )
