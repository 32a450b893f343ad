"""Problem 7: noise in text from scanned pages.

Words are counted over all lines. Each rare word's anagram hash, less the
difference that a confusion of characters makes, is looked up among the
hashes of frequent words in SQL; the corrections are ranked. Lines at the
page's edges in smaller type are furniture, and a word at a line's end is
divided if the corpus has it joined rather than hyphenated.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.arrow import map_rows
from folioflow.tables import settle

#: What scans make of characters (right, wrong); words are compared in lower case.
CONFUSIONS = [
    ("t", "†"), ("e", "c"), ("o", "0"), ("s", "5"), ("i", "!"), ("a", "@"), ("l", "1"), ("g", "9"), ("l", "i"), ("u", "ii"), ("d", "cl"), ("m", "rn"), ("h", "b"),
    ("é", "6"), ("in", "m"), ("w", "vv"), ("b", "8"), ("b", "6"), ("rn", "m"), ("l", "!"), ("i", "1"), ("i", "l"), ("l", "|"), ("d", "ci"), ("d", "c1"), ("ß", "b"), ("ó", "6"), ("fi", "ﬁ"), ("fl", "ﬂ"), ("ü", "ii"), ("u", "!i"), ("in", "rn"), ("ä", "a"), ("ö", "o"), ("ü", "u"), ("é", "e"),
    ("", "■"), ("", "□"), ("", "^"), ("", "~"), ("", "¦"), ("", "|"), ("", "†"), ("", "¬"), ("", "¤"), ("", "`"), ("", "*"), ("", "_"),
]
#: Words after which a hyphen was suspended, not a word's own.
SUSPENDED = {"und", "oder", "bzw.", "and", "or", "et", "ou", "y", "e", "o", "u"}
HYPHENS = "-‐‑­¬"
LINE_END = re.compile(rf"(\S*[^\W\d_]\S*?)[{HYPHENS}]+\s*[.·,'`]?\s*$")
FIRST = re.compile(r"^\s*(\S+)")
LEAD, TRAIL = "([{\"“„«'’‘¿¡", ")]}\"”“»'’.,;:!?…"
ADDRESS = re.compile(r"www\.|https?:|/|\.\w*\d|\d\.\d|\.docx?$|@\w+\.\w")
#: Words and marks that go with page numbers.
NUMBER_WORDS = re.compile(r"page|pág|pag|seite|hal|halaman|стр|หน้า|sheet|blatt|folio|von|of|sur|de|из|dari|p|s|f|п|с|頁|页|第|ページ|စာမျက်နှာ|\W|_")

#: A word is misread for another that is this many times as frequent; the other must occur at least so often.
RATIO, FREQUENT, ODDS = 8, 4, 30.0
#: Edge lines are furniture if their type is smaller than this share of the document's usual size.
SMALL = 0.95


PARTS = re.compile(r"[\s—–]+|(?<=[^\W\d_])['’](?=\w)")


@lru_cache(maxsize=200_000)
def word_of(raw: str) -> str | None:
    """The word of a run between spaces, in lower case and without the punctuation around it; None for numbers and addresses."""
    if ADDRESS.search(raw):
        return None
    w = raw.lstrip(LEAD).rstrip(TRAIL).lower()
    return w if len(w) >= 2 and any(c.isalpha() for c in w) else None


def words_of(text: str) -> list[str]:
    """The words of a line."""
    return [w for raw in PARTS.split(text) if (w := word_of(raw))]


def looks_numeric(text: str) -> bool:
    """True for a page number, bare or with its usual company, misread or not."""
    t = text.strip().lower()
    if not t or len(t) > 24:
        return False
    rest = NUMBER_WORDS.sub(" ", re.sub(r"[\d!|]", " ", t)) if re.search(r"\d", t) else NUMBER_WORDS.sub(" ", t)
    left = rest.replace(" ", "")
    if re.search(r"\d", t):
        return len(left) <= 2
    return bool(re.fullmatch(r"[ivxlcdm1!|]{1,9}", left or re.sub(r"\W", "", t)))


def prepared(lines: DataFrame) -> DataFrame:
    """Each line once, with its page's edges: is_edge, top, and the document's usual type size."""
    one = (
        lines.where("line_id IS NOT NULL AND document_id IS NOT NULL")
        .select("line_id", "block_id", "document_id", "page_index", "line_no", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("bbox.y"), F.col("baseline"), F.lit(0.0)).alias("y"), F.coalesce("font_size", F.lit(0.0)).alias("size"))
        .dropDuplicates(["line_id"])
    )
    sizes = one.groupBy("document_id", "size").agg(F.sum(F.length("text")).alias("n")).groupBy("document_id").agg(F.max_by("size", F.struct("n", "size")).alias("usual"))
    page = Window.partitionBy("document_id", "page_index")
    block = Window.partitionBy("document_id", "page_index", "block_id")
    return (
        one.withColumn("_top", F.min("y").over(page))
        .withColumn("_bottom", F.max("y").over(page))
        .withColumn("_alone", F.count("*").over(block))
        .join(sizes, "document_id")
        .withColumn("is_edge", (F.col("_alone") == 1) & (F.col("size") < F.col("usual") * SMALL) & ((F.col("y") == F.col("_top")) | (F.col("y") == F.col("_bottom"))))
        .withColumn("is_top", F.col("y") == F.col("_top"))
        .drop("_top", "_bottom", "_alone")
    )


def furniture(pages: DataFrame) -> DataFrame:
    """(line_id, defect) of edge lines: page numbers, and headings that repeat.

    An edge line that isn't a number is a running heading if lines of its
    place (top or bottom, same height) stand on two pages of its document at
    least, or in two documents.
    """


    def make():
        def kernel(line, doc, page, top, y, text):
            return [line, doc, page, top, y, [looks_numeric(t) for t in text]]

        return kernel

    edge = map_rows(
        pages.where("is_edge").select("line_id", "document_id", "page_index", "is_top", F.round("y").alias("y"), "text"), "line_id string, document_id string, page_index int, is_top boolean, y double, number boolean", make
    )
    own = edge.where("NOT number").groupBy("document_id", "is_top", "y").agg(F.countDistinct("page_index").alias("pages"))
    place = own.groupBy("is_top", "y").agg(F.count("*").alias("docs")).where("docs >= 2").select("is_top", "y", F.lit(True).alias("shared"))
    seen = edge.where("NOT number").join(own, ["document_id", "is_top", "y"])
    # few heights, so the join of what is left is a small table's
    once = seen.where("pages < 2").join(place, ["is_top", "y"], "left_semi")
    heads = seen.where("pages >= 2").select("line_id").unionByName(once.select("line_id"))
    return edge.where("number").select("line_id", F.lit("page_number").alias("defect")).unionByName(heads.select("line_id", F.lit("running_header").alias("defect")))


def tokens(body: DataFrame) -> DataFrame:
    """(line_id, word, kind, left_len, next_id): words of the lines.

    kind is 'word' within a line; of a word that may be divided at the line's
    end 'joined' and 'hyphenated' stand for both readings, 'left' and 'right'
    for its parts. body must have block_id and line_no; the next line is the
    one that follows in the block.
    """
    w = Window.partitionBy("block_id").orderBy("line_no", "line_id")
    rows = body.withColumn("_next", F.lead("text").over(w)).withColumn("_next_id", F.lead("line_id").over(w)).withColumn("_prev", F.lag("text").over(w))

    def make():
        def kernel(line, text, nxt, next_id, prev):
            out = [[] for _ in range(6)]

            def emit(*row):
                for col, v in zip(out, row):
                    col.append(v)

            for i, t, nxt_, ni, p in zip(line, text, nxt, next_id, prev):
                a, b = 0, len(t)
                if p and LINE_END.search(p) and (m := FIRST.match(t)):
                    a = m.end()
                m = LINE_END.search(t) if nxt_ else None
                if m and (f := FIRST.match(nxt_)):
                    b = max(a, m.start())
                    left = m.group(1).lstrip(LEAD).lower()
                    left = re.split(r"(?<=[^\W\d_])['’]", left)[-1]
                    right = f.group(1).rstrip(TRAIL).lower()
                    mark = t.rstrip(" .·,'`")[-1:]
                    if left and right and not ADDRESS.search(left) and not ADDRESS.search(right):
                        emit(i, left + right, "joined", len(left), ni, mark)
                        emit(i, f"{left}-{right}", "hyphenated", len(left), ni, mark)
                        emit(i, left, "left", len(left), ni, mark)
                        emit(i, right, "right", len(left), ni, mark)
                found = words_of(t[a:b])
                n = len(found)
                for col, values in zip(out, ([i] * n, found, ["word"] * n, [None] * n, [None] * n, [None] * n)):
                    col.extend(values)
            return out

        return kernel

    return map_rows(rows.select("line_id", "text", "_next", "_next_id", "_prev"), "line_id string, word string, kind string, left_len int, next_id string, mark string", make)


def anagram(c: Column) -> Column:
    """A hash that doesn't depend on the order of characters: the sum of a power of theirs."""
    return F.aggregate(F.split(c, ""), F.lit(0).cast("bigint"), lambda a, x: a + F.ascii(x).cast("bigint") * F.ascii(x) * (F.ascii(x) + 7919))


def anagram_of(text: str) -> int:
    """anagram() of a constant."""
    return sum(ord(c) * ord(c) * (ord(c) + 7919) for c in text)


def corrections(counts: DataFrame) -> DataFrame:
    """(word, correction, n, n_correction): the best correction of each rare word.

    counts: word, n. Up to three confusions are undone; a candidate ranks by
    its frequency, divided by ODDS for each confusion, ties to the smaller word.
    A word is tried only as far as a candidate could still count: not if it is
    too frequent for any, and with more confusions only if the most frequent
    candidate there is would outrank what fewer have found. Settles the words
    that are tried.
    """
    table = F.array(
        *[
            F.struct(F.lit(w).alias("w"), F.lit(i).alias("i"), F.lit(anagram_of(r) - anagram_of(w)).cast("bigint").alias("d"), F.lit(max(len(r), len(w))).alias("cost"))
            for i, (r, w) in enumerate(CONFUSIONS)
        ]
    )
    hashed = counts.where("length(word) BETWEEN 2 AND 60").select("word", "n", anagram(F.col("word")).alias("h"))
    good = hashed.where((F.col("n") >= FREQUENT) & F.col("word").rlike(r"^[\p{L}\p{M}'’-]+$")).select(F.col("word").alias("correction"), F.col("n").alias("n_correction"), "h")
    top = good.agg(F.max("n_correction")).first()[0] or 0
    # the confusions that a word can have had are found once
    tried = settle(hashed.where(F.col("n") * RATIO <= top).withColumn("can", F.filter(table, lambda x: F.instr(F.col("word"), x["w"]) > 0)).where("size(can) > 0").select("word", "n", "h", F.transform("can", lambda x: F.struct(x["i"].alias("i"), x["d"].alias("d"), x["cost"].alias("cost"))).alias("can")))
    best = None
    for k in (1, 2, 3):
        level = tried
        if best is not None:
            level = level.join(best.select("word", "s"), "word", "left").where(F.col("s").isNull() | (F.lit(top / ODDS**k) >= F.col("s"))).drop("s")
        level = level.withColumn("last", F.lit(-1)).withColumn("cost", F.lit(0))
        for _ in range(k):
            level = level.withColumn("c", F.explode(F.filter("can", lambda x: x["i"] >= F.col("last")))).select("word", "n", (F.col("h") + F.col("c.d")).alias("h"), "can", F.col("c.i").alias("last"), (F.col("cost") + F.col("c.cost")).alias("cost"))
        hit = level.select("word", "n", "h", "cost").join(good, "h").where(
            (F.col("n_correction") >= RATIO * F.col("n")) & (F.col("word") != F.col("correction")) & (F.levenshtein("word", "correction") <= F.col("cost")) & (F.length("correction") > k)
        )
        score = (F.col("n_correction") / F.lit(ODDS**k)).alias("s")
        found = hit.select("word", score, "correction", "n", "n_correction")
        both = found if best is None else found.unionByName(best)
        best = settle(both.groupBy("word").agg(F.max_by(F.struct("correction", "n", "n_correction", "s"), F.struct("s", "correction")).alias("b")).select("word", "b.*"))
    return best.select("word", "correction", "n", "n_correction")


def repairs(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(defects: line_id, defect; words: line_id, word, correction; pages: the prepared lines).

    Furniture lines have only that defect; other lines may be both hyphen and
    misread. Pages, furniture, words, corrections and line ends are settled (actions). Null texts count as empty; repeated lines come once.
    """
    pages = settle(prepared(lines))
    edge = settle(furniture(pages))
    body = pages.join(edge.select("line_id"), "line_id", "left_anti")
    toks = settle(tokens(body))
    # forms that only occur divided are looked up, but aren't evidence
    counts = settle(toks.where("kind IN ('word', 'joined', 'hyphenated')").groupBy("word").agg(F.count_if(F.col("kind") == "word").alias("n")))
    fix = corrections(counts.select("word", F.greatest("n", F.lit(1)).alias("n")))
    known = counts.where("n > 0").select("word", F.col("n").alias("n_word"))

    ends = toks.where("kind <> 'word'").join(known, "word", "left").join(fix.select("word", "correction"), "word", "left")
    by = ends.groupBy("line_id", "next_id", "left_len", "mark").agg(
        *[F.max(F.when(F.col("kind") == k, F.coalesce(F.col("n_word"), F.lit(0)))).alias(f"n_{k}") for k in ("joined", "hyphenated", "left", "right")],
        *[F.max(F.when(F.col("kind") == k, F.col("correction"))).alias(f"fix_{k}") for k in ("joined", "hyphenated")],
        *[F.max(F.when(F.col("kind") == k, F.col("word"))).alias(f"word_{k}") for k in ("joined", "hyphenated", "right")],
    )
    joined, hyphenated = F.coalesce("n_joined", F.lit(0)), F.coalesce("n_hyphenated", F.lit(0))
    divided = settle(by.withColumn(
        "divided",
        F.when(F.col("mark") == "­", True)
        .when((joined > 0) | (hyphenated > 0), joined >= hyphenated)
        .when(F.col("fix_hyphenated").isNotNull() & F.col("fix_hyphenated").contains("-"), False)
        .when(F.col("fix_joined").isNotNull(), True)
        .when((F.col("n_left") >= FREQUENT) & (F.col("n_right") >= FREQUENT), False)
        .otherwise(F.col("word_right").rlike(r"^\p{L}")),
    ))
    hyphen = divided.where("divided").select("line_id", F.lit("hyphen").alias("defect"))

    # misread words within lines, and parts of divided ones on the line that has the change
    inner = toks.where("kind = 'word'").join(fix, "word").select("line_id", "word", "correction")
    whole = F.when(F.col("divided"), F.col("word_joined")).otherwise(F.col("word_hyphenated"))
    right = F.when(F.col("divided"), F.col("fix_joined")).otherwise(F.col("fix_hyphenated"))
    parts = divided.withColumn("w", whole).withColumn("c", right).where("c IS NOT NULL AND (CASE WHEN divided THEN n_joined ELSE n_hyphenated END) = 0")
    cut = F.col("left_len")
    left_bad = F.substring("w", F.lit(1), cut) != F.substring("c", F.lit(1), cut)
    tail = F.length("w") - cut
    right_bad = F.substring(F.reverse("w"), F.lit(1), tail) != F.substring(F.reverse("c"), F.lit(1), tail)
    split = parts.where(left_bad).select("line_id", F.col("w").alias("word"), F.col("c").alias("correction")).unionByName(parts.where(right_bad & F.col("next_id").isNotNull()).select(F.col("next_id").alias("line_id"), F.col("w").alias("word"), F.col("c").alias("correction")))
    words = inner.unionByName(split)
    # marks that no print has, and digits among the letters of a word, tell by themselves
    plain = body.where(F.col("text").rlike(MARKED)).select("line_id")
    misread = words.select("line_id").unionByName(plain).distinct().select("line_id", F.lit("misread").alias("defect"))
    return edge.unionByName(hyphen).unionByName(misread).distinct(), words, pages.join(divided.where("divided").select("line_id", F.lit(True).alias("divided")), "line_id", "left")


#: Marks inside words, digits between letters, and capital I among small letters.
MARKED = r"[■□†¤¦]|\p{L}[\^~|@]\p{L}|(^|\s)[\^~|@]\p{L}|\p{L}[\^~|](\s|$|\p{Punct})|(^|[\s('’])\p{Ll}*[\p{L}][0159]\p{Ll}{2,}|(^|[\s('’])[0159]\p{Ll}{3,}|[.,;:!?][\^~|]|[\^~|][„“«¿¡]|\p{Ll}!\p{Ll}|\p{Ll}I\p{Ll}"


def paragraphs(lines: DataFrame) -> DataFrame:
    """(document_id, block_id, page_index, n_lines, text): continuous readable paragraphs.

    Furniture is left out, divided words are joined, misread words are put
    right (in the case of the first letter), and lines are joined by spaces.
    """
    defects, words, pages = repairs(lines)
    edge = defects.where("defect IN ('running_header', 'page_number')").select("line_id")
    fixes = words.groupBy("line_id").agg(F.collect_set(F.struct("word", "correction")).alias("fixes"))
    rows = pages.join(edge, "line_id", "left_anti").join(fixes, "line_id", "left")
    blocks = rows.groupBy("document_id", "block_id").agg(
        F.min("page_index").alias("page_index"), F.sort_array(F.collect_list(F.struct("line_no", "line_id", "text", F.coalesce("divided", F.lit(False)).alias("divided"), "fixes"))).alias("ls")
    )

    def make():
        def kernel(doc, block, page, ls):
            out = [[], [], [], [], []]
            for d, b, p, lines_ in zip(doc, block, page, ls):
                text, fixes = "", {}
                for x in lines_:
                    fixes.update({f["word"]: f["correction"] for f in x["fixes"] or ()})
                    t = x["text"].strip()
                    own = re.search(r"[^\W\d_][-‐‑]$", text) and t[:1].islower() and t.split()[0].lower() not in SUSPENDED if t else None
                    text = text + t if own or text.endswith("\x00") else f"{text} {t}".strip() if text else t
                    text = text.replace("\x00", "")
                    if x["divided"]:
                        text = re.sub(rf"[{HYPHENS}]+\s*[.·,'`]?\s*$", "", text) + "\x00"
                text = _correct(text.replace("\x00", ""), fixes)
                for col, v in zip(out, (d, b, p, len(lines_), text)):
                    col.append(v)
            return out

        return kernel

    return map_rows(blocks.select("document_id", "block_id", "page_index", "ls"), "document_id string, block_id string, page_index int, n_lines int, text string", make)


def _correct(text: str, fixes: dict[str, str]) -> str:
    if not fixes:
        return text

    def put(m):
        raw = m.group()
        w = raw.lstrip(LEAD)
        head = raw[: len(raw) - len(w)]
        core = w.rstrip(TRAIL)
        c = fixes.get(core.lower())
        if c is None:
            return raw
        return head + (c[:1].upper() + c[1:] if core[:1].isupper() else c) + w[len(core) :]

    return re.sub(r"[^\s—–'’]+", put, text)
