"""Problem 5: language of documents and of stretches in another language.

Each language has a zstandard dictionary of raw text. A stretch is compressed
with the dictionary of every language that its script allows; the smallest
output names the language, and the margin to the next one is the confidence.
Narrow margins are rejected.
"""

from __future__ import annotations

import re
import unicodedata

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.arrow import map_rows

#: The languages, and the names and codes that labels use for them.
LANGUAGES = ("en", "fr", "de", "es", "pt", "id", "ru", "zh", "ja", "th", "my")
LATIN = ("en", "fr", "de", "es", "pt", "id")
NAMES = {
    "en": "en eng english anglais englisch inglés inglês inggris английский 英语 英語",
    "fr": "fr fra fre french français francais französisch francés francês",
    "de": "de deu ger german deutsch allemand alemán alemão",
    "es": "es spa spanish español espanol castellano spanisch espagnol espanhol",
    "pt": "pt por portuguese português portugues portugiesisch portugais portugués",
    "id": "id ind in indonesian bahasa indonesisch indonésien indonesio",
    "ru": "ru rus russian русский russisch russe ruso russo",
    "zh": "zh zho chi cmn chinese 中文 汉语 漢語 chinesisch chinois chino chinês mandarin",
    "ja": "ja jpn jp japanese 日本語 japanisch japonais japonés japonês",
    "th": "th tha thai ไทย ภาษาไทย thailändisch thaï tailandés",
    "my": "my mya bur burmese myanmar မြန်မာ birmanisch birman birmano",
}
CODE = {n: code for code, names in NAMES.items() for n in names.split()}

#: What carries no language, taken out before compression.
ADDRESSES = re.compile(r"https?://\S+|www\.\S+|\S+@\S+\.\S+|\b[\w-][\w.-]*\.(?:docx?|pdf|txt|md|html?|csv|json|xml|example)\S*|\b[A-Za-z]+[_/\\][\w/\\.]*")
NUMBERS = re.compile(r"\d[\d.,:/%-]*|[(){}\[\]<>=|#*`~^_+]+")
HAS_ADDRESS = re.compile(r"www|http|[@_/\\]|\.[a-z]{2}")
#: Lines that look like program text.
CODEY = re.compile(r"=>|\(\)|\);?\s*$|^\s*(?:const|let|var|def|import|return|SELECT|export --|if \(|for \w+ in)\b|\w\(\w*[\"'.,)]|--\w+-\w+|^\s*[\w.]+\([^)]*\)", re.M)
#: Sentence ends, for cutting stretches; a longer unit only lowers resolution.
STOPS = re.compile(r"(?<=[.!?…])[\"'”’»)]*\s+|(?<=[。！？။])[”’」』）]*\s*|(?<=[.!?])(?=[A-ZÀ-ÞА-Я«“„¿¡])|(?<=[฀-๿])\s(?=[«“„¿¡]?[A-ZÀ-Þ]?[a-zß-ÿ'’-]+(?:\s[a-zß-ÿ'’-]+){2})|\n+")
#: A title or an initial before a stop, after which no stretch is cut.
TITLE = re.compile(r"(?:^|[\s(])[^\W\d_a-zà-ÿа-я]\w{0,3}\.$")
CLASSES = (
    ("kana", re.compile("[぀-ヿ]+")),
    ("han", re.compile("[㐀-鿿]+")),
    ("thai", re.compile("[฀-๿]+")),
    ("burmese", re.compile("[က-႟]+")),
    ("cyrillic", re.compile("[Ѐ-ӿ]+")),
    ("latin", re.compile("[A-Za-zÀ-ɏ]+")),
)
SCRIPTS = {"han": ("zh", "ja"), "thai": ("th",), "burmese": ("my",), "cyrillic": ("ru",), "latin": LATIN, "kana": ("ja",)}


def label_code(label: str | None) -> str | None:
    """The language that a label means: code, three-letter code, name or code with region; None if it means none."""
    if not label:
        return None
    x = unicodedata.normalize("NFC", label).strip().lower().replace("_", "-")
    return CODE.get(x) or CODE.get(x.split("-")[0])


def plain(text: str) -> str:
    """The text without what carries no language."""
    if HAS_ADDRESS.search(text):
        text = ADDRESSES.sub(" ", text)
    return NUMBERS.sub(" ", text)


def script_counts(text: str) -> dict[str, int]:
    if text.isascii():
        return {"latin": sum(map(str.isalpha, text))}
    return {name: sum(map(len, found)) for name, rx in CLASSES if (found := rx.findall(text))}


class Classifier:
    """Compression with one raw-content dictionary a language."""

    #: Bytes of a dictionary, compression level, and the least margin of the compressed sizes to name a language, as a share and in bytes.
    SIZE, LEVEL, MARGIN, LEAST = 48_000, 3, 0.04, 6

    def __init__(self, samples: dict[str, str]):
        self.compress = {}
        for lang, text in samples.items():
            raw = text.encode()[-self.SIZE :]
            if len(raw) >= 8:
                d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=self.LEVEL)
                self.compress[lang] = zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress
        self.memo: dict[str, tuple[str | None, float]] = {}

    def guess(self, text: str) -> tuple[str | None, float]:
        """(language or None, confidence from 0 to 1) of one stretch."""
        got = self.memo.get(text)
        if got is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            got = self.memo[text] = self._guess(text)
        return got

    def _guess(self, text: str) -> tuple[str | None, float]:
        t = plain(text)
        n = script_counts(t)
        # names in Latin letters stand in texts of other scripts, hardly the reverse
        other = {k: v for k, v in n.items() if k != "latin"}
        if other and sum(other.values()) * 2 >= n.get("latin", 0):
            if other.get("kana", 0) * 12 >= other.get("han", 0) and other.get("kana"):
                top = "kana"
            else:
                top = max(other, key=lambda k: (other[k], k))
            letters = other[top]
        elif n.get("latin"):
            top, letters = "latin", n["latin"]
        else:
            return None, 0.0
        langs = [x for x in SCRIPTS[top] if x in self.compress]
        if not langs:
            return (SCRIPTS[top][0], 0.5) if len(SCRIPTS[top]) == 1 else (None, 0.0)
        if len(SCRIPTS[top]) == 1:
            return (langs[0], 1.0) if letters >= 4 else (None, 0.0)
        if letters < (12 if top == "latin" else 4):
            return None, 0.0
        raw = " ".join(t.split()).encode()
        sizes = sorted((len(self.compress[x](raw)), x) for x in langs)
        if len(sizes) == 1:
            return sizes[0][1], 0.5
        (a, lang), (b, _) = sizes[:2]
        margin = (b - a) / b
        if margin < self.MARGIN or b - a < self.LEAST:
            return None, margin
        return lang, min(1.0, margin * 2)

    def stretches(self, text: str, own: str | None = None) -> list[tuple[int, int, str, float]]:
        """(start, end, language, confidence) of the runs of sentences in one language; what has none joins its neighbours."""
        out: list[list] = []
        for a, b in sentences(text):
            part = text[a:b]
            if CODEY.search(part):
                continue
            lang, sure = self.guess(part)
            if lang is None:
                continue
            if out and out[-1][2] == lang:
                out[-1][1], out[-1][3] = b, max(out[-1][3], sure)
            else:
                out.append([a, b, lang, sure])
        return [tuple(x) for x in out]


def sentences(text: str):
    """Ranges of rough sentences."""
    at = 0
    for m in STOPS.finditer(text):
        part = text[at : m.start()]
        if (len(part) >= 25 or not part.isascii()) and not TITLE.search(part[-6:]):
            if part.strip():
                yield at, m.start()
                at = m.end()
    if text[at:].strip():
        yield at, len(text)


#: Rows in the labelled sample: how many blocks are looked at, and how many a language keeps.
SAMPLE_ROWS, SAMPLE_PER_LANGUAGE = 30_000, 500


def labelled_sample(blocks: DataFrame, documents: DataFrame) -> dict[str, list[str]]:
    """Sentences by language, from translations (whose target label is right), at most SAMPLE_PER_LANGUAGE blocks each.

    Runs two bounded actions: a row count and the collection of the sample.
    """
    n = blocks.count()
    few = blocks.where(F.pmod(F.xxhash64("block_id"), F.lit(max(1, n // SAMPLE_ROWS))) == 0).where(
        "kind IN ('paragraph', 'quote') AND translated_text IS NOT NULL AND length(translated_text) BETWEEN 60 AND 2000"
    )
    targets = documents.groupBy("document_id").agg(F.max("target_language").alias("lang"))
    from pyspark.sql import Window

    w = Window.partitionBy("lang").orderBy(F.xxhash64("block_id", F.lit(7)), "block_id")
    rows = (
        few.select("block_id", "document_id", F.col("translated_text").alias("t"))
        .dropDuplicates(["block_id"])
        .join(targets, "document_id")
        .where(F.col("lang").isin(*LANGUAGES))
        .withColumn("_rn", F.row_number().over(w))
        .where(F.col("_rn") <= SAMPLE_PER_LANGUAGE)
        .select("lang", "block_id", "t")
        .collect()
    )
    out: dict[str, list[str]] = {}
    for lang, _, t in sorted(rows):
        out.setdefault(lang, []).extend(plain(t[a:b]).strip() for a, b in sentences(t))
    return out


def fit(sample: dict[str, list[str]]) -> dict[str, str]:
    """Dictionary texts by language, from sentences of which some are labelled wrong.

    Each half of the sentences is judged with dictionaries of the other half;
    those that another language clearly compresses better are left out.
    """
    halves = [{k: v[i::2] for k, v in sample.items()} for i in (0, 1)]
    judges = [Classifier({k: "\n".join(v) for k, v in h.items()}) for h in halves]
    kept: dict[str, list[str]] = {}
    for i in (0, 1):
        for lang, texts in halves[i].items():
            for t in texts:
                said, _ = judges[1 - i].guess(t)
                if said == lang:
                    kept.setdefault(lang, []).append(t)
    out = {}
    for lang, texts in kept.items():
        seen, text, size = set(), [], 0
        for t in texts:
            if t not in seen and size < Classifier.SIZE:
                seen.add(t)
                text.append(t)
                size += len(t.encode()) + 1
        out[lang] = "\n".join(text)
    return out


def block_languages(blocks: DataFrame, dictionaries: dict[str, str], text: str = "source_text") -> DataFrame:
    """(block_id, document_id, lang, n_chars, confidence, start_pos, end_pos): the stretches of each block.

    Neighbouring sentences in one language are one stretch. Code, addresses,
    names and numbers have no language; null, empty and undecided texts give
    no row; repeated blocks come once per row delivered (stretches are alike).
    """

    def make():
        c = Classifier(dictionaries)

        def kernel(block, doc, texts):
            out = [[] for _ in range(7)]
            for b, d, t in zip(block, doc, texts):
                if t:
                    for a, z, lang, sure in c.stretches(t):
                        for col, v in zip(out, (b, d, lang, z - a, sure, a, z)):
                            col.append(v)
            return out

        return kernel

    return map_rows(blocks.select("block_id", "document_id", text), "block_id string, document_id string, lang string, n_chars int, confidence double, start_pos int, end_pos int", make)


def languages(blocks: DataFrame, documents: DataFrame, stretches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents: document_id, lang, confidence, label, label_lang; blocks: block_id, document_id, lang, n_chars, confidence, main).

    A document's language is the one of most characters in its blocks; its
    confidence is that share times the mean certainty of those stretches.
    Documents without any decided stretch give no row. Ties go to the smaller
    code. label_lang is null if the label means no language.
    """
    per = stretches.groupBy("document_id", "block_id", "lang", "start_pos").agg(F.max("n_chars").alias("n_chars"), F.max("confidence").alias("confidence"))
    per = per.groupBy("document_id", "block_id", "lang").agg(F.sum("n_chars").alias("n_chars"), F.max("confidence").alias("confidence"))
    sums = per.groupBy("document_id", "lang").agg(F.sum("n_chars").alias("n"), F.sum(F.col("confidence") * F.col("n_chars")).alias("c"))
    main = sums.groupBy("document_id").agg(
        F.min_by("lang", F.struct(-F.col("n"), F.col("lang"))).alias("lang"), (F.max_by("c", F.struct(F.col("n"), F.col("lang"))) / F.sum("n")).alias("confidence")
    )
    flat = F.create_map(*[F.lit(x) for pair in CODE.items() for x in pair])
    clean = F.translate(F.lower(F.trim("label")), "_", "-")
    labels = documents.where("document_id IS NOT NULL").groupBy("document_id").agg(F.max("source_language").alias("label"))
    labels = labels.withColumn("label_lang", F.coalesce(flat[clean], flat[F.substring_index(clean, "-", 1)]))
    docs = labels.join(main, "document_id")
    return docs.select("document_id", "lang", "confidence", "label", "label_lang"), per.join(main.select("document_id", F.col("lang").alias("main")), "document_id")


def language_cases(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(item_kind, item_id, lang): wrongly or not labelled documents, and blocks with another language than their document's."""
    a = docs.where("label_lang IS NULL OR label_lang <> lang").select(F.lit("document").alias("item_kind"), F.col("document_id").alias("item_id"), "lang")
    b = blocks.where("lang <> main").select(F.lit("export_block").alias("item_kind"), F.col("block_id").alias("item_id"), "lang").distinct()
    return a.unionByName(b)
