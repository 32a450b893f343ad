"""Scalar text functions as column expressions.

Lengths and positions are code points. All functions give null for null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the reference trims it.
SPACE = r"[\s\p{Z}\x{FEFF}]"
#: Scripts whose characters weigh 1.5 tokens.
WIDE = r"[\x{0900}-\x{097F}\x{0E00}-\x{0E7F}\x{1000}-\x{109F}\x{3000}-\x{9FFF}\x{A9E0}-\x{A9FF}\x{AA60}-\x{AA7F}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}]"
#: Classes of letters, by order of precedence.
SCRIPTS = {
    "myanmar": r"\x{1000}-\x{109F}",
    "thai": r"\x{0E00}-\x{0E7F}",
    "persian": "پچژگکی",
    "arabic": r"\x{0600}-\x{06FF}\x{0750}-\x{077F}",
    "devanagari": r"\x{0900}-\x{097F}",
    "kana": r"\x{3040}-\x{30FF}",
    "hangul": r"\x{1100}-\x{11FF}\x{AC00}-\x{D7AF}",
    "han": r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}",
    "cyrillic": r"\x{0400}-\x{04FF}",
    "latin": r"\x{0041}-\x{007A}\x{00C0}-\x{024F}",
}
#: Function words whose share names a language in Latin letters.
STOPWORDS = {
    "en": ["the", "and", "for", "that", "with", "this", "from", "are", "was", "were", "have", "has", "not", "you", "but", "all", "any", "can", "her", "his", "they"],
    "fr": ["le", "la", "les", "des", "une", "est", "dans", "pour", "que", "qui", "avec", "sur", "pas", "plus", "leur", "aussi", "comme", "fait"],
    "de": ["der", "die", "das", "und", "ist", "nicht", "ein", "eine", "von", "mit", "für", "auch", "werden", "sich", "wird", "nach", "beim", "über"],
    "es": ["el", "los", "las", "una", "por", "con", "para", "está", "están", "como", "más", "pero", "este", "esta", "fue", "han", "del", "que"],
    "pt": ["os", "uma", "não", "por", "com", "mais", "dos", "das", "como", "mas", "foi", "são", "você", "isso", "ela", "entre", "após"],
    "id": ["yang", "dan", "di", "untuk", "dengan", "pada", "ini", "itu", "dari", "adalah", "tidak", "akan", "juga", "ada", "atau", "oleh"],
    "vi": ["của", "và", "các", "người", "này", "được", "cho", "có", "để", "không", "với", "những", "một", "đã", "ở", "khi"],
}
RUSSIAN = ["и", "в", "не", "на", "что", "с", "по", "как", "это", "для", "от", "до", "из", "при", "они", "было", "его"]
BURMESE = ["သည်", "၏", "ကို", "မှာ", "နှင့်", "ဖြင့်", "ဖြစ်", "ကြောင့်", "တွင်", "မှ", "အတွက်", "လည်း", "ပါ", "များ", "အား"]
SIMPLIFIED, TRADITIONAL = "让说这来对时会过还没后发经头实", "讓說這來對時會過還沒後發經頭實"

_L, _R = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
#: What must survive a translation.
NUMBER = _L + r"\d+(?:[.,]\d+)?" + _R
MEASURE = r"(?i)\d+(?:[.,]\d+)?\s*(?:%|°[CF]|km|cm|mm|kg|mg|ml|kb|mb|gb|tb|ms|khz|ghz|px|dpi)"
URL = _L + r"(?i:https?)://[^\s<>\"')\]]+"
CODE_SPAN = r"`[^`\n]+`"
SNAKE = _L + r"[a-z][a-z0-9]*(?:_[a-z0-9]+)+" + _R
CAMEL = _L + r"[a-z]+[A-Z][A-Za-z0-9]*" + _R

#: Credentials, each match of which becomes [redacted].
SECRETS = [
    _L + r"AIza[0-9A-Za-z_-]{10,}" + _R,
    _L + r"AQ\.[0-9A-Za-z._-]{16,}",
    _L + r"sk-[0-9A-Za-z_-]{16,}" + _R,
    _L + r"gsk_[0-9A-Za-z]{16,}" + _R,
    _L + r"sk-or-v1-[0-9a-f]{16,}" + _R,
    _L + r"(?:ghp|gho|ghu|ghs|github_pat)_[0-9A-Za-z]{16,}" + _R,
    r"(?i)" + _L + r"Bearer\s+[0-9A-Za-z._~+/=-]{16,}" + _R,
    r"(?i)" + _L + r"(?:x-goog-api-key|api[-_]?key|apikey|authorization|access[-_]?token|secret)\s*[=:]\s*[\"']?[^\s\"',&]{8,}",
]


def trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def normalize_for_match(c: Column) -> Column:
    """Lower case, runs of punctuation and symbols as a space, single spaces, trimmed."""
    return trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[\p{P}\p{S}]+", " "), rf"{SPACE}+", " "))


def normalize_term(c: Column) -> Column:
    """Trimmed, lower case, single spaces; punctuation stays."""
    return F.regexp_replace(F.lower(trim(c)), rf"{SPACE}+", " ")


def count_of(c: Column, chars: str) -> Column:
    """How many characters of a class the text has."""
    return F.length(c) - F.length(F.regexp_replace(c, f"[{chars}]" if not chars.startswith("[") else chars, ""))


def estimate_tokens(c: Column) -> Column:
    """ASCII a quarter, wide scripts one and a half, others one, rounded up; an upper estimate."""
    ascii_, wide = count_of(c, r"[\x{00}-\x{7F}]"), count_of(c, WIDE)
    return F.ceil(ascii_ * F.lit(0.25) + wide * F.lit(1.5) + (F.length(c) - ascii_ - wide)).cast("bigint")


def script_counts(c: Column) -> dict[str, Column]:
    """Letters by script; each character counts for the first class that has it."""
    out, taken = {}, ""
    for name, cls in SCRIPTS.items():
        out[name] = count_of(c, f"[{cls}&&[^{taken}]]" if taken else f"[{cls}]")
        taken += cls
    return out


def words(c: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    """Runs between spaces and tabs."""
    return F.size(F.filter(F.split(c, "[ \t]+"), lambda w: w != ""))


def is_prose(c: Column) -> Column:
    """Three words or more than 24 characters."""
    return (F.size(F.filter(F.split(trim(c), rf"{SPACE}+"), lambda w: w != "")) >= 3) | (F.length(trim(c)) > 24)


def extract(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def urls(c: Column) -> Column:
    return F.transform(extract(c, URL), lambda u: F.regexp_replace(u, r"[.,;:!?、。]+$", ""))


def code_tokens(c: Column) -> Column:
    return F.concat(extract(c, CODE_SPAN), extract(c, SNAKE), extract(c, CAMEL))


def missing_from(left: Column, right: Column) -> Column:
    """Multiset difference without regard to case, each distinct token once, in order of first loss.

    Both sides should be columns of their own, as they are used several times.
    Sides that are equal but for order, the usual case, are compared sorted;
    only others are counted token by token.
    """
    low_left, low_right = F.transform(left, lambda x: F.lower(x)), F.transform(right, lambda x: F.lower(x))
    lost = F.filter(
        F.transform(left, lambda x, i: F.struct(x.alias("t"), i.alias("i"))),
        lambda s: F.size(F.filter(F.slice(low_left, F.lit(1), s["i"] + 1), lambda y: y == F.lower(s["t"]))) > F.size(F.filter(low_right, lambda y: y == F.lower(s["t"]))),
    )
    same = F.sort_array(low_left) == F.sort_array(low_right)
    return F.when(same | (F.size(left) == 0), F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(lost, lambda s: s["t"])))


def structure(c: Column) -> dict[str, Column]:
    """Headings, lists, tables, quotes and links, counted by lines."""
    lines = F.split(c, "\n")

    def of(pattern: str, stripped: bool = False) -> Column:
        return F.size(F.filter(lines, lambda x: (trim(x) if stripped else x).rlike(pattern)))

    return {
        "headings": of(r"^#{1,6}\s", True),
        "lists": of(r"^\s*(?:[-*+]|\d+\.)\s"),
        "tables": of(r"^\s*\|.*\|\s*$"),
        "quotes": of(r"^\s*>\s?"),
        "links": F.size(extract(c, r"\[[^\]]*\]\([^)]*\)")),
    }


#: Markers that open a list line.
BULLET = r"^[•●▪◦‣·⁃*+\-–—]\s+"
ORDERED = r"^\(?(?:\d{1,3}|[a-zA-Z]|[ivxIVX]{1,5})[.)]\s+|^\(?[၀-၉]{1,4}\)?[.)။]\s+"


def list_marker(c: Column) -> Column:
    """struct(ordered, marker) of a leading list marker, or null."""
    t = trim(c)
    b, o = F.regexp_extract(t, BULLET, 0), F.regexp_extract(t, ORDERED, 0)
    return F.when(b != "", F.struct(F.lit(False).alias("ordered"), trim(b).alias("marker"))).when(o != "", F.struct(F.lit(True).alias("ordered"), trim(o).alias("marker")))


def hash_text(c: Column) -> Column:
    return F.sha2(c, 256)


def redact(c: Column) -> Column:
    for p in SECRETS:
        c = F.regexp_replace(c, p, "[redacted]")
    return c


def mask(c: Column) -> Column:
    """The first characters (a quarter, one to four), eight dots, the last four of longer secrets."""
    n = F.length(c)
    head = F.least(F.lit(4), F.greatest(F.lit(1), F.floor(n / 4).cast("int")))
    return F.when(c == "", "").otherwise(F.concat(F.substring(c, F.lit(1), head), F.lit("•" * 8), F.when(n > 8, F.right(c, F.lit(4))).otherwise("")))


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape_cell(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("|"), F.lit("\\|")), r"\r?\n", " ")


def bigrams(c: Column) -> Column:
    """Pairs of neighbouring characters; a single character stands for itself."""
    return F.when(F.length(c) <= 1, F.array(c)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - 1)), lambda i: F.substring(c, i, F.lit(2))))


def dice(a: Column, b: Column) -> Column:
    """Multiset Dice coefficient of two arrays, 0 if either is empty."""
    shared = F.aggregate(
        F.array_distinct(a),
        F.lit(0),
        lambda acc, x: acc + F.least(F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x))),
    )
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.lit(2.0) * shared / (F.size(a) + F.size(b)))


def similarity(left: Column, right: Column) -> Column:
    """Mean of word and bigram Dice of two normalised texts; 1 if equal, 0 if either is empty."""
    w = [F.filter(F.split(x, " "), lambda t: t != "") for x in (left, right)]
    return (
        F.when((left == "") | (right == ""), F.lit(0.0)).when(left == right, F.lit(1.0)).otherwise(F.lit(0.5) * dice(*w) + F.lit(0.5) * dice(bigrams(left), bigrams(right)))
    )


def backoff_ms(attempt: Column, u: Column, base: int = 1500, most: int = 60_000) -> Column:
    """Equal jitter: half of the ceiling fixed, half by u in [0, 1)."""
    ceiling = F.least(F.lit(float(most)), F.lit(float(base)) * F.pow(F.lit(2.0), F.least(F.lit(30), F.greatest(F.lit(0), F.floor(attempt)))))
    return F.greatest(F.lit(1), F.floor(ceiling / 2 + u * ceiling / 2 + F.lit(0.5))).cast("bigint")


def percent(part: Column, total: Column) -> Column:
    """Rounded share of 100, clamped."""
    return F.when(total <= 0, F.lit(0)).otherwise(F.least(F.lit(100), F.greatest(F.lit(0), F.floor(F.lit(100.0) * F.least(part, total) / total + F.lit(0.5))))).cast("int")
