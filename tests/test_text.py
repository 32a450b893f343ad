import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.functions.language import detect


def values(spark, expression, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in df.select("i", expression(F.col("t")).alias("v")).orderBy("i").collect()]


def test_tokens(spark):
    assert values(spark, T.estimate_tokens, "", "hello world", "a" * 40, "abc日本", None) == [0, 3, 10, 4, None]


def test_normalized(spark):
    assert values(spark, T.normalize_for_match, "  Click   SUBMIT.\xa0", "A—b", "!!") == ["click submit", "a b", ""]
    assert values(spark, T.normalize_term, "  Key  Pool. ") == ["key pool."]


def test_extractors(spark):
    assert values(spark, lambda c: T.extract(c, T.NUMBER), "Copy 3 files, 1.5 and x4") == [["3", "1.5"]]
    assert values(spark, T.urls, "see https://a.b/c. And http://d") == [["https://a.b/c", "http://d"]]
    assert values(spark, T.code_tokens, "`x y` snake_case camelCase Plain") == [["`x y`", "snake_case", "camelCase"]]


def test_missing_from(spark):
    df = spark.createDataFrame([(["A", "b", "a", "c", "c"], ["a", "C"])], "l array<string>, r array<string>")
    assert df.select(T.missing_from(F.col("l"), F.col("r")).alias("v")).first().v == ["b", "a", "c"]


def test_markers_and_masks(spark):
    got = values(spark, T.list_marker, "• x", "12) y", "၁။ z", "plain", "")
    assert [(g.ordered, g.marker) if g else None for g in got] == [(False, "•"), (True, "12)"), (True, "၁။"), None, None]
    assert values(spark, T.mask, "", "abc", "abcdefghijklmnop") == ["", "a••••••••", "abcd••••••••mnop"]
    assert values(spark, T.redact, "Bearer abcdefghijklmnopqrst ok", "api_key=12345678x") == ["[redacted] ok", "[redacted]"]


def test_similarity(spark):
    def dice(a, b):
        a, b = Counter(a), Counter(b)
        return 2 * sum((a & b).values()) / (sum(a.values()) + sum(b.values()))

    pairs = [("click submit", "click submit"), ("", "a"), ("the key pool opens", "the key pool closes the"), ("a", "b")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r.v for r in df.select(T.similarity(F.col("a"), F.col("b")).alias("v")).collect()]
    g = lambda t: [t] if len(t) == 1 else [t[i : i + 2] for i in range(len(t) - 1)]
    want = [1.0, 0.0] + [0.5 * dice(a.split(), b.split()) + 0.5 * dice(g(a), g(b)) for a, b in pairs[2:]]
    assert got == pytest.approx(want)


def test_languages(spark):
    samples = {"en": "The editor and the planner have not been here for all that time, but they can wait with this.", "de": "Der Leser ist nicht mit der Seite und die Redaktion wird auch nach dem Druck nicht fertig.", "my": "စာမျက်နှာ စီစဉ်သူသည် စာရင်းကို ပြုပြင်သည်", "th": "ระบบส่งออกซ่อนเลขหน้าและลบช่องว่าง", "ja": "表の検出器はページ番号を隠す", "zh": "这个表格检测器隐藏页码来说对时", "ru": "Это не на что и как для от при они было в его", "ko": "한국어 문장입니다 그리고 더", "unknown": "12 34"}
    df = spark.createDataFrame(list(samples.items()), "id string, text string")
    assert {r.id: r.code for r in detect(df, "id").collect()} == {k: k for k in samples}
    assert re.match(r"0\.\d", str(detect(df, "id").where("id = 'en'").first().confidence))
