import io
import random
import zipfile
from xml.etree import ElementTree
from collections import Counter

from pyspark.sql import functions as F

from folioflow.operators import export, layout, planning, quality, usage
from folioflow.operators import units as U
from folioflow.sources import formats
from folioflow.streaming import usage as state


def test_warnings(spark):
    rows = [
        ("a", "d", "Copy 3 files to the disk", "Copiez les fichiers", "translated"), ("b", "d", "x", None, "reviewed"), ("c", "d", "x", " ", "translated"), ("e", "d", "Copy the list of files", "copy the list of files!", "translated"),
        ("f", "d", "- a\n- b", "- a", "translated"), ("g", "d", "Copy 3", None, "pending"), ("h", "d", "call build_path in 10 km", "appel", "translated"),
    ]
    u = spark.createDataFrame(rows, "block_id string, document_id string, source_text string, translated_text string, unit_status string").withColumn("differ", F.lit(True))
    got = {(r.block_id, r.code, r.detail) for r in quality.warnings(u).collect()}
    assert {("a", "numbers_changed", "3"), ("b", "missing_text", None), ("c", "unexpected_empty", None), ("e", "untranslated", None), ("f", "structure_mismatch", "lists 2 → 1"), ("h", "code_changed", "build_path"), ("h", "units_changed", "10 km")} <= got
    assert not any(b == "g" for b, _, _ in got)


def test_glossary_and_duplicates(spark):
    u = spark.createDataFrame([("a", "p", "d", "The Key Pool opens", "Le pool", "translated"), ("b", "p", "d", "The key pool", "Der Schlüsselvorrat", "reviewed"), ("c", "p", "d", "Another text", "le pool!", "translated")], "block_id string, project_id string, document_id string, source_text string, translated_text string, unit_status string")
    rules = spark.createDataFrame([("p", "key pool", "Schlüsselvorrat", None), ("p", "x", "y", "pool")], "project_id string, source_term string, preferred string, forbidden string")
    got = {(r.block_id, r.detail) for r in quality.glossary_findings(u, rules).collect()}
    assert got == {("a", "missing: Schlüsselvorrat"), ("a", "forbidden: pool"), ("c", "forbidden: pool")}
    assert {r.block_id for r in quality.duplicate_units(u).collect()} == {"a", "c"}


def test_similar_units_against_brute_force(spark):
    random.seed(4)
    words = "the key pool opens file editor again reads list page".split()
    texts = [(str(i), "p", "my", " ".join(random.choice(words) for _ in range(random.randint(1, 8)))) for i in range(80)]
    df = spark.createDataFrame(texts, "id string, project_id string, target string, text string")

    def dice(a, b):
        a, b = Counter(a), Counter(b)
        return 2 * sum((a & b).values()) / (sum(a.values()) + sum(b.values()))

    g = lambda t: [t] if len(t) == 1 else [t[i : i + 2] for i in range(len(t) - 1)]
    score = lambda a, b: 1.0 if a == b else 0.5 * dice(a.split(), b.split()) + 0.5 * dice(g(a), g(b))
    for least in (0.6, 0.9):
        want = {(a[0], b[0]) for a in texts for b in texts if a[0] != b[0] and score(a[3], b[3]) >= least}
        got = {(r.query_id, r.match_id) for r in quality.similar_units(df, df, least, None).collect()}
        assert got == want



def test_suggestions_against_brute_force(spark):
    random.seed(5)
    words = "the key pool opens file editor again reads list page".split()
    texts = [(f"u{i:03}", random.choice("pq"), "my", " ".join(random.choice(words) for _ in range(random.randint(1, 5)))) for i in range(120)]
    texts += [(f"v{i}", "p", "my", "The key, pool!") for i in range(6)] + [("w", "p", "de", "the key pool"), ("x", "p", "my", "?")]
    df = spark.createDataFrame(texts, "id string, project_id string, target string, text string")

    def score(a, b):
        share = lambda x, y: 2 * sum((Counter(x) & Counter(y)).values()) / (len(x) + len(y))
        g = lambda t: [t[i : i + 2] for i in range(len(t) - 1)]
        return 1.0 if a == b else 0.5 * share(a.split(), b.split()) + 0.5 * share(g(a), g(b))

    plain = lambda t: "the key pool" if t == "The key, pool!" else t.strip("?")
    want = set()
    for a in texts:
        found = sorted((-score(plain(a[3]), plain(b[3])), b[0]) for b in texts if b[0] != a[0] and b[1:3] == a[1:3] and plain(a[3]) and plain(b[3]))
        want |= {(a[0], b, i + 1) for i, (s, b) in enumerate([x for x in found if x[0] <= -0.6][:3])}
    got = {(r.query_id, r.match_id, r.rank) for r in quality.suggestions(df, df).collect()}
    assert got == want


def test_suggestions_move_each_text_once(spark):
    """Neither words nor pairs are shuffled, whatever the batches and blocks, and nothing is lost."""
    from folioflow.operators import similar

    random.seed(6)
    words = "the key pool opens file editor again reads list page".split()
    texts = [(f"u{i:03}", "p", "my", " ".join(random.choice(words) for _ in range(random.randint(1, 6)))) for i in range(300)]
    df = spark.createDataFrame([*texts, ("n", None, "my", "the key pool"), ("o", "p", None, "the key pool"), ("x", "p", "my", None)], "id string, project_id string, target string, text string")
    made = quality.suggestions(df.where("id < 'u030' OR id > 'v'"), df)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") <= 3 and "MapInArrow" in plan, plan
    want = {tuple(r) for r in made.collect()}
    assert len({q for q, *_ in want}) == 30 and all(q != m for q, m, *_ in want)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert {tuple(r) for r in made.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # by blocks of one text each
    of = {t: sorted(i for i, *_, x in texts if x == t) for *_, t in texts}
    asked = similar.Asked({t: of[t] for t in of}, 0.6, 3)
    asked.meet({t: x[:4] for t, x in of.items()})
    best, similar.PAIRS, every = asked.best, 1, similar.PAIRS
    try:
        asked = similar.Asked({t: of[t] for t in of}, 0.6, 3)
        asked.meet({t: x[:4] for t, x in reversed(of.items())})
    finally:
        similar.PAIRS = every
    assert asked.best == best


def test_suggestions_are_registered():
    import __spark_entry__

    assert "memory_suggest" in __spark_entry__.queries()


def test_planning(spark):
    assert planning.plan([10, 10, 10], [40, 40, 40], 40, 4096, 0.5) == [(0, False), (0, False), (1, False)]
    assert planning.plan([10, 500, 10], [1, 1, 1], 40, 4096, 0.5) == [(0, False), (1, True), (2, False)]
    rows = [("d", f"b{i}", i, "word " * 30, "my", "pdf") for i in range(60)]
    u = spark.createDataFrame(rows, "document_id string, block_id string, order_index int, source_text string, target string, document string")
    got = sorted(planning.plan_batches(u, 16384, 4096).collect(), key=lambda r: int(r.block_id[1:]))
    assert [r.batch_no for r in got] == sorted(r.batch_no for r in got) and len(got) == 60


def test_parsers():
    md = formats.parse_markdown("# Project Alpha\n\nSome *text*\nmore\n\n- a\n- b\n1. c\n\n```\ncode\n```\n> q\n\n| h | i |\n|---|---|\n| 1 | 2 |\n\nSetext\n---\n")
    assert [b["kind"] for b in md] == ["heading", "paragraph", "list", "list", "code", "quote", "table", "heading"]
    assert md[1]["text"] == "Some text more" and md[6]["table_rows"] == [["h", "i"], ["1", "2"]] and md[7]["level"] == 2
    assert [b["kind"] for b in formats.parse_plain("MONTHLY REPORT\n\nBody text\n\n- a\n- b")] == ["heading", "paragraph", "list"]
    page = formats.parse_html("<h1>Head &amp; Title</h1><script>x</script><p>Text<ul><li>a</li><li>b</li></ul>")
    assert page[0]["text"] == "Head & Title" and page[-1]["kind"] == "list" and "x" not in page[1]["text"].replace("Text", "")
    assert formats.parse_markdown("") == formats.parse_plain(" \n ") == []


def test_docx_round_trip():
    blocks = [{"text": "A title", "heading": 1}, {"text": "First & <second>\nline", "heading": None}]
    got = formats.parse_docx(export.docx(blocks))
    assert [(b["kind"], b["text"], b["level"]) for b in got] == [("heading", "A title", 1), ("paragraph", "First & <second>\nline", None)]


def test_docx_parts():
    blocks = [
        {"text": "one", "heading": None, "list_ordered": True, "page_index": 0}, {"text": "two", "heading": None, "list_ordered": False, "page_index": 0}, {"text": "see", "heading": None, "link": "https://example.com/?a=1&b=2", "page_index": 0},
        {"text": "t", "heading": None, "is_table": True, "cells": [["a", "b & c"], None], "page_index": 1},
    ]
    z = zipfile.ZipFile(io.BytesIO(export.docx(blocks)))
    body = z.read("word/document.xml").decode()
    assert body.count("<w:numPr>") == 2 and "<w:tbl><w:tr><w:tc>" in body and "b &amp; c" in body and 'w:type="page"' in body and "<w:hyperlink" in body
    assert "https://example.com/?a=1&amp;b=2" in z.read("word/_rels/document.xml.rels").decode()
    for name in z.namelist():
        ElementTree.fromstring(z.read(name))


def run(text, x, y, size=12.0, bold=False):
    return {"text": text, "x": float(x), "y": float(y) - 0.8 * size, "width": len(text) * size * 0.5, "height": size, "font_size": size, "font_key": "b" if bold else "r", "bold": bold}


def test_layout():
    two = layout.analyze([run("First line of text", 40, 100), run("second line of text", 40, 116)], 595, 842)
    assert [(b["kind"], b["n_lines"], b["alignment"]) for b in two] == [("paragraph", 2, "left")]
    heading = layout.analyze([run("CHAPTER ONE", 40, 60, 24, True), run("Body text that is long enough here", 40, 120), run("and goes on", 40, 136)], 595, 842)
    assert (heading[0]["kind"], heading[0]["level"]) == ("heading", 1)
    lists = layout.analyze([run("1. one", 40, 100), run("2. two", 40, 116), run("- three", 40, 150), run("- four", 40, 166)], 595, 842)
    assert [(b["kind"], b["ordered"]) for b in lists] == [("list", True), ("list", False)]
    table = layout.analyze([run(a, 40, y) for a, y in (("Name", 400), ("Alpha", 416), ("Beta", 432))] + [run(a, 300, y) for a, y in (("Value", 400), ("42", 416), ("7", 432))], 595, 842)
    assert table[0]["kind"] == "table" and "Name | Value" in table[0]["text"]
    assert layout.analyze([run("42", 290, 812)], 595, 842)[0]["flag"] == "page_number"
    assert layout.analyze([], 595, 842) == []


def test_pages_table(spark):
    rows = [("d", 0, "Hello there", 1.0, 100.0, 60.0, 12.0, 12.0, "f"), ("d", 0, None, None, None, None, None, None, None), ("d", 1, "", 1.0, 1.0, 0.0, 1.0, 1.0, "f")]
    df = spark.createDataFrame(rows, "document_id string, page_index int, text string, x double, y double, width double, height double, font_size double, font_key string")
    assert [(r.page_index, r.text) for r in layout.analyze_pages(df).collect()] == [(0, "Hello there")]


def test_units(spark):
    rows = [("a", "d", "p", "old", 1, 1), ("a", "d", "p", "new", 2, 1), ("a", "d", "p", "late", 2, 0), ("b", "d", "p", None, None, 1)]
    df = spark.createDataFrame(rows, "block_id string, document_id string, project_id string, source_text string, updated_at int, ingested_at int")
    assert {(r.block_id, r.source_text) for r in U.units(df, "source_text").collect()} == {("a", "new"), ("b", None)}
    prior = spark.createDataFrame([("a", "x", "T", "translated"), ("b", "y", "U", "reviewed"), ("z", "q", "V", "translated")], "block_id string, checksum string, translated_text string, unit_status string")
    new = spark.createDataFrame([("a", "x"), ("b", "changed"), ("c", "n")], "block_id string, checksum string")
    assert {tuple(r) for r in U.merge(prior, new).collect()} == {("a", "keep", "T", "translated"), ("b", "reset", None, "pending"), ("c", "insert", None, "pending"), ("z", "delete", None, None)}


def test_render(spark):
    rows = [(0, 1, "Title", 1, False, None, "t1"), (0, 2, "a", None, False, True, None), (0, 3, "b", None, False, True, None), (0, 4, "<x>", None, False, None, None), (1, 5, "c", None, False, False, None)]
    b = spark.createDataFrame([("d", p, o, t, h, tab, lo, None, "left") for p, o, t, h, tab, lo, _ in rows], "document_id string, page_index int, order_index int, text string, heading int, is_table boolean, list_ordered boolean, link string, alignment string").withColumn("md_table", F.lit(""))
    docs = spark.createDataFrame([("d", "Doc", "my"), ("e", None, None)], "document_id string, title string, target_language string")
    md = {r.document_id: r.body for r in export.render(b, docs, "markdown").collect()}
    assert "1. a\n2. b\n<x>" in md["d"] and "---\n\n- c" in md["d"] and md["e"].startswith("# ")
    html = export.render(b, docs, "html").where("document_id = 'd'").first().body
    assert "<ol>\n<li>a</li>\n<li>b</li>\n</ol>" in html and "&lt;x&gt;" in html
    t = b.where("order_index = 4").withColumn("is_table", F.lit(True)).withColumn("cells", F.expr("array(array('h', '<i>'), array('1', null))"))
    assert "<thead>\n<tr><th>h</th><th>&lt;i&gt;</th></tr>\n</thead>\n<tbody>\n<tr><td>1</td><td></td></tr>\n</tbody>" in export.render(t, docs, "html").where("document_id = 'd'").first().body
    back = export.restore(export.serialize(t, docs.withColumn("source_language", F.lit("de")))).first()
    assert back.cells == [["h", "<i>"], ["1", None]] and back.alignment == "left" and back.bbox is None
    files = spark.createDataFrame([("a", "json", "{\"x\": 1}"), ("b", "json", "{"), ("c", "html", "<html></html>"), ("d", "html", "<html>"), ("e", "text", ""), ("f", "text", None)], "name string, kind string, body string")
    assert {r.name for r in export.probe(files).where("valid").collect()} == {"a", "c"}


def test_errors_and_states(spark):
    df = spark.createDataFrame([(429, "Rate limit: too many requests per minute", None), (429, "exceeded your current quota", None), (404, "x", None), (None, "Unauthorized", None)], "s int, m string, p string")
    assert [r[0] for r in df.select(usage.classify_error(F.col("s"), F.col("m"), F.col("p"))).collect()] == ["rate_limit", "quota_exceeded", "invalid_model", "auth"]


def fold(*outcomes, **more):
    s = state.START
    for at, o in outcomes:
        s = state.advance(s, at, o, **more)
    return s


def test_key_rules():
    third = fold((0, "server_error"), (1, "server_error"), (2, "server_error"))
    assert third["health"] == "degraded" and third["cooldown_until"] == 2 + 60_000  # three quarters of 10 s doubled three times
    healed = state.advance(third, 9, "ok")
    assert (healed["health"], healed["cooldown_until"], healed["reason"]) == ("healthy", 0, None)
    assert fold((0, "rate_limit"))["cooldown_until"] == 7_500 and fold((0, "rate_limit"), retry_after=60_000)["cooldown_until"] == 60_000
    bad = fold((0, "rate_limit"), (1, "auth"))
    assert (bad["health"], bad["cooldown_until"], bad["reason"]) == ("invalid", 0, "auth")
    assert fold(*((i * 100_000_000, "quota_exceeded") for i in range(3)))["cooldown_until"] == 200_000_000 + 900_000
    assert fold(*((i * 1_000, "quota_exceeded") for i in range(9)))["cooldown_until"] == 8_000 + 900_000 * 16
    waits = fold((0, "timeout"), (1, "timeout"), (2, "timeout"))
    assert (waits["health"], waits["failed"], waits["cooldown_until"]) == ("healthy", 3, 0)


def test_stream_equals_batch(spark, tmp_path):
    random.seed(2)
    kinds = ["ok", "rate_limit", "quota_exceeded", "server_error", "server_error", "auth", "timeout"]
    rows = [(f"k{random.randrange(4)}", i * random.choice([1, 7_000]) if i % 3 else i * 7_000, f"e{i:04}", random.choice(kinds), random.choice([None, 40_000])) for i in range(300)]
    rows.sort(key=lambda r: (r[1], r[2]))
    df = spark.createDataFrame(rows, "key_id string, at_ms bigint, id string, outcome string, retry_after_ms bigint")
    for part in range(4):  # a file a batch, in the order of time
        spark.createDataFrame(rows[part * 75 : part * 75 + 75], df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    out = []
    q = state.key_health_stream(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(lambda b, i: out.extend(b.collect())).start()
    q.awaitTermination(120)
    last = {r.key_id: tuple(r) for r in out}
    assert last == {r.key_id: tuple(r) for r in state.key_health_batch(df).collect()}
    assert state.key_health_batch(df.limit(0)).count() == 0


def test_pool_exhaustion(spark):
    now = 1_000
    rows = [("a", "k1", "disabled", 0, None), ("b", "k2", "cooling", 5_000, "quota"), ("b", "k3", "cooling", 6_000, "quota"), ("c", "k4", "cooling", 5_000, "quota"), ("c", "k5", "rpm_exhausted", 0, None), ("d", "k6", "verification_failed", 0, None), ("e", "k7", None, 0, None), ("f", "k8", "verification_failed", 0, None), ("f", "k9", "cooling", 5_000, "quota")]
    df = spark.createDataFrame(rows, "provider string, key_id string, rejection string, cooldown_until bigint, cooldown_reason string").withColumn("now_ms", F.lit(now))
    assert {r.provider: r.exhaustion for r in usage.exhaustion(df).collect()} == {"a": "no_keys", "b": "quota", "c": "rate_limited", "d": "invalid", "e": "none", "f": "none"}


def test_daily_stream_equals_batch(spark, tmp_path):
    rows = [(str(i), "m", f"p{i % 3}", f"2024-01-{1 + i % 5:02} 10:00:00", i, i, None) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, model string, provider string, at string, input_tokens int, output_tokens int, cached_tokens int").withColumn("at", F.col("at").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    got = []
    q = state.daily_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(lambda b, i: (got.clear(), got.extend(b.collect()))).start()
    q.awaitTermination(120)
    assert {(r.day, r.provider, r.requests, r.output_tokens) for r in got} == {(r.day, r.provider, r.requests, r.output_tokens) for r in usage.daily(df).collect()}


def test_layout_columns():
    runs = [run("COLUMNS DEMO", 40, 60, 24, True)]
    for i in range(10):
        runs += [run(f"Left column line number {i} here", 40, 100 + i * 16), run(f"Right column line number {i}", 345, 100 + i * 16)]
    page = layout.page_state(runs, 595, 842)
    texts = [b["text"] for b in page["blocks"]]
    assert "columns" in page["warnings"] and page["blocks"][0]["kind"] == "heading" and len(texts) == 3
    assert texts[1].count("Left") == 10 and texts[2].count("Right") == 10
    # three columns with gutters off the page's middle
    three = [run(f"{word} col a b c {i}", x, 100 + i * 16) for i in range(10) for word, x in (("first", 30), ("second", 150), ("third", 420))]
    assert [b["text"].split()[0] for b in layout.page_state(three, 595, 842)["blocks"]] == ["first", "second", "third"]


def test_page_states():
    image = {"x": 100.0, "y": 300.0, "right": 300.0, "bottom": 450.0}
    assert layout.page_state([], 595, 842, images=[image])["requires_ocr"] and layout.page_state([], 595, 842)["warnings"] == ["empty"]
    body = [run("Body text that fills the page with enough characters", 40, 100), run("to dominate the histogram over the caption words here.", 40, 116)]
    page = layout.page_state([*body, run("A small sample diagram", 100, 468, 10)], 595, 842, images=[image], links=[{"x": 40.0, "y": 90.0, "right": 240.0, "bottom": 104.0, "url": "https://example.com/docs"}], rotation=90)
    assert [b["kind"] for b in page["blocks"]] == ["paragraph", "caption"] and page["blocks"][0]["link"] == "https://example.com/docs" and page["warnings"] == ["rotated"]


def test_all_units_ask_the_memory(spark, tmp_path, monkeypatch):
    """memory_suggest: each unit with a text, finished or not, asks all finished units of its project, in one slice or several."""
    from folioflow.plans import catalog

    random.seed(7)
    words = "the key pool opens file editor again reads list page".split()
    states = ["translated", "reviewed", "pending", "failed", None]
    rows = [(f"u{i:03}", f"d{i % 5}", random.choice("ppq"), " ".join(random.choice(words) for _ in range(random.randint(1, 5))), random.choice(["x", "x", " ", None]), random.choice(states[:2] + states), 1) for i in range(250)]
    rows += [("e", "d0", "p", "?", "x", "reviewed", 1), ("n", "d0", "p", None, "x", "reviewed", 1), ("z", "none", "p", "the key", "x", "reviewed", 1)]
    old = [(i, doc, p, "the key pool", "x", "reviewed", 0) for i, doc, p, *_ in rows[:20]]  # older rows of the same units
    spark.createDataFrame(rows + old, "block_id string, document_id string, project_id string, source_text string, translated_text string, unit_status string, updated_at int").selectExpr("*", "updated_at AS ingested_at").write.parquet(f"{tmp_path}/export_block.parquet")
    spark.createDataFrame([(f"d{i}", ["my", "my", "de"][i % 3]) for i in range(5)], "document_id string, target_language string").write.parquet(f"{tmp_path}/export_document.parquet")

    def score(a, b):
        share = lambda x, y: 2 * sum((Counter(x) & Counter(y)).values()) / (len(x) + len(y))
        g = lambda t: [t[i : i + 2] for i in range(len(t) - 1)]
        return 1.0 if a == b else 0.5 * share(a.split(), b.split()) + 0.5 * share(g(a), g(b))

    target = {f"d{i}": ["my", "my", "de"][i % 3] for i in range(5)}
    units = [(i, (p, target[doc]), t, s in ("translated", "reviewed") and (a or " ").strip() != "") for i, doc, p, t, a, s, _ in rows if doc in target and (t or "?") != "?"]
    want = set()
    for i, group, t, _ in units:
        found = sorted((-score(t, x), j) for j, g, x, done in units if done and g == group and j != i)
        want |= {(i, j, r + 1, round(-s, 9)) for r, (s, j) in enumerate([x for x in found if x[0] <= -0.6][:3])}
    assert len({i for i, *_ in want}) > 50 and {i for i, *_ in want} - {i for i, _, _, done in units if done}
    for most in (16_000, 7):
        monkeypatch.setattr(quality, "SLICE", most, raising=False)
        got = [(r.query_id, r.match_id, r.rank, round(r.score, 9)) for r in catalog.memory_suggest(spark, str(tmp_path)).collect()]
        assert len(got) == len(want) and set(got) == want
