from pyspark.sql import functions as F

from folioflow.operators import pages, records, responses, spatial


def test_upsert_and_index(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string")
    new = spark.createDataFrame([(3, "z"), (4, "d"), (4, "e")], "k int, v string")
    assert {tuple(r) for r in records.upsert(df, new, "k").collect()} == {(1, "a"), (2, None), (3, "z"), (4, "e")}
    assert [r.k for r in records.by_index(df, "v", "k", count=5).collect()] == [1, 3]
    assert [r.k for r in records.by_index(df, "v", "k", equal="c").collect()] == [3]
    assert records.delete(df, new, "k").count() == 2
    empty = df.limit(0)
    assert records.upsert(empty, new, "k").count() == 2 and records.delete(empty, new, "k").count() == 0


def test_settings_and_glossary(spark):
    s = records.settings(spark.createDataFrame([("batch_concurrency", "x"), ("target_language", '"de"')], "key string, value string")).first()
    assert (s.batch_concurrency, s.target_language, s.usage_tracking) == (3, "de", True)
    rows = [("r1", "p", "Key Pool", "x"), ("r2", "p", "key  pool", "y"), ("r3", "q", " ", "z"), ("r4", "q", "k" * 201, "z")]
    got = {tuple(r) for r in records.glossary_errors(spark.createDataFrame(rows, "rule_id string, project_id string, source_term string, preferred string")).collect()}
    assert got == {("r2", "duplicate term"), ("r3", "source_term missing"), ("r4", "source_term too long")}


def test_bundle_is_redacted(spark):
    df = spark.createDataFrame([("gsk_" + "a" * 20,)], "token string")
    assert "gsk_" not in records.bundle({"t": df}).first().record


def test_spatial(spark):
    box = lambda x, y, w, h: (float(x), float(y), float(w), float(h))
    t = "struct<x double, y double, width double, height double>"
    blocks = spark.createDataFrame([("c", "d", 0, box(10, 110, 80, 10)), ("far", "d", 0, box(10, 300, 80, 10)), ("other", "d", 1, box(10, 110, 80, 10))], f"block_id string, document_id string, page_index int, box {t}")
    figures = spark.createDataFrame([("d", 0, box(0, 0, 100, 100))], f"document_id string, page_index int, box {t}")
    assert [r.block_id for r in spatial.captions(blocks, figures).collect()] == ["c"]
    links = spark.createDataFrame([("l1", "d", 0, box(10, 110, 20, 10), "u1"), ("l2", "d", 0, box(15, 112, 20, 8), "u2"), ("l3", "d", 0, box(10, 119, 20, 40), "u3")], f"link_id string, document_id string, page_index int, box {t}, url string")
    assert {tuple(r) for r in spatial.links(blocks, links).collect()} == {("c", "u2")}
    x = spark.createDataFrame([(5.0,), (275.0,), (400.0,)], "x double")
    assert [r[0] for r in x.select(spatial.nearest_region(F.col("x"), [(40.0, 250.0), (300.0, 500.0)])).collect()] == [0, 0, 1]


def test_responses(spark):
    rows = [("a", '```json\n{"translations": [{"id": "u1", "text": "x"}, {"id": "u2", "text": " "}]}\n```'), ("b", 'Here: {"u1": "y", "u2": "z"}'), ("c", "no"), ("d", None), ("e", '{"translations": [{"id": "u1"')]
    df = spark.createDataFrame(rows, "result_id string, text string")
    assert {tuple(r) for r in responses.translations(df).collect()} == {("a", "u1", "x"), ("b", "u1", "y"), ("b", "u2", "z")}
    v = spark.createDataFrame([("30",), ("1m30s",), ("250ms",), ("2h",), ("soon",), (None,)], "v string")
    assert [r[0] for r in v.select(responses.retry_after_ms(F.col("v"), F.lit(0))).collect()] == [30_000, 90_000, 250, 7_200_000, None, None]


def test_pagination(spark):
    assert pages.wrap("aaa bbb ccc", 10, 40) == ["aaa bbb", "ccc"] and pages.wrap("aaaaaaaaaa", 10, 25) == ["aaaaa", "aaaaa"]
    assert pages.wrap("ééé", 10, 10) == ["éé", "é"] and pages.wrap("", 10, 10) == [""]
    long = [{"kind": "paragraph", "level": None, "text": "word " * 4000}, {"kind": "heading", "level": 1, "text": "T"}]
    plan = pages.paginate(long)
    assert {p for _, p, *_ in plan} == {0, 1} and plan[0][4] is False and plan[1][4] is True
    assert sum(n for _, p, _, n, _ in plan if p == 0) == len(pages.wrap("word " * 4000, pages.BODY, pages.WIDTH - 2 * pages.MARGIN))
    df = spark.createDataFrame([("d", 0, "paragraph", None, None)], "document_id string, pos int, kind string, level int, text string")
    assert pages.render_plan(df).count() == 1 and pages.render_plan(df.limit(0)).count() == 0
