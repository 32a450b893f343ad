from pyspark.sql import functions as F

from folioflow.operators import records, translate, usage
from folioflow.sources import formats


def test_prompt(spark):
    df = spark.createDataFrame([("de", "my", "pdf"), (None, "my", None)], "a string, b string, c string")
    got = df.select(translate.instructions(F.col("a"), F.col("b"), F.col("c")).alias("t"), translate.message_tokens(F.lit("abcd"), F.lit(None).cast("string")).alias("n")).collect()
    assert "from de to my" in got[0].t and "type pdf" in got[0].t and "from und" in got[1].t and "{" not in got[0].t
    assert got[0].n == 1 + 4 + 4


def test_output_budget(spark):
    df = spark.createDataFrame([(8192, 2048, 1000), (8192, 2048, 7000), (8192, 2048, 9000), (None, None, 0)], "c int, m int, p int")
    assert [r[0] for r in df.select(translate.output_budget(F.col("c"), F.col("m"), F.col("p"))).collect()] == [2048, 1192, 512, 2048]


def test_halves(spark):
    rows = [("b", f"u{i}", i, 100 * (i + 1), 4000) for i in range(5)] + [("one", "x", 0, 5, 900), ("empty", "y", 0, 0, 700), ("empty", "z", 1, 0, 700)]
    got = translate.halves(spark.createDataFrame(rows, "batch_id string, unit_id string, position int, chars int, budget int")).collect()
    half = {(r.batch_id, r.unit_id): (r.half, r.budget) for r in got}
    assert [half["b", f"u{i}"][0] for i in range(5)] == [0, 0, 0, 1, 1] and half["b", "u0"][1] == 1600 and half["b", "u4"][1] == 2400
    assert half["empty", "y"] == (0, 700) and half["empty", "z"] == (1, 700) and len(got) == 7


def test_write_back(spark):
    units = spark.createDataFrame([("a", "pending", None, 0), ("b", "reviewed", "keep", 0), ("c", "translated", "old", 1), ("d", None, None, None), ("e", "failed", "x", 2)], "unit_id string, unit_status string, translated_text string, retries int")
    ran = spark.createDataFrame([("a", "1", "A", 100), ("b", "1", "B", 100), ("c", "1", None, 100), ("d", "2", "D", 7)], "unit_id string, batch_id string, text string, batch_tokens int")
    got = {r.unit_id: tuple(r)[1:] for r in translate.write_back(units, ran).collect()}
    assert got == {"a": ("translated", "A", 33, 0), "b": ("reviewed", "keep", None, 0), "c": ("failed", "old", None, 2), "d": ("translated", "D", 7, 0), "e": ("failed", "x", None, 2)}
    assert translate.write_back(units.limit(0), ran).count() == 0


def test_candidates_and_languages(spark):
    configs = spark.createDataFrame([("p", "m", True, 2), ("q", "n", True, 1), ("r", "o", True, 0), ("s", "x", False, 0), ("t", None, True, 0)], "provider string, model string, enabled boolean, rank int")
    catalog = spark.createDataFrame([("p", "m", 16000, 4000)], "provider string, model string, context int, output int")
    pools = spark.createDataFrame([("p", "rate_limited"), ("q", "none"), ("r", "quota")], "provider string, exhaustion string")
    assert [tuple(r) for r in translate.candidates(configs, catalog, pools).collect()] == [("q", "n", 8192, 2048, 1), ("p", "m", 16000, 4000, 2)]
    units = spark.createDataFrame([("u1", "d1", "en"), ("u2", "d1", None), ("u3", "d2", "en"), ("u4", "d3", "fr")], "unit_id string, document_id string, source_language string")
    found = spark.createDataFrame([("d1", "fr"), ("d2", "unknown"), ("d3", "fr")], "document_id string, language string")
    assert {tuple(r) for r in translate.set_language(units, found).collect()} == {("u1", "fr"), ("u2", "fr")}


def test_glossary_rules(spark):
    e = spark.createDataFrame([("p", " b ", "B", " "), ("p", "a", "A", "x"), ("p", "a", "A", "x"), ("p", "c", None, None), ("q", "", "z", None)], "project_id string, source_term string, preferred string, forbidden string")
    assert [(r.project_id, [tuple(x) for x in r.rules]) for r in translate.glossary_rules(e).collect()] == [("p", [("a", "A", "x"), ("b", "B", None)])]


def test_import(spark):
    store = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    raw = records.bundle({"s": spark.createDataFrame([(2, "B"), (3, "c"), (None, "x")], store.schema)}).unionByName(spark.createDataFrame([("s", "{"), ("t", "{}"), (None, None)], "store string, record string"))
    assert sorted(tuple(r) for r in records.import_bundle(raw, {"s": (store, "id")})["s"].collect()) == [(1, "a"), (2, "B"), (3, "c")]


def test_jobs(spark):
    j = spark.createDataFrame([(1, "x", "active"), (2, "x", "queued"), (3, "y", "queued")], "id int, subject string, state string")
    assert {r.id for r in usage.admitted(j, ["active"]).collect()} == {1, 3}
    assert {(r.id, r.state, r.interruptions) for r in usage.recovered(j.withColumn("interruptions", F.lit(1)), ["active"]).collect()} == {(1, "queued", 2), (2, "queued", 1), (3, "queued", 1)}


def test_decode(spark):
    f = spark.createDataFrame([(1, bytearray("naïve".encode())), (2, bytearray(b"\xff\xfe")), (3, None), (4, bytearray("\ufeffx".encode()))], "id int, content binary")
    assert [(r.id, r.state, r.text) for r in formats.decode(f).orderBy("id").collect()] == [(1, "ok", "naïve"), (2, "undecodable", None), (3, "undecodable", None), (4, "ok", "x")]
