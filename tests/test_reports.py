import json

from pyspark.sql import functions as F

from folioflow.functions import display
from folioflow.operators import records, responses, translate, usage


def test_display(spark):
    df = spark.createDataFrame([(0,), (512,), (1536,), (3 * 1024**3,), (None,)], "n bigint")
    assert [r[0] for r in df.select(display.bytes_text(F.col("n"))).collect()] == ["0 B", "512 B", "1.5 KB", "3.0 GB", "0 B"]
    df = spark.createDataFrame([(0,), (999,), (1250,), (2_340_000,)], "n bigint")
    assert [tuple(r) for r in df.select(display.count_text(F.col("n")), display.tokens_text(F.col("n"))).collect()] == [("0", "0"), ("999", "999"), ("1.3k", "1.3k"), ("2.3M", "2.34M")]
    df = spark.createDataFrame([(-1,), (0,), (59_400,), (125_000,), (None,)], "n bigint")
    assert [r[0] for r in df.select(display.duration_text(F.col("n"))).collect()] == ["—", "0s", "59s", "2m 05s", "—"]


def test_rate_hints(spark):
    now = 1_000_000
    rows = [({"retry-after": "30"},), ({"x-ratelimit-reset": "1m30s", "x-ratelimit-limit-requests": "60"},), ({"x-ratelimit-reset-requests": "2h"},), ({"x-ratelimit-reset": "45"},), ({"x-ratelimit-remaining-tokens": "many"},), ({},), (None,)]
    df = spark.createDataFrame(rows, "h map<string,string>")
    got = [r.x for r in df.select(responses.rate_hints(F.col("h"), F.lit(now)).alias("x")).collect()]
    assert [x.retry_after_ms for x in got] == [30_000, 90_000, 7_200_000, 45_000, None, None, None]
    assert got[1].limit_rpm == 60 and got[4].remaining_tokens is None


def test_job_states(spark):
    df = spark.createDataFrame([("extract_text",), ("translate_document",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(usage.active_state(F.col("t"))).collect()] == ["analyzing", "translating", None, None]
    j = spark.createDataFrame([(1, "extract_text", "queued", 1, 5), (2, "export_document", "queued", 2, 9), (3, "extract_text", "analyzing", 1, 1), (4, "sync_push", "queued", 1, 4)], "id int, type string, state string, priority int, queued_at int")
    assert [(r.id, r.state) for r in usage.schedule(j, 3).collect()] == [(2, "exporting"), (4, "analyzing")]
    assert usage.schedule(j, 1).count() == 0 and usage.schedule(j.limit(0), 2).count() == 0
    f = spark.createDataFrame([(1, 0, True), (2, 3, True), (3, 0, False), (4, 1, None)], "id int, attempts int, retryable boolean")
    assert [(r.state, r.delay_ms, r.attempts) for r in usage.after_failure(f).orderBy("id").collect()] == [("retrying", 1125, 1), ("failed", None, 4), ("failed", None, 1), ("failed", None, 2)]
    e = spark.createDataFrame([("k", i, i * 1000) for i in range(10)] + [("k", 99, None), (None, 98, 5)], "key_id string, id int, at_ms bigint")
    assert {r.id for r in usage.pruned(e, 5_000, 4).collect()} == {6, 7, 8, 9}


def test_pool_error(spark):
    df = spark.createDataFrame([("quota", ["cooling"]), ("none", ["unsupported_model"]), ("none", ["disabled", "cooling"]), ("none", None), ("rate_limited", ["cooling"])], "e string, r array<string>")
    got = [tuple(r.x) for r in df.select(usage.pool_error(F.col("e"), F.col("r")).alias("x")).collect()]
    assert got == [("provider_quota_exceeded", False), ("provider_invalid_model", False), ("provider_rate_limited", True), ("provider_unavailable", False), ("provider_rate_limited", True)]


def test_deep_redact(spark):
    deep = {"a": {"b": {"c": {"d": {"e": {"f": {"g": {"h": 1}}}}}}}}
    rows = [(1, json.dumps({"apiKey": "x", "list": [{"password": 1, "n": 2}], "text": "Bearer abcdefghijklmnopqrstuv"})), (2, json.dumps(deep)), (3, "secret = abcdefghij"), (4, None)]
    got = {r.id: r.record for r in records.deep_redact(spark.createDataFrame(rows, "id int, j string"), "id", "j").collect()}
    assert json.loads(got[1]) == {"apiKey": "[redacted]", "list": [{"password": "[redacted]", "n": 2}], "text": "[redacted]"}
    assert "[depth-limit]" in got[2] and got[3] == "[redacted]" and got[4] is None


def test_names(spark):
    df = spark.createDataFrame([("pdf", "a.docx", " "), ("x", "A.MD", "T "), (None, None, None)], "k string, f string, t string")
    assert [tuple(r) for r in df.select(translate.document_type(F.col("k"), F.col("f")), translate.document_title(F.col("t"), F.col("f"))).collect()] == [("pdf", "a.docx"), ("markdown", "T"), ("text", None)]
    g = spark.createDataFrame([("aßသ漢漢字",), (None,)], "t string")
    assert [r[0] for r in g.select(responses.missing_glyphs(F.col("t"), r"\x{0020}-\x{024F}\x{1000}-\x{109F}")).collect()] == [["漢", "字"], []]


def test_keys_and_refusals(spark):
    df = spark.createDataFrame([("groq", "gsk_" + "a" * 20), ("groq", "sk-x"), ("other", " " + "a" * 16), ("other", "short"), ("gemini", "AIza" + "b" * 20), ("other", None)], "m string, k string")
    assert [r[0] for r in df.select(usage.looks_like_key(F.col("m"), F.col("k"))).collect()] == [True, False, True, False, True, False]
    df = spark.createDataFrame([("rejected", "max_tokens too large"), ("rejected", "JSON mode unavailable"), ("auth", "max_tokens"), ("rejected", "no"), ("rejected", None)], "c string, m string")
    assert [r[0] for r in df.select(responses.refused_parameter(F.col("c"), F.col("m"))).collect()] == ["output_tokens", "response_format", None, None, None]
