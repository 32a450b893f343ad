"""Queries of job states, limits, displayed values and smaller reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions import display
from folioflow.operators import records, responses, translate, usage
from folioflow.plans.catalog import query
from folioflow.plans.documents import _POOL, _pool
from folioflow.tables import ship, table

_KIND = "CASE o_orderkey % 6 WHEN 0 THEN 'inspect_document' WHEN 1 THEN 'extract_text' WHEN 2 THEN 'translate_document' WHEN 3 THEN 'export_document' WHEN 4 THEN 'sync_push' END"


@query(f"SELECT id, CASE WHEN k IN ('inspect_document', 'extract_text', 'sync_push') THEN 'analyzing' WHEN k = 'translate_document' THEN 'translating' WHEN k = 'export_document' THEN 'exporting' END AS state FROM (SELECT o_orderkey AS id, {_KIND} AS k FROM orders)")
def jobs_started(spark, d):
    return table(spark, d, "orders").selectExpr("o_orderkey AS id", f"{_KIND} AS k").select("id", usage.active_state(F.col("k")).alias("state"))


@query(
    f"""WITH j AS (SELECT o_orderkey AS id, {_KIND} AS k, CASE WHEN o_orderkey % 7000 = 3 THEN 'translating' WHEN o_orderstatus = 'O' THEN 'queued' ELSE 'completed' END AS state, 6 - CAST(substr(o_orderpriority, 1, 1) AS INT) AS p, o_orderdate AS q FROM orders),
    n AS (SELECT count(*) AS running FROM j WHERE state IN ('analyzing', 'translating', 'exporting')), r AS (SELECT *, row_number() OVER (ORDER BY p DESC, q, id) AS nth FROM j WHERE state = 'queued')
    SELECT id, CASE WHEN k IN ('inspect_document', 'extract_text', 'sync_push') THEN 'analyzing' WHEN k = 'translate_document' THEN 'translating' WHEN k = 'export_document' THEN 'exporting' END AS state FROM r, n WHERE nth <= 20 - running"""
)
def jobs_scheduled(spark, d):
    state = "CASE WHEN o_orderkey % 7000 = 3 THEN 'translating' WHEN o_orderstatus = 'O' THEN 'queued' ELSE 'completed' END"
    j = table(spark, d, "orders").selectExpr("o_orderkey AS id", f"{_KIND} AS type", f"{state} AS state", "6 - CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority", "o_orderdate AS queued_at")
    return usage.schedule(j, 20)


@query(
    """SELECT o_orderkey AS id, CASE WHEN o_orderstatus <> 'F' AND a < 3 THEN 'retrying' ELSE 'failed' END AS state, CASE WHEN o_orderstatus <> 'F' AND a < 3 THEN CAST(floor(0.75::DOUBLE * least(60000, 1500 * pow(2, a)) + 0.5::DOUBLE) AS BIGINT) END AS delay_ms,
    a + 1 AS attempts FROM (SELECT *, o_orderkey % 5 AS a FROM orders)"""
)
def jobs_failed(spark, d):
    j = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 5).alias("attempts"), (F.col("o_orderstatus") != "F").alias("retryable"))
    return usage.after_failure(j)


@query(
    """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS key_id, event_id AS id, epoch_us(ts) // 1000 AS at_ms FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL), l AS (SELECT *, max(at_ms) OVER (PARTITION BY key_id) AS last FROM e),
    r AS (SELECT *, row_number() OVER (PARTITION BY key_id ORDER BY at_ms DESC, id DESC) AS nth FROM l WHERE at_ms >= last - 86400000 * 5) SELECT key_id, id FROM r WHERE nth <= 3"""
)
def events_pruned(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("key_id"), F.col("event_id").alias("id"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("at_ms"))
    return usage.pruned(e, 86_400_000 * 5, 3).select("key_id", "id")  # the shop's events are rarer than a pool's


@query(
    f"""WITH z AS (SELECT *, CASE WHEN NOT enabled THEN 'disabled' WHEN verification = 'revoked' OR health = 'invalid' THEN 'verification_failed' WHEN cooldown_until > now_ms THEN 'cooling' END AS rj FROM ({_POOL})),
    g AS (SELECT provider, count(rj) AS n, count(*) FILTER (rj = 'disabled') AS dis, count(*) FILTER (rj = 'verification_failed') AS bad, count(*) FILTER (rj = 'cooling') AS cool, count(*) FILTER (rj = 'cooling' AND reason = 'quota') AS quota FROM z GROUP BY 1)
    SELECT provider, CASE WHEN n = 0 OR dis = n THEN 'provider_unavailable' WHEN bad = n THEN 'provider_invalid_key' WHEN cool = n AND quota = n THEN 'provider_quota_exceeded' ELSE 'provider_rate_limited' END AS code, n > 0 AND dis < n AND bad < n AND NOT (cool = n AND quota = n) AS retryable FROM g"""
)
def pool_errors(spark, d):
    k = _pool(spark, d)
    for name in ("rpm_limit", "tpm_limit", "requests_in_window", "tokens_in_window", "estimated_tokens"):
        k = k.withColumn(name, F.lit(None).cast("int"))
    k = k.withColumn("supports_model", F.lit(True))
    k = k.withColumn("rejection", usage.rejection(F.col("now_ms")))
    reasons = k.groupBy("provider").agg(F.collect_set("rejection").alias("reasons"))
    e = usage.pool_error(F.col("exhaustion"), F.col("reasons")).alias("e")
    return usage.exhaustion(k).join(reasons, "provider").select("provider", e).select("provider", "e.code", "e.retryable")


@query(
    """SELECT DISTINCT document_id, CASE WHEN format_name = 'pdf' THEN 'pdf' WHEN lower(file_name) LIKE '%.docx' THEN 'docx' WHEN lower(file_name) LIKE '%.md' OR lower(file_name) LIKE '%.markdown' THEN 'markdown' WHEN lower(file_name) LIKE '%.html' OR lower(file_name) LIKE '%.htm' THEN 'html'
    WHEN lower(file_name) LIKE '%.csv' THEN 'csv' WHEN lower(file_name) LIKE '%.json' THEN 'json' ELSE 'text' END AS type, coalesce(CASE WHEN regexp_matches(title, '\\S') THEN trim(title) END, file_name) AS title FROM export_document"""
)
def document_hints(spark, d):
    x = table(spark, d, "export_document")
    return x.select("document_id", translate.document_type(F.col("format_name"), F.col("file_name")).alias("type"), translate.document_title(F.col("title"), F.col("file_name")).alias("title")).distinct()


_SIZE = "CASE WHEN n IS NULL OR n < 1 THEN '0 B' WHEN n < 1024 THEN printf('%.0f B', n::DOUBLE) WHEN n < 1048576 THEN printf('%.1f KB', floor(n * 10 / 1024.0::DOUBLE + 0.5::DOUBLE) / 10) ELSE printf('%.1f MB', floor(n * 10 / 1048576.0::DOUBLE + 0.5::DOUBLE) / 10) END"


@query(
    f"""SELECT doc_id, {_SIZE} AS size, CASE WHEN n >= 1000 THEN printf('%.1fk', floor(n / 100.0::DOUBLE + 0.5::DOUBLE) / 10) ELSE CAST(n AS VARCHAR) END AS count, CASE WHEN floor(n * 7 / 1000.0::DOUBLE + 0.5) < 60 THEN CAST(CAST(floor(n * 7 / 1000.0::DOUBLE + 0.5) AS BIGINT) AS VARCHAR) || 's'
    ELSE CAST(CAST(floor(floor(n * 7 / 1000.0::DOUBLE + 0.5) / 60) AS BIGINT) AS VARCHAR) || 'm ' || lpad(CAST(CAST(floor(n * 7 / 1000.0::DOUBLE + 0.5) AS BIGINT) % 60 AS VARCHAR), 2, '0') || 's' END AS duration, left(CAST(doc_id AS VARCHAR) || '-abcdefghij', 8) AS short FROM (SELECT doc_id, n_chars AS n FROM documents)"""
)
def displayed(spark, d):
    n = F.col("n_chars")
    return table(spark, d, "documents").select(
        "doc_id", display.bytes_text(n).alias("size"), display.count_text(n).alias("count"), display.duration_text(n * 7).alias("duration"), display.short_id(F.concat(F.col("doc_id").cast("string"), F.lit("-abcdefghij"))).alias("short")
    )


@query(
    """WITH r AS (SELECT DISTINCT result_id, coalesce(input_tokens, 0) AS n FROM generate_result) SELECT result_id, CAST(CASE WHEN n % 3 = 0 THEN (n % 90) * 1000 WHEN n % 3 = 1 THEN (n % 7) * 60000 + (n % 60) * 1000 END AS BIGINT) AS retry_after_ms,
    CASE WHEN n % 2 = 0 THEN CAST(n AS DOUBLE) END AS limit_rpm, CASE WHEN n % 5 > 0 THEN CAST(n % 5 AS DOUBLE) END AS remaining_tokens FROM r"""
)
def rate_headers(spark, d):
    n = F.coalesce("input_tokens", F.lit(0))
    r = table(spark, d, "generate_result").select("result_id", n.alias("n")).distinct()
    n = F.col("n")
    text = lambda c: c.cast("string")
    h = F.create_map(
        F.lit("retry-after"), F.when(n % 3 == 0, text(n % 90)), F.lit("x-ratelimit-reset"), F.when(n % 3 == 1, F.concat(text(n % 7), F.lit("m"), text(n % 60), F.lit("s"))), F.lit("x-ratelimit-reset-requests"), F.lit(None).cast("string"),
        F.lit("x-ratelimit-limit-requests"), F.when(n % 2 == 0, text(n)), F.lit("x-ratelimit-remaining-requests"), F.lit("many"), F.lit("x-ratelimit-limit-tokens"), F.lit(None).cast("string"),
        F.lit("x-ratelimit-remaining-tokens"), F.when(n % 5 > 0, text(n % 5)),
    )
    return r.select("result_id", responses.rate_hints(h, F.lit(1_792_567_600_000)).alias("x")).select("result_id", "x.retry_after_ms", "x.limit_rpm", "x.remaining_tokens")


@query("SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(text, '[^\\x{0020}-\\x{024F}\\x{1000}-\\x{109F}\\s]'))) AS BIGINT) AS missing FROM documents WHERE text IS NOT NULL")
def missing_glyphs(spark, d):
    m = responses.missing_glyphs(F.col("text"), r"\x{0020}-\x{024F}\x{1000}-\x{109F}")
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.size(m).cast("bigint").alias("missing"))


@query("SELECT n_nationkey, 'unknown entry' AS error FROM nation WHERE n_nationkey >= 20 UNION ALL SELECT n_nationkey, 'n_name not allowed' FROM nation WHERE n_name NOT IN ('FRANCE', 'GERMANY')")
def overlay_checks(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    return records.overlay_errors(n, n.where("n_nationkey < 20"), ("n_nationkey",), {"n_name": ["FRANCE", "GERMANY"]})


@query("SELECT DISTINCT key_id FROM generate_result WHERE key_id IS NOT NULL AND provider_id IS NOT NULL AND key_id NOT IN (SELECT key_id FROM generate_result WHERE finish_reason IS NULL AND key_id IS NOT NULL)")
def orphan_keys(spark, d):
    g = table(spark, d, "generate_result").where("key_id IS NOT NULL AND provider_id IS NOT NULL")
    return records.orphans(g.select("key_id").distinct(), table(spark, d, "generate_result").where("finish_reason IS NULL AND key_id IS NOT NULL"), "key_id")


@query("SELECT event_id AS id FROM (SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id) AS nth FROM events WHERE event_type = 'error') WHERE nth <= 500")
def log_trimmed(spark, d):
    e = table(spark, d, "events").where("event_type = 'error'").select(F.col("event_id").alias("id"), F.col("ts").alias("at"))
    return records.newest_log(e, 500).select("id")


@query()
def deep_redacted(spark, d):
    ship(spark)
    g = table(spark, d, "generate_result")
    rows = g.select("result_id", F.to_json(F.struct(*[c for c in g.columns if c != "result_id"])).alias("json")).distinct()
    return records.deep_redact(rows, "result_id", "json").select("result_id", F.md5("record").alias("h"), F.contains("record", F.lit("[redacted]")).alias("redacted"))


_REFUSED = "CASE coalesce(input_tokens, 0) % 5 WHEN 0 THEN 'max_completion_tokens is too large' WHEN 1 THEN 'Response-Format json_object is not supported' WHEN 2 THEN 'maximum number of tokens' WHEN 3 THEN left(coalesce(text, ''), 200) END"


@query(
    f"""SELECT DISTINCT result_id, CASE WHEN coalesce(output_tokens, 0) % 2 = 0 THEN CASE WHEN regexp_matches(coalesce(m, ''), '{responses.OUTPUT_PARAM}') THEN 'output_tokens' WHEN regexp_matches(coalesce(m, ''), '{responses.FORMAT_PARAM}') THEN 'response_format' END END AS refused
    FROM (SELECT *, {_REFUSED} AS m FROM generate_result)"""
)
def refused_parameters(spark, d):
    r = table(spark, d, "generate_result").selectExpr("result_id", "CASE WHEN coalesce(output_tokens, 0) % 2 = 0 THEN 'rejected' ELSE 'server_error' END AS c", f"{_REFUSED} AS m")
    return r.select("result_id", responses.refused_parameter(F.col("c"), F.col("m")).alias("refused")).distinct()


_MADE = "CASE length(text) % 4 WHEN 0 THEN 'gsk_' || left(sha256(result_id), 20) WHEN 1 THEN 'sk-or-v1-' || sha256(result_id) WHEN 2 THEN ' ' || left(sha256(result_id), length(text) % 30) END"


@query(
    f"""SELECT DISTINCT result_id, CASE maker WHEN 'groq' THEN regexp_matches(k, '{usage.KEY_FORMS["groq"]}') WHEN 'openrouter' THEN regexp_matches(k, '{usage.KEY_FORMS["openrouter"]}') ELSE length(k) >= 16 END AS well_formed
    FROM (SELECT result_id, CASE length(result_id || coalesce(text, '')) % 3 WHEN 0 THEN 'groq' WHEN 1 THEN 'openrouter' ELSE 'other' END AS maker, trim(coalesce({_MADE}, '')) AS k FROM generate_result)"""
)
def key_forms(spark, d):
    made = _MADE.replace("sha256(result_id)", "sha2(result_id, 256)")
    r = table(spark, d, "generate_result").selectExpr("result_id", "CASE length(result_id || coalesce(text, '')) % 3 WHEN 0 THEN 'groq' WHEN 1 THEN 'openrouter' ELSE 'other' END AS maker", f"{made} AS k")
    return r.select("result_id", usage.looks_like_key(F.col("maker"), F.col("k")).alias("well_formed")).distinct()


@query(
    """SELECT provider, CAST(day AS VARCHAR) AS day, requests FROM (SELECT provider_id AS provider, CAST(received_at AS DATE) AS day, count(DISTINCT result_id) AS requests FROM generate_result WHERE provider_id IS NOT NULL AND received_at IS NOT NULL GROUP BY 1, 2)
    ORDER BY day DESC, provider LIMIT 8"""
)
def usage_recent(spark, d):
    g = table(spark, d, "generate_result").where("provider_id IS NOT NULL AND received_at IS NOT NULL")
    n = g.groupBy(F.col("provider_id").alias("provider"), F.col("received_at").cast("date").alias("day")).agg(F.countDistinct("result_id").alias("requests"))
    return n.orderBy(F.desc("day"), "provider").limit(8).select("provider", F.col("day").cast("string").alias("day"), "requests")


@query("SELECT key_id FROM (SELECT key_id, min(received_at) AS made FROM generate_result WHERE key_id IS NOT NULL GROUP BY 1) ORDER BY made DESC NULLS LAST, key_id LIMIT 20")
def keys_listed(spark, d):
    k = table(spark, d, "generate_result").where("key_id IS NOT NULL").groupBy("key_id").agg(F.min("received_at").alias("made"))
    return k.orderBy(F.desc_nulls_last("made"), "key_id").limit(20).select("key_id")
