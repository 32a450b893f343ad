"""Queries of a translation run, bundle import, provider errors and small store reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import records, responses, translate, usage
from folioflow.operators import units as U
from folioflow.plans.catalog import _W, NEWEST, _count_sql, _units, query
from folioflow.tables import table

_ASCII = r"[\x{00}-\x{7F}]"


def _tokens_sql(c: str) -> str:
    return f"CAST(ceil({_count_sql(c, _ASCII)} * 0.25::DOUBLE + {_count_sql(c, _W)} * 1.5::DOUBLE + (length({c}) - {_count_sql(c, _ASCII)} - {_count_sql(c, _W)})) AS BIGINT)"


_TOLD = "replace(replace(replace('" + translate.INSTRUCTIONS.replace("'", "''") + "', '{source}', coalesce(source_language, 'und')), '{target}', coalesce(target_language, 'und')), '{document}', coalesce(document_type, 'und'))"
_CALLS = "c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY requested_at DESC NULLS LAST) AS rn FROM translation_call) WHERE rn = 1)"


def _calls(spark, d):
    c = table(spark, d, "translation_call")
    cols = ("project_id", "source_language", "target_language", "document_type", "model", "max_output_tokens", "units")
    return c.groupBy("call_id").agg(F.max_by(F.struct(*cols), "requested_at").alias("x")).select("call_id", "x.*")


@query(f"SELECT DISTINCT call_id, {_tokens_sql(_TOLD)} + 4 AS tokens FROM translation_call")
def prompt_tokens(spark, d):
    c = table(spark, d, "translation_call")
    return c.select("call_id", translate.message_tokens(translate.instructions(F.col("source_language"), F.col("target_language"), F.col("document_type"))).alias("tokens")).distinct()


@query(
    f"""WITH {_CALLS}, p AS (SELECT call_id, max_output_tokens AS most, {_tokens_sql(_TOLD)} + 4 + CAST(list_sum(list_transform(units, lambda u: u.tokens)) AS BIGINT) AS prompt FROM c)
    SELECT call_id, CAST(greatest(512, least(coalesce(most, 2048), 8192 - prompt)) AS BIGINT) AS budget FROM p WHERE prompt IS NOT NULL"""
)
def output_budgets(spark, d):
    c = _calls(spark, d)
    units = F.aggregate("units", F.lit(0).cast("bigint"), lambda a, u: a + u["tokens"])
    prompt = translate.message_tokens(translate.instructions(F.col("source_language"), F.col("target_language"), F.col("document_type"))) + units
    return c.where(F.size("units") > 0).select("call_id", translate.output_budget(F.lit(8192), F.col("max_output_tokens"), prompt).cast("bigint").alias("budget"))


@query(
    """WITH b AS (SELECT call_id, u.id AS unit_id, min(i) AS position, max(length(u.text)) AS chars, max(coalesce(cap, 2048)) AS budget FROM (SELECT call_id, max_output_tokens AS cap, unnest(units) AS u, generate_subscripts(units, 1) - 1 AS i FROM translation_call) GROUP BY 1, 2),
    n AS (SELECT *, count(*) OVER (PARTITION BY call_id) AS n, row_number() OVER (PARTITION BY call_id ORDER BY position, unit_id) AS i FROM b), h AS (SELECT *, CAST(i > ceil(n / 2) AS INT) AS half FROM n WHERE n > 1)
    SELECT call_id AS batch_id, half, count(*) AS units, max(CASE WHEN w > 0 THEN greatest(512, CAST(ceil(budget * o / w) AS BIGINT)) ELSE budget END) AS budget FROM (SELECT *, sum(chars) OVER (PARTITION BY call_id, half) AS o, sum(chars) OVER (PARTITION BY call_id) AS w FROM h) GROUP BY 1, 2"""
)
def batch_halves(spark, d):
    u = table(spark, d, "translation_call").select("call_id", F.coalesce("max_output_tokens", F.lit(2048)).alias("cap"), F.posexplode("units").alias("i", "u"))
    b = u.groupBy(F.col("call_id").alias("batch_id"), F.col("u.id").alias("unit_id")).agg(F.min("i").alias("position"), F.max(F.length("u.text")).alias("chars"), F.max("cap").alias("budget"))
    return translate.halves(b).groupBy("batch_id", "half").agg(F.count("*").alias("units"), F.max("budget").alias("budget"))


@query(
    """WITH m AS (SELECT provider_id AS provider, model, count(DISTINCT result_id) AS n FROM generate_result WHERE provider_id IS NOT NULL AND model IS NOT NULL GROUP BY 1, 2)
    SELECT provider, model, CASE WHEN n % 2 = 0 THEN 16384 ELSE 8192 END AS context, CASE WHEN n % 2 = 0 THEN 4096 ELSE 2048 END AS output, n AS rank FROM m WHERE n % 7 <> 0 AND length(provider) % 5 <> 0"""
)
def run_candidates(spark, d):
    g = table(spark, d, "generate_result").where("provider_id IS NOT NULL AND model IS NOT NULL")
    m = g.groupBy(F.col("provider_id").alias("provider"), "model").agg(F.countDistinct("result_id").alias("n"))
    configs = m.select("provider", "model", (F.col("n") % 7 != 0).alias("enabled"), F.col("n").alias("rank"))
    catalog = m.where("n % 2 = 0").select("provider", "model", F.lit(16384).alias("context"), F.lit(4096).alias("output"))
    pools = m.select("provider").distinct().withColumn("exhaustion", F.when(F.length("provider") % 5 == 0, "quota").otherwise("none"))
    return translate.candidates(configs, catalog, pools)


@query(
    f"""WITH {NEWEST}, o AS (SELECT block_id, document_id, CASE WHEN order_index % 4 <> 1 THEN 'x' || left(source_text, 5) END AS text, count(*) OVER (PARTITION BY document_id) AS n FROM u WHERE order_index % 3 = 0)
    SELECT u.block_id AS unit_id, CASE WHEN o.block_id IS NULL OR u.unit_status = 'reviewed' THEN u.unit_status WHEN o.text IS NULL THEN 'failed' ELSE 'translated' END AS unit_status,
    md5(CASE WHEN coalesce(u.unit_status, 'pending') <> 'reviewed' AND o.text IS NOT NULL THEN o.text ELSE u.translated_text END) AS h, CASE WHEN coalesce(u.unit_status, 'pending') <> 'reviewed' AND o.text IS NOT NULL THEN CAST(floor(1000 / o.n + 0.5::DOUBLE) AS BIGINT) END AS tokens,
    CAST(coalesce(u.unit_status, 'pending') <> 'reviewed' AND o.block_id IS NOT NULL AND o.text IS NULL AS INT) AS retries FROM u LEFT JOIN o ON o.block_id = u.block_id"""
)
def units_written(spark, d):
    u = _units(spark, d, "order_index", "source_text", "translated_text", "unit_status").withColumn("unit_id", F.col("block_id")).withColumn("retries", F.lit(0))
    text = F.when(F.col("order_index") % 4 != 1, F.concat(F.lit("x"), F.left("source_text", F.lit(5))))
    o = u.where("order_index % 3 = 0").select("unit_id", F.col("document_id").alias("batch_id"), text.alias("text"), F.lit(1000).alias("batch_tokens"))
    return translate.write_back(u, o).select("unit_id", "unit_status", F.md5("translated_text").alias("h"), "tokens", "retries")


@query(
    f"""WITH {NEWEST}, x AS (SELECT document_id, max(source_language) AS old, max(CASE WHEN page_count % 4 = 0 THEN 'unknown' WHEN page_count % 4 = 1 THEN source_language ELSE 'fr' END) AS new FROM export_document GROUP BY 1)
    SELECT u.block_id AS unit_id, x.new AS source_language FROM u JOIN x ON x.document_id = u.document_id WHERE x.new IS NOT NULL AND x.new <> 'unknown' AND x.old IS DISTINCT FROM x.new"""
)
def language_propagation(spark, d):
    new = F.when(F.col("page_count") % 4 == 0, "unknown").when(F.col("page_count") % 4 == 1, F.col("source_language")).otherwise("fr")
    x = table(spark, d, "export_document").groupBy("document_id").agg(F.max("source_language").alias("source_language"), F.max(new).alias("language"))
    u = _units(spark, d).join(x.select("document_id", "source_language"), "document_id")
    return translate.set_language(u.withColumn("unit_id", F.col("block_id")), x.select("document_id", "language"))


@query(f"WITH {NEWEST} SELECT document_id, max(order_index) FILTER (unit_status IN ('translated', 'reviewed')) AS furthest, count(*) FILTER (coalesce(unit_status, '') NOT IN ('translated', 'reviewed')) AS left FROM u GROUP BY 1")
def resume_points(spark, d):
    return translate.resume_at(_units(spark, d, "order_index", "unit_status"))


# --- bundle import ---------------------------------------------------------------------------------------------------
@query(
    """SELECT 'nation' AS store, CAST(n_nationkey AS VARCHAR) AS id, CASE WHEN n_nationkey % 2 = 0 THEN n_name || '!' ELSE n_name END AS name FROM nation WHERE n_nationkey < 20
    UNION ALL SELECT 'nation', CAST(n_nationkey + 100 AS VARCHAR), n_name FROM nation WHERE n_nationkey % 5 = 0 UNION ALL SELECT 'region', CAST(r_regionkey AS VARCHAR), r_name FROM region"""
)
def bundle_import(spark, d):
    n, r = table(spark, d, "nation").select("n_nationkey", "n_name"), table(spark, d, "region").select("r_regionkey", "r_name")
    key = F.col("n_nationkey")
    sent = n.where("n_nationkey % 2 = 0 AND n_nationkey < 20").withColumn("n_name", F.concat("n_name", F.lit("!"))).unionByName(n.where("n_nationkey % 5 = 0").withColumn("n_nationkey", (key + 100).cast("int")))
    raw = records.bundle({"nation": sent}).unionByName(spark.createDataFrame([("nation", "no json"), ("other", "{}"), ("region", "{}")], "store string, record string"))
    got = records.import_bundle(raw, {"nation": (n.where("n_nationkey < 20"), "n_nationkey"), "region": (r, "r_regionkey")})
    rows = [got[k].select(F.lit(k).alias("store"), F.col(i).cast("string").alias("id"), F.col(x).alias("name")) for k, i, x in (("nation", "n_nationkey", "n_name"), ("region", "r_regionkey", "r_name"))]
    return rows[0].unionByName(rows[1])


# --- provider errors, from what the results say ----------------------------------------------------------------------
_STATUS = "CASE length(result_id) % 7 + coalesce(input_tokens, 0) % 6 WHEN 0 THEN 401 WHEN 1 THEN 402 WHEN 2 THEN 404 WHEN 3 THEN 429 WHEN 4 THEN 429 WHEN 5 THEN 503 WHEN 6 THEN NULL ELSE 400 END"


def _says(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, '{pattern}', 'i')"


@query(
    f"""WITH e AS (SELECT DISTINCT result_id, {_STATUS} AS s, coalesce(finish_reason, '') || ' ' || coalesce(left(text, 400), '') || ' ' AS m FROM generate_result)
    SELECT result_id, CASE WHEN s IN (401, 403) THEN 'auth' WHEN s = 402 THEN 'quota_exceeded' WHEN s = 404 OR {_says("m", usage.NO_MODEL)} THEN 'invalid_model' WHEN {_says("m", usage.POLICY)} THEN 'content_policy'
    WHEN s = 429 THEN CASE WHEN {_says("m", usage.QUOTA)} AND NOT {_says("m", usage.WINDOWED)} THEN 'quota_exceeded' ELSE 'rate_limit' END WHEN s >= 500 THEN 'server_error' WHEN {_says("m", usage.AUTH)} THEN 'auth' ELSE 'rejected' END AS error_class FROM e"""
)
def classify_errors(spark, d):
    m = "concat(coalesce(finish_reason, ''), ' ', coalesce(left(text, 400), ''))"  # the message of an error is its first characters
    e = table(spark, d, "generate_result").selectExpr("result_id", f"{_STATUS} AS s", f"{m} AS m").distinct()
    return e.select("result_id", usage.classify_error(F.col("s"), F.col("m"), F.lit("")).alias("error_class"))


@query(
    """WITH v AS (SELECT DISTINCT result_id, coalesce(input_tokens, 0) AS n FROM generate_result), w AS (SELECT result_id, n, CASE n % 4 WHEN 0 THEN CAST(n % 90 AS VARCHAR) WHEN 1 THEN CAST(n % 9 AS VARCHAR) || 'm' || CAST(n % 60 AS VARCHAR) || 's' WHEN 2 THEN 'soon' END AS value FROM v)
    SELECT result_id, value, CAST(CASE n % 4 WHEN 0 THEN (n % 90) * 1000 WHEN 1 THEN (n % 9) * 60000 + (n % 60) * 1000 END AS BIGINT) AS ms FROM w"""
)
def retry_hints(spark, d):
    n = F.coalesce("input_tokens", F.lit(0))
    compact = F.concat((n % 9).cast("string"), F.lit("m"), (n % 60).cast("string"), F.lit("s"))
    value = F.when(n % 4 == 0, (n % 90).cast("string")).when(n % 4 == 1, compact).when(n % 4 == 2, "soon")
    r = table(spark, d, "generate_result").select("result_id", value.alias("value")).distinct()
    return r.select("result_id", "value", responses.retry_after_ms(F.col("value"), F.lit(1_792_567_600_000)).cast("bigint").alias("ms"))


# --- settings and glossary, from the projects -------------------------------------------------------------------------
@query(
    """WITH p AS (SELECT DISTINCT project_id, status, name FROM projects) SELECT 'my' AS target_language, CAST(count(*) % 9 AS INT) AS batch_concurrency, coalesce(bool_or(status = 'archived'), false) AS usage_tracking, 'standard' AS quality FROM p"""
)
def settings_row(spark, d):
    p = table(spark, d, "projects").select("project_id", "status", "name").distinct()
    stored = p.agg((F.count("*") % 9).cast("string").alias("batch_concurrency"), F.coalesce(F.bool_or(F.col("status") == "archived"), F.lit(False)).cast("string").alias("usage_tracking"), F.lit("7").alias("quality"))
    return records.settings(stored.unpivot([], ["batch_concurrency", "usage_tracking", "quality"], "key", "value"))


_TRIM = r"regexp_replace({0}, '^[\s\p{{Z}}\x{{FEFF}}]+|[\s\p{{Z}}\x{{FEFF}}]+$', '', 'g')"


@query(
    rf"""WITH p AS (SELECT project_id AS rule_id, coalesce(status, '') AS project, coalesce(name, '') AS term, CASE WHEN length(name) % 4 = 0 THEN '' ELSE name END AS preferred FROM projects),
    t AS (SELECT *, regexp_replace(lower({_TRIM.format('term')}), '[\s\p{{Z}}\x{{FEFF}}]+', ' ', 'g') AS k FROM p)
    SELECT rule_id, 'source_term missing' AS error FROM p WHERE {_TRIM.format('term')} = '' UNION ALL SELECT rule_id, 'preferred missing' FROM p WHERE coalesce({_TRIM.format('preferred')}, '') = ''
    UNION ALL SELECT rule_id, 'duplicate term' FROM (SELECT rule_id, row_number() OVER (PARTITION BY project, k ORDER BY rule_id) AS n FROM t WHERE k <> '') WHERE n > 1"""
)
def glossary_checks(spark, d):
    p = table(spark, d, "projects")
    rules = p.select(F.col("project_id").alias("rule_id"), F.coalesce("status", F.lit("")).alias("project_id"), F.coalesce("name", F.lit("")).alias("source_term"), F.when(F.length("name") % 4 == 0, "").otherwise(F.col("name")).alias("preferred"))
    return records.glossary_errors(rules)


# --- small reports ----------------------------------------------------------------------------------------------------
@query("SELECT provider_id AS provider, count(*) FILTER (n % 3 = 0) AS pending, count(*) FILTER (n % 3 = 1) AS failed, epoch_us(max(tm) FILTER (n % 3 = 2)) AS last_done FROM (SELECT DISTINCT result_id, provider_id, coalesce(input_tokens, 0) AS n, received_at AS tm FROM generate_result) WHERE provider_id IS NOT NULL GROUP BY 1")
def sync_status(spark, d):
    n = F.coalesce("input_tokens", F.lit(0)) % 3
    q = table(spark, d, "generate_result").where("provider_id IS NOT NULL").select("result_id", F.col("provider_id").alias("entity"), F.when(n == 0, "pending").when(n == 1, "failed").otherwise("done").alias("state"), F.col("received_at").alias("updated_at")).distinct()
    return records.sync_status(q, "entity").select(F.col("entity").alias("provider"), "pending", "failed", F.unix_micros("last_done").alias("last_done"))


@query("SELECT job, arg_max(result_id, (tm, result_id)) AS artifact FROM (SELECT call_id AS job, result_id, received_at AS tm FROM generate_result WHERE text IS NOT NULL AND received_at IS NOT NULL) GROUP BY 1")
def latest_artifacts(spark, d):
    a = table(spark, d, "generate_result").where("text IS NOT NULL AND received_at IS NOT NULL").select(F.col("call_id").alias("job_id"), F.col("result_id").alias("artifact_id"), F.col("received_at").alias("at"))
    return records.latest_artifacts(a).select(F.col("job_id").alias("job"), F.col("artifact_id").alias("artifact"))


@query("SELECT DISTINCT r.result_id FROM generate_result r LEFT JOIN (SELECT DISTINCT call_id, max_output_tokens IS NULL AS gone FROM translation_call) c ON c.call_id = r.call_id WHERE c.call_id IS NULL OR c.gone")
def pruned_artifacts(spark, d):
    jobs = table(spark, d, "translation_call").select(F.col("call_id").alias("job_id"), F.when(F.col("max_output_tokens").isNull(), "cancelled").otherwise("exporting").alias("state")).distinct()
    a = table(spark, d, "generate_result").select("result_id", F.col("call_id").alias("job_id")).distinct()
    return records.prunable(a, jobs).select("result_id")


@query("SELECT DISTINCT doc_id, regexp_matches(coalesce(regexp_extract(text, '(?i)[a-z]+:[^\\s)]+'), ''), '^(?i:https?://|mailto:)') AS actionable FROM documents WHERE text IS NOT NULL")
def actionable_links(spark, d):
    link = F.regexp_extract("text", r"(?i)[a-z]+:[^\s)]+", 0)
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", records.actionable(link).alias("actionable")).distinct()


@query(
    r"""SELECT doc_id, CAST(coalesce(list_sum(list_transform(string_split(text, chr(10)), lambda l: len(list_filter(regexp_split_to_array(l, '[ \t]+'), lambda w: w <> '')))), 0) AS BIGINT) AS words,
    CASE WHEN length(text) < 1024 THEN length(text) || ' B' ELSE round(length(text) / 1024.0::DOUBLE, 1) || ' KB' END AS shown FROM documents WHERE text IS NOT NULL"""
)
def word_counts(spark, d):
    n = F.length("text")
    words = F.aggregate(F.split("text", "\n"), F.lit(0).cast("bigint"), lambda a, line: a + T.word_count(line))
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", words.alias("words"), F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).otherwise(F.concat(F.round(n / 1024, 1).cast("string"), F.lit(" KB"))).alias("shown"))


@query("SELECT lang, n FROM (SELECT lower(split_part(lang, '-', 1)) AS lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1) ORDER BY n DESC, lang LIMIT 3")
def top_languages(spark, d):
    n = table(spark, d, "documents").where("lang IS NOT NULL").groupBy(F.lower(F.split_part("lang", F.lit("-"), F.lit(1))).alias("lang")).agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "lang").limit(3)


@query(
    """SELECT doc_id, CASE WHEN text IS NULL THEN 'undecodable' WHEN length(text) > 64 * 1024 * 1024 THEN 'too_large' ELSE 'ok' END AS state, md5(text) AS h FROM documents"""
)
def decoded_texts(spark, d):
    from folioflow.sources.formats import decode

    b = table(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return decode(b).select("doc_id", "state", F.md5("text").alias("h"))


@query(f"WITH {NEWEST}, s AS (SELECT DISTINCT project_id, lower(left(name, 3)) AS term FROM projects WHERE name <> '') SELECT u.block_id, count(*) AS terms FROM u JOIN s ON s.project_id = u.project_id WHERE contains(lower(u.source_text), s.term) GROUP BY 1")
def selected_terms(spark, d):
    s = table(spark, d, "projects").where("name <> ''").select("project_id", F.lower(F.left("name", F.lit(3))).alias("term")).distinct()
    u = _units(spark, d, "source_text").join(s, "project_id").where(F.contains(F.lower("source_text"), F.col("term")))
    return u.groupBy("block_id").agg(F.count("*").alias("terms"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_custkey = 37 AND o_orderstatus IN ('O', 'P')")
def jobs_filtered(spark, d):
    return records.jobs(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("project_id"), F.col("o_orderstatus").alias("state")), project=37, states=["O", "P"]).select("id")


@query("SELECT o_orderkey AS id FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderkey < o.o_orderkey AND p.o_orderstatus = 'O')")
def jobs_admitted(spark, d):
    j = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("subject"), F.col("o_orderstatus").alias("state"))
    return usage.admitted(j, active=["O"]).select("id")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 'queued' ELSE o_orderstatus END AS state, CAST(o_orderstatus = 'P' AS INT) AS interruptions FROM orders")
def jobs_recovered(spark, d):
    j = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state"), F.lit(0).alias("interruptions"))
    return usage.recovered(j, active=["P"])


@query("SELECT target, rank FROM (SELECT target, row_number() OVER (ORDER BY target <> 'my', target) AS rank FROM (SELECT DISTINCT target_language AS target FROM export_document WHERE target_language IS NOT NULL))")
def target_languages(spark, d):
    return records.target_languages(table(spark, d, "export_document").select(F.col("target_language").alias("target")))


_ = U
