"""Queries of parsing, planning, layout, export and state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import export, layout, planning, usage
from folioflow.operators import units as U
from folioflow.plans.catalog import NEWEST, _docs, _events, _units, query, trim_sql
from folioflow.sources import formats
from folioflow.streaming import usage as state
from folioflow.tables import ship, table


@query("SELECT doc_id, CASE WHEN regexp_matches(lower(coalesce(file_name, '')), '\\.(md|markdown)$') THEN 'markdown' WHEN regexp_matches(lower(coalesce(file_name, '')), '\\.html?$') THEN 'html' WHEN lower(coalesce(file_name, '')) LIKE '%.docx' THEN 'docx' ELSE 'text' END AS format FROM documents")
def detect_format(spark, d):
    return _docs(spark, d).select("doc_id", formats.format_of(F.col("file_name")).alias("format"))


@query("SELECT doc_id, CASE WHEN coalesce(regexp_extract(lower(file_name), '\\.([^.]+)$', 1), '') NOT IN ('pdf', 'docx', 'txt', 'md', 'markdown', 'html', 'htm', 'json', 'csv') THEN 'unsupported_type' WHEN coalesce(n_chars, 0) = 0 THEN 'empty' END AS rejected FROM documents")
def file_checks(spark, d):
    return _docs(spark, d).select("doc_id", formats.rejection(F.col("file_name"), F.col("n_chars")).alias("rejected"))


def _raw(spark, d, format_: str | None = None) -> DataFrame:
    ship(spark)
    f = F.lit(format_) if format_ else formats.format_of(F.col("file_name"))
    return _docs(spark, d).select(F.col("doc_id").cast("string").alias("document_id"), f.alias("format"), F.col("text").alias("raw"))


@query()
def parsed_blocks(spark, d):
    return formats.parse_documents(_raw(spark, d))


@query()
def markdown_blocks(spark, d):
    return formats.parse_documents(_raw(spark, d, "markdown"))


@query()
def plain_text_blocks(spark, d):
    return formats.parse_documents(_raw(spark, d, "text"))


@query()
def html_blocks(spark, d):
    return formats.parse_documents(_raw(spark, d, "html"))


@query()
def plan_batches(spark, d):
    ship(spark)
    docs = table(spark, d, "export_document").groupBy("document_id").agg(F.max("source_language").alias("source"), F.max("target_language").alias("target"))
    u = _units(spark, d, "order_index", "source_text", "flags", "unit_status").where(~U.is_furniture(F.col("flags")) & ~U.is_done())
    return planning.plan_batches(u.join(docs, "document_id", "left").withColumn("document", F.lit("pdf")), 16_384, 4_096)


def _runs(spark, d):
    g = table(spark, d, "grouped_line").select("line_id", "document_id", "page_index", "text", "bbox.x", "bbox.y", "bbox.width", "bbox.height", "font_size", "font_key").distinct()
    return g.drop("line_id")


@query()
def analyze_page(spark, d):
    ship(spark)
    return layout.analyze_pages(_runs(spark, d))


@query()
def page_states(spark, d):
    ship(spark)
    return layout.page_states(_runs(spark, d))


def _export_blocks(spark, d) -> DataFrame:
    b = _units(spark, d, "page_index", "order_index", "kind", "source_text", "translated_text", "heading_level", "list_ordered", "table_ir", "link", "alignment", "flags", "bbox", "font").where(~U.is_furniture(F.col("flags")))
    rows = F.coalesce(F.col("table_ir.cells"), F.array().cast("array<array<string>>"))
    cell = lambda c: T.escape_cell(F.coalesce(c, F.lit("")))
    md = F.array_join(F.transform(rows, lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.coalesce(r, F.array().cast("array<string>")), cell), " | "), F.lit(" |"))), "\n")
    return b.select(
        "document_id", "page_index", "order_index", "kind", "link", "alignment", "flags", "bbox", "font", F.col("table_ir.cells").alias("cells"), "translated_text", export.shown(F.col("translated_text"), F.col("source_text")).alias("text"),
        F.when(F.col("kind") == "heading", F.least(F.lit(6), F.greatest(F.lit(1), F.coalesce("heading_level", F.lit(1))))).alias("heading"), (F.coalesce(F.col("kind") == "table", F.lit(False))).alias("is_table"), md.alias("md_table"),
        F.when(F.col("kind") == "list", F.coalesce("list_ordered", F.lit(False))).alias("list_ordered"),
    )


def _rendered(spark, d, kind: str) -> DataFrame:
    r = export.render(_export_blocks(spark, d), table(spark, d, "export_document"), kind)
    return r.select("document_id", F.length("body").cast("bigint").alias("chars"), F.md5("body").alias("h"))


_BLOCKS = f"""{NEWEST}, b AS (SELECT document_id, page_index, order_index, link, coalesce(CASE WHEN {trim_sql('translated_text')} <> '' THEN translated_text END, source_text) AS t,
    CASE WHEN kind = 'heading' THEN least(6, greatest(1, coalesce(heading_level, 1))) END AS h, coalesce(kind = 'table', false) AS tab, CASE WHEN kind = 'list' THEN coalesce(list_ordered, false) END AS lo FROM u WHERE NOT coalesce(list_has_any(flags, ['page_number', 'header_footer']), false)),
    i AS (SELECT *, CAST(coalesce(lo, false) AND h IS NULL AS INT) AS item FROM b), r AS (SELECT *, sum(1 - item) OVER (PARTITION BY document_id ORDER BY order_index ROWS UNBOUNDED PRECEDING) AS run FROM i),
    n AS (SELECT *, sum(item) OVER (PARTITION BY document_id, run ORDER BY order_index ROWS UNBOUNDED PRECEDING) AS k FROM r)"""


@query(
    f"""WITH {_BLOCKS}, l AS (SELECT document_id, page_index, order_index, CASE WHEN h IS NOT NULL THEN t || chr(10) || repeat(CASE WHEN h <= 2 THEN '=' ELSE '-' END, CAST(least(60, greatest(3, length(t))) AS INT)) || chr(10) || chr(10)
      WHEN tab THEN t || chr(10) || chr(10) WHEN lo THEN k || '. ' || t || chr(10) WHEN NOT lo THEN '• ' || t || chr(10) ELSE CASE WHEN link IS NOT NULL AND NOT contains(t, link) THEN t || ' <' || link || '>' ELSE t END || chr(10) || chr(10) END AS line FROM n),
    p AS (SELECT document_id, page_index, string_agg(line, '' ORDER BY order_index) AS page FROM l GROUP BY ALL), x AS (SELECT document_id, string_agg(page, chr(12) || chr(10) ORDER BY page_index) AS body FROM p GROUP BY 1),
    dd AS (SELECT document_id, max(title) AS title, max(target_language) AS tl FROM export_document GROUP BY 1),
    f AS (SELECT dd.document_id, regexp_replace(coalesce(title, '') || chr(10) || coalesce(tl, '') || chr(10) || chr(10) || coalesce(body, ''), '\\n{{3,}}', chr(10) || chr(10), 'g') AS body FROM dd LEFT JOIN x ON x.document_id = dd.document_id)
    SELECT document_id, CAST(length(body) AS BIGINT) AS chars, md5(body) AS h FROM f"""
)
def render_text(spark, d):
    return _rendered(spark, d, "text")


@query()
def render_markdown(spark, d):
    return _rendered(spark, d, "markdown")


@query()
def render_html(spark, d):
    return _rendered(spark, d, "html")


@query()
def render_docx(spark, d):
    ship(spark)
    return export.render_docx(_export_blocks(spark, d)).select("document_id", F.length("content").alias("bytes"))


@query(
    f"""WITH {_BLOCKS} SELECT b.document_id, b.page_index, b.order_index, b.h AS heading, b.lo AS list_ordered, md5(b.t) AS text_hash, u.kind, u.alignment, u.link, array_to_string(u.flags, ',') AS flags, u.bbox.x AS x, u.bbox.height AS height,
    u.font.family AS family, u.font.bold AS bold, CAST(len(u.table_ir.cells) AS BIGINT) AS n_rows, array_to_string(u.table_ir.cells[1], '|') AS head FROM b JOIN u ON u.document_id = b.document_id AND u.order_index = b.order_index"""
)
def json_round_trip(spark, d):
    back = export.restore(export.serialize(_export_blocks(spark, d), table(spark, d, "export_document")))
    return back.select(
        "document_id", "page_index", "order_index", "heading", "list_ordered", F.md5("text").alias("text_hash"), "kind", "alignment", "link", F.array_join("flags", ",").alias("flags"), "bbox.x", "bbox.height", "font.family", "font.bold",
        F.when(F.col("cells").isNotNull(), F.size("cells")).cast("bigint").alias("n_rows"), F.array_join(F.get("cells", F.lit(0)), "|").alias("head"),
    )


@query("SELECT document_id AS name, 'json' AS kind, true AS valid FROM (SELECT DISTINCT document_id FROM export_document) UNION ALL SELECT document_id, 'html', true FROM (SELECT DISTINCT document_id FROM export_document) UNION ALL SELECT document_id || '-cut', 'json', false FROM (SELECT DISTINCT document_id FROM export_document)")
def rendered_probes(spark, d):
    docs = table(spark, d, "export_document")
    j = export.serialize(_export_blocks(spark, d), docs).select(F.col("document_id").alias("name"), F.lit("json").alias("kind"), F.col("json").alias("body"))
    h = export.render(_export_blocks(spark, d), docs, "html").select(F.col("document_id").alias("name"), F.lit("html").alias("kind"), "body")
    cut = j.select(F.concat("name", F.lit("-cut")).alias("name"), "kind", F.left("body", F.length("body") - 1).alias("body"))
    return export.probe(j.unionByName(h).unionByName(cut))


@query(
    f"""WITH {_BLOCKS}, dd AS (SELECT document_id, max(title) AS title FROM export_document GROUP BY 1), raw AS (SELECT document_id, {trim_sql('translated_text')} AS tr FROM u WHERE NOT coalesce(list_has_any(flags, ['page_number', 'header_footer']), false)),
    p AS (SELECT document_id, count(*) FILTER (coalesce({trim_sql('t')}, '') = '') AS missing FROM b GROUP BY 1), x AS (SELECT document_id, count(*) FILTER (coalesce(tr, '') = '') AS untranslated FROM raw GROUP BY 1)
    SELECT dd.document_id, 'no_pages' AS code, 'error' AS severity, 1::BIGINT AS n FROM dd ANTI JOIN p ON p.document_id = dd.document_id
    UNION ALL SELECT document_id, 'title_missing', 'warning', 1 FROM dd WHERE coalesce({trim_sql('title')}, '') = ''
    UNION ALL SELECT dd.document_id, 'missing_text', 'error', missing FROM dd JOIN p ON p.document_id = dd.document_id WHERE missing > 0
    UNION ALL SELECT dd.document_id, 'untranslated', 'warning', untranslated FROM dd JOIN x ON x.document_id = dd.document_id WHERE untranslated > 0"""
)
def export_findings(spark, d):
    return export.findings(table(spark, d, "export_document"), _export_blocks(spark, d))


_OUTCOME = """CASE WHEN coalesce(lower(finish_reason), 'stop') IN ('stop', 'end_turn') THEN 'ok' WHEN lower(finish_reason) IN ('length', 'max_tokens') THEN 'rate_limit' WHEN lower(finish_reason) IN ('safety', 'content_filter', 'refusal') THEN 'auth'
    WHEN coalesce(output_tokens, 0) % 3 = 0 THEN 'quota_exceeded' WHEN coalesce(output_tokens, 0) % 3 = 1 THEN 'server_error' ELSE 'timeout' END"""
_FOLD = f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY key_id ORDER BY tm, id) AS n FROM (SELECT DISTINCT result_id AS id, key_id, epoch_us(received_at) // 1000 AS tm, {_OUTCOME} AS oc,
      CASE WHEN input_tokens % 5 = 0 THEN input_tokens * 1000 END AS retry FROM generate_result WHERE key_id IS NOT NULL AND received_at IS NOT NULL)),
    k AS (SELECT key_id, coalesce(max(n) FILTER (oc = 'ok'), 0) AS ok, max(n) FILTER (oc <> 'timeout') AS l, count(*) AS requests, count(*) FILTER (oc <> 'ok') AS failed, count(*) FILTER (oc IN ('rate_limit', 'quota_exceeded')) AS hits FROM e GROUP BY 1),
    f AS (SELECT e.key_id, e.n, e.oc, e.tm, e.retry, count(p.n) FILTER (p.n > k.ok AND p.tm >= e.tm - 600000) AS row_, count(p.n) FILTER (p.oc = 'quota_exceeded' AND p.tm >= e.tm - 60000) AS q, count(p.n) FILTER (p.oc IN ('rate_limit', 'quota_exceeded')) AS h
      FROM e JOIN k ON k.key_id = e.key_id AND (e.n = k.l OR e.n > k.ok AND e.oc = 'server_error') JOIN e p ON p.key_id = e.key_id AND p.n <= e.n GROUP BY ALL),
    x AS (SELECT k.key_id, max(e.n) FILTER (e.oc = 'auth' AND e.n > k.ok) AS auth FROM k JOIN e ON e.key_id = k.key_id GROUP BY 1),
    s AS (SELECT key_id, max(n) FILTER (oc = 'server_error' AND row_ >= 3) AS deg FROM f GROUP BY 1)
    SELECT k.key_id, CASE WHEN x.auth IS NOT NULL AND x.auth > coalesce(s.deg, 0) THEN 'invalid' WHEN s.deg IS NOT NULL THEN 'degraded' ELSE 'healthy' END AS health,
    CAST(coalesce(CASE f.oc WHEN 'rate_limit' THEN f.tm + greatest(coalesce(f.retry, 0), floor(0.75::DOUBLE * least(300000, 5000 * pow(2, least(f.h, 6))) + 0.5::DOUBLE))
      WHEN 'quota_exceeded' THEN f.tm + least(greatest(900000 * pow(2, least(greatest(f.q - 1, 0), 4)), coalesce(f.retry, 0)), 21600000)
      WHEN 'server_error' THEN f.tm + floor(0.75::DOUBLE * least(300000, 10000 * pow(2, least(f.row_, 6))) + 0.5::DOUBLE) END, 0) AS BIGINT) AS cooldown_until,
    CASE WHEN f.oc = 'quota_exceeded' THEN 'quota' WHEN f.oc <> 'ok' THEN f.oc END AS reason, CAST(k.hits AS INT) AS hits, CAST(k.requests AS INT) AS requests, CAST(k.failed AS INT) AS failed
    FROM k JOIN x ON x.key_id = k.key_id LEFT JOIN f ON f.key_id = k.key_id AND f.n = k.l LEFT JOIN s ON s.key_id = k.key_id"""


def _outcomes(spark, d):
    e = table(spark, d, "generate_result").selectExpr("result_id AS id", "key_id", "unix_millis(received_at) AS at_ms", f"{_OUTCOME} AS outcome", "CASE WHEN input_tokens % 5 = 0 THEN input_tokens * 1000 END AS retry_after_ms", "provider_id AS provider")
    return e.where("key_id IS NOT NULL AND at_ms IS NOT NULL").distinct()


@query(_FOLD)
def key_runtime_fold(spark, d):
    return state.key_health_batch(_outcomes(spark, d))


_POOL = f"""SELECT *, provider, key_id NOT LIKE '%3' AS enabled, CASE WHEN key_id LIKE '%5' THEN 'revoked' ELSE 'valid' END AS verification, t.now AS now_ms FROM ({_FOLD}) r JOIN (SELECT DISTINCT key_id AS kk, 'pool_' || right(key_id, 1) AS provider FROM generate_result) p ON p.kk = r.key_id,
    (SELECT epoch_us(max(received_at)) // 1000 - 86400000 AS now FROM generate_result) t"""


def _pool(spark, d):
    r = state.key_health_batch(_outcomes(spark, d)).withColumnRenamed("reason", "cooldown_reason")
    g = table(spark, d, "generate_result")
    now = F.broadcast(g.agg((F.unix_millis(F.max("received_at")) - 86_400_000).alias("now_ms")))  # one row
    k = r.withColumn("provider", F.concat(F.lit("pool_"), F.right("key_id", F.lit(1)))).join(now, how="cross")
    return k.withColumn("enabled", ~F.col("key_id").endswith("3")).withColumn("verification", F.when(F.col("key_id").endswith("5"), "revoked").otherwise("valid"))


@query(
    f"""WITH z AS ({_POOL}), g AS (SELECT provider, count(*) AS total, count(*) FILTER (enabled) AS enabled, count(*) FILTER (enabled AND cooldown_until <= now_ms AND health <> 'invalid') AS eligible, count(*) FILTER (cooldown_until > now_ms) AS cooling,
      count(*) FILTER (health = 'invalid' OR verification = 'revoked') AS invalid, min(cooldown_until) FILTER (cooldown_until > now_ms) AS next_available_at, count(*) FILTER (cooldown_until > now_ms AND reason = 'quota') AS nq FROM z GROUP BY 1)
    SELECT * EXCLUDE nq, CASE WHEN enabled = 0 THEN 'no_keys' WHEN eligible = 0 AND cooling > 0 THEN CASE WHEN nq = cooling THEN 'quota' ELSE 'rate_limited' END WHEN eligible = 0 AND invalid = total THEN 'invalid' ELSE 'none' END AS exhaustion FROM g"""
)
def rate_limit_state(spark, d):
    return usage.rate_limit_state(_pool(spark, d))


@query(
    f"""WITH z AS (SELECT *, CASE WHEN NOT enabled THEN 'disabled' WHEN verification = 'revoked' OR health = 'invalid' THEN 'verification_failed' WHEN cooldown_until > now_ms THEN 'cooling' END AS rj FROM ({_POOL})), r AS (SELECT * FROM z WHERE rj IS NOT NULL)
    SELECT p.provider, CASE WHEN count(r.key_id) = 0 THEN 'none' WHEN count(*) FILTER (rj <> 'disabled') = 0 THEN 'no_keys' WHEN count(*) FILTER (rj <> 'verification_failed') = 0 THEN 'invalid'
      WHEN count(*) FILTER (rj <> 'cooling') = 0 THEN CASE WHEN count(*) FILTER (r.reason = 'quota') = count(*) THEN 'quota' ELSE 'rate_limited' END ELSE 'none' END AS exhaustion
    FROM (SELECT DISTINCT provider FROM z) p LEFT JOIN r ON r.provider = p.provider GROUP BY 1"""
)
def pool_exhaustion(spark, d):
    k = _pool(spark, d)
    for name in ("rpm_limit", "tpm_limit"):
        k = k.withColumn(name, F.lit(None).cast("int"))
    k = k.withColumn("supports_model", F.lit(True)).withColumn("requests_in_window", F.lit(0)).withColumn("tokens_in_window", F.lit(0)).withColumn("estimated_tokens", F.lit(0))
    return usage.exhaustion(k.withColumn("rejection", usage.rejection(F.col("now_ms"))))
