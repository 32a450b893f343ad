"""All queries over the reference's operators, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import quality, usage
from folioflow.operators import units as U
from folioflow.tables import ship, table

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

#: SQL of the unit store: the newest row of each block.
NEWEST = "u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY updated_at DESC NULLS LAST, ingested_at DESC NULLS LAST) AS rn FROM export_block) WHERE rn = 1)"
SP = r"[\s\p{Z}\x{FEFF}]"


def norm_sql(c: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(lower({c}), '[\p{{P}}\p{{S}}]+', ' ', 'g'), '{SP}+', ' ', 'g'), '^{SP}+|{SP}+$', '', 'g')"


def trim_sql(c: str) -> str:
    return rf"regexp_replace({c}, '^{SP}+|{SP}+$', '', 'g')"


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def put(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return put


def _units(spark, d, *cols) -> DataFrame:
    return U.units(table(spark, d, "export_block"), *cols)


def _docs(spark, d) -> DataFrame:
    return table(spark, d, "documents")


# --- text functions -------------------------------------------------------------------------------------------------
@query(f"SELECT doc_id, md5({norm_sql('text')}) AS h, CAST(length({norm_sql('text')}) AS BIGINT) AS n FROM documents WHERE text IS NOT NULL")
def norm_text(spark, d):
    t = T.normalize_for_match(F.col("text"))
    return _docs(spark, d).where("text IS NOT NULL").select("doc_id", F.md5(t).alias("h"), F.length(t).cast("bigint").alias("n"))


_W = "[\\x{0900}-\\x{097F}\\x{0E00}-\\x{0E7F}\\x{1000}-\\x{109F}\\x{3000}-\\x{9FFF}\\x{A9E0}-\\x{A9FF}\\x{AA60}-\\x{AA7F}\\x{AC00}-\\x{D7AF}\\x{F900}-\\x{FAFF}]"


def _count_sql(c: str, cls: str) -> str:
    return f"(length({c}) - length(regexp_replace({c}, '{cls}', '', 'g')))"


@query(
    f"SELECT doc_id, CAST(ceil({_count_sql('text', chr(91) + chr(92) + 'x{00}-' + chr(92) + 'x{7F}]')} * 0.25::DOUBLE + {_count_sql('text', _W)} * 1.5::DOUBLE"
    f" + (length(text) - {_count_sql('text', chr(91) + chr(92) + 'x{00}-' + chr(92) + 'x{7F}]')} - {_count_sql('text', _W)})) AS BIGINT) AS tokens FROM documents WHERE text IS NOT NULL"
)
def token_estimate(spark, d):
    return _docs(spark, d).where("text IS NOT NULL").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


def _script_sql() -> str:
    cols, taken = [], "documents_text"
    c = "text"
    for name, cls in T.SCRIPTS.items():
        cols.append(f"CAST(length({c}) - length(regexp_replace({c}, '[{cls}]', '', 'g')) AS BIGINT) AS {name}")
        c = f"regexp_replace({c}, '[{cls}]', '', 'g')"
    return f"SELECT doc_id, {', '.join(cols)} FROM documents WHERE text IS NOT NULL"


@query(_script_sql())
def script_histogram(spark, d):
    return _docs(spark, d).where("text IS NOT NULL").select("doc_id", *[v.cast("bigint").alias(k) for k, v in T.script_counts(F.col("text")).items()])


def _stop_sql() -> str:
    w = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
    cols = [f"CAST(len(list_filter(w, lambda x: x IN ({', '.join(repr(s) for s in v)}))) AS BIGINT) AS {k}" for k, v in T.STOPWORDS.items()]
    return f"SELECT doc_id, {', '.join(cols)}, CAST(len(w) AS BIGINT) AS checked FROM (SELECT doc_id, list_slice({w}, 1, 400) AS w FROM documents WHERE text IS NOT NULL)"


@query(_stop_sql())
def stopword_tokens(spark, d):
    w = F.slice(T.words(F.col("text")), 1, 400)
    x = _docs(spark, d).where("text IS NOT NULL").select("doc_id", w.alias("w"))
    return x.select("doc_id", *[F.size(F.filter("w", lambda y: y.isin(*v))).cast("bigint").alias(k) for k, v in T.STOPWORDS.items()], F.size("w").cast("bigint").alias("checked"))


@query()
def detect_language(spark, d):
    from folioflow.functions.language import detect

    ship(spark)

    return detect(_docs(spark, d), "doc_id")


_NUM = r"regexp_extract_all(text, '\b\d+(?:[.,]\d+)?\b')"


@query(rf"SELECT doc_id, CAST(len({_NUM}) AS BIGINT) AS n, array_to_string({_NUM}, ';') AS numbers FROM documents WHERE regexp_matches(text, '\d')")
def number_tokens(spark, d):
    x = T.extract(F.col("text"), T.NUMBER)  # boundaries are those of ASCII in all scripts
    return _docs(spark, d).where(F.col("text").rlike(r"\d")).select("doc_id", F.size(x).cast("bigint").alias("n"), F.array_join(x, ";").alias("numbers"))


@query(
    rf"""SELECT doc_id, CAST(len(list_filter(l, lambda x: regexp_matches({trim_sql('x')}, '^#{{1,6}}\s'))) AS BIGINT) AS headings,
     CAST(len(list_filter(l, lambda x: regexp_matches(x, '^\s*(?:[-*+]|\d+\.)\s'))) AS BIGINT) AS lists,
     CAST(len(list_filter(l, lambda x: regexp_matches(x, '^\s*\|.*\|\s*$'))) AS BIGINT) AS tables,
     CAST(len(list_filter(l, lambda x: regexp_matches(x, '^\s*>\s?'))) AS BIGINT) AS quotes,
     CAST(len(regexp_extract_all(text, '\[[^\]]*\]\([^)]*\)')) AS BIGINT) AS links
     FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)"""
)
def structure_counts(spark, d):
    return _docs(spark, d).where("text IS NOT NULL").select("doc_id", *[v.cast("bigint").alias(k) for k, v in T.structure(F.col("text")).items()])


@query(
    rf"""SELECT DISTINCT line_id, CASE WHEN regexp_matches(t, '^[•●▪◦‣·⁃*+\-–—]\s+') THEN false
     WHEN regexp_matches(t, '^\(?(?:\d{{1,3}}|[a-zA-Z]|[ivxIVX]{{1,5}})[.)]\s+|^\(?[၀-၉]{{1,4}}\)?[.)။]\s+') THEN true END AS ordered
     FROM (SELECT line_id, {trim_sql('text')} AS t FROM grouped_line)"""
)
def list_markers(spark, d):
    return table(spark, d, "grouped_line").select("line_id", T.list_marker(F.col("text"))["ordered"].alias("ordered")).distinct()


@query("SELECT doc_id, sha256(text) AS checksum FROM documents WHERE text IS NOT NULL")
def text_checksum(spark, d):
    return _docs(spark, d).where("text IS NOT NULL").select("doc_id", T.hash_text(F.col("text")).alias("checksum"))


@query(
    r"""SELECT doc_id, md5(regexp_replace(regexp_replace(coalesce(text, '') || ' api_key=' || sha256(CAST(doc_id AS VARCHAR)) || ' sk-' || md5(CAST(doc_id AS VARCHAR)) || ' ' || source,
    '\bsk-[0-9A-Za-z_-]{16,}\b', '[redacted]', 'g'), '(?i)\b(?:x-goog-api-key|api[-_]?key|apikey|authorization|access[-_]?token|secret)\s*[=:]\s*["'']?[^\s"'',&]{8,}', '[redacted]', 'g')) AS h FROM documents"""
)
def redact_secrets(spark, d):
    i = F.col("doc_id").cast("string")  # every text, with two secrets at its end
    return _docs(spark, d).select("doc_id", F.md5(T.redact(F.concat(F.coalesce("text", F.lit("")), F.lit(" api_key="), F.sha2(i, 256), F.lit(" sk-"), F.md5(i), F.lit(" "), F.col("source")))).alias("h"))


@query("SELECT DISTINCT key_id, CASE WHEN key_id = '' THEN '' ELSE substr(key_id, 1, CAST(least(4, greatest(1, floor(length(key_id) / 4))) AS INT)) || repeat('•', 8) || CASE WHEN length(key_id) > 8 THEN right(key_id, 4) ELSE '' END END AS masked FROM generate_result WHERE key_id IS NOT NULL")
def mask_keys(spark, d):
    return table(spark, d, "generate_result").where("key_id IS NOT NULL").select("key_id", T.mask(F.col("key_id")).alias("masked")).distinct()


@query("SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS h FROM documents WHERE text IS NOT NULL")
def html_escaped(spark, d):
    return _docs(spark, d).where("text IS NOT NULL").select("doc_id", F.md5(T.escape_html(F.col("text"))).alias("h"))


@query(
    """SELECT o_orderkey, CAST(greatest(1, floor(c / 2 + u * c / 2 + 0.5::DOUBLE)) AS BIGINT) AS delay_ms FROM (
    SELECT o_orderkey, least(60000.0::DOUBLE, 1500.0::DOUBLE * pow(2.0::DOUBLE, o_orderkey % 8)) AS c, (o_orderkey % 97) / 97.0::DOUBLE AS u FROM orders)"""
)
def backoff_delays(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", T.backoff_ms(k % 8, (k % 97) / F.lit(97.0)).alias("delay_ms"))


# --- units ----------------------------------------------------------------------------------------------------------
@query(f"WITH {NEWEST} SELECT document_id, page_index, count(*) AS total, count(*) FILTER (unit_status IN ('translated', 'reviewed')) AS done, count(*) FILTER (unit_status = 'failed') AS failed FROM u GROUP BY ALL")
def page_progress(spark, d):
    return U.page_progress(_units(spark, d, "page_index", "unit_status"))


@query(
    f"""WITH {NEWEST}, p AS (SELECT document_id, page_index, count(*) AS total, count(*) FILTER (unit_status IN ('translated', 'reviewed')) AS done FROM u GROUP BY ALL)
    SELECT document_id, count(*) AS pages, count(*) FILTER (done >= total) AS completed_pages, CAST(sum(total) AS BIGINT) AS total, CAST(sum(done) AS BIGINT) AS done,
    CAST(floor(100.0::DOUBLE * sum(done) / sum(total) + 0.5::DOUBLE) AS INT) AS percent FROM p GROUP BY document_id"""
)
def document_progress(spark, d):
    return U.document_progress(_units(spark, d, "page_index", "unit_status"))


@query(f"WITH {NEWEST} SELECT project_id, coalesce(unit_status, 'none') AS status, count(*) AS n FROM u GROUP BY ALL")
def project_status(spark, d):
    return _units(spark, d, "unit_status").groupBy("project_id", F.coalesce("unit_status", F.lit("none")).alias("status")).agg(F.count("*").alias("n"))


@query(f"WITH {NEWEST} SELECT block_id FROM u WHERE list_has_any(flags, ['page_number', 'header_footer'])")
def furniture_blocks(spark, d):
    return _units(spark, d, "flags").where(U.is_furniture(F.col("flags"))).select("block_id")


@query(f"WITH {NEWEST} SELECT block_id, chars_before FROM (SELECT block_id, CAST(coalesce(sum(length(source_text)) OVER (PARTITION BY document_id ORDER BY order_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS chars_before FROM u) WHERE chars_before < 50000")
def sample_prefix(spark, d):
    return U.sample_prefix(_units(spark, d, "order_index", "source_text")).select("block_id", "chars_before")


@query(
    """WITH w AS (SELECT document_id, unnest(range(n)) AS p FROM (SELECT document_id, max(page_count) AS n FROM export_document GROUP BY 1) WHERE n > 0)
    SELECT DISTINCT w.document_id, CAST(w.p AS INT) AS page_index FROM w LEFT JOIN (SELECT DISTINCT document_id, page_index FROM export_block WHERE page_index % 3 <> 1) b ON b.document_id = w.document_id AND b.page_index = w.p WHERE b.document_id IS NULL"""
)
def missing_pages(spark, d):
    return U.missing_pages(table(spark, d, "export_document"), table(spark, d, "export_block").where("page_index % 3 <> 1"))  # as if those hadn't come


_MERGE = f"""WITH {NEWEST}, f AS (SELECT block_id, sha256(source_text) AS checksum FROM u WHERE order_index % 11 <> 3),
    p AS (SELECT block_id, sha256(CASE WHEN order_index % 7 = 0 THEN source_text || '!' ELSE source_text END) AS old, translated_text, unit_status FROM u WHERE order_index % 5 <> 4)
    SELECT coalesce(f.block_id, p.block_id) AS block_id, CASE WHEN f.block_id IS NULL THEN 'delete' WHEN p.block_id IS NULL THEN 'insert' WHEN f.checksum = p.old THEN 'keep' ELSE 'reset' END AS action,
    CASE WHEN f.checksum = p.old THEN p.translated_text END AS translated_text, CASE WHEN f.checksum = p.old THEN p.unit_status WHEN f.block_id IS NOT NULL THEN 'pending' END AS unit_status
    FROM f FULL JOIN p ON p.block_id = f.block_id"""


@query(_MERGE)
def incremental_merge(spark, d):
    u = _units(spark, d, "order_index", "source_text", "translated_text", "unit_status")
    old = u.where("order_index % 5 <> 4").select("block_id", T.hash_text(F.when(F.col("order_index") % 7 == 0, F.concat("source_text", F.lit("!"))).otherwise(F.col("source_text"))).alias("checksum"), "translated_text", "unit_status")
    new = u.where("order_index % 11 <> 3").select("block_id", T.hash_text(F.col("source_text")).alias("checksum"))
    return U.merge(old, new)


#: Width of the test pages, in points, and the two regions that they are read in.
PAGE_WIDTH = 595.0


@query(
    f"""WITH {NEWEST}, g AS (SELECT block_id, document_id, page_index, bbox.x AS x, bbox.y AS y, bbox.width AS w, CAST(bbox.x + bbox.width / 2 > {PAGE_WIDTH / 2}::DOUBLE AS INT) AS region FROM u WHERE bbox IS NOT NULL),
    h AS (SELECT document_id, page_index, y, x, block_id, row_number() OVER (PARTITION BY document_id, page_index ORDER BY y, x, block_id) AS nth FROM g WHERE w >= 0.6::DOUBLE * {PAGE_WIDTH}::DOUBLE),
    c AS (SELECT g.block_id, g.document_id, g.page_index, max(coalesce(h.nth, 0)) AS band, max(CAST(h.block_id = g.block_id AS INT)) AS head, any_value(g.region) AS region, any_value(g.y) AS y, any_value(g.x) AS x
      FROM g LEFT JOIN h ON h.document_id = g.document_id AND h.page_index = g.page_index AND (h.y, h.x, h.block_id) <= (g.y, g.x, g.block_id) GROUP BY 1, 2, 3)
    SELECT a.block_id, CAST(count(b.block_id) AS INT) AS reading_order FROM c a LEFT JOIN c b ON b.document_id = a.document_id AND b.page_index = a.page_index
      AND (b.band, -coalesce(b.head, 0), b.region, b.y, b.x, b.block_id) < (a.band, -coalesce(a.head, 0), a.region, a.y, a.x, a.block_id) GROUP BY 1"""
)
def reading_order(spark, d):
    u = _units(spark, d, "page_index", "bbox").where("bbox IS NOT NULL").select("block_id", "document_id", "page_index", "bbox.x", "bbox.y", "bbox.width", F.lit(PAGE_WIDTH).alias("page_width"))
    return U.reading_order(u.withColumn("region", (F.col("x") + F.col("width") / 2 > PAGE_WIDTH / 2).cast("int")))


_LINE1 = "l AS (SELECT DISTINCT line_id, document_id, page_index, baseline, font_size, list_marker, text FROM grouped_line)"


@query(
    f"""WITH {_LINE1}, p AS (SELECT line_id, document_id, page_index, baseline, font_size AS s, lag(font_size) OVER w AS ps, baseline - lag(baseline) OVER w AS gap, list_marker IS NOT NULL AS li, lag(list_marker IS NOT NULL) OVER w AS pli FROM l
      WINDOW w AS (PARTITION BY document_id, page_index ORDER BY baseline, line_id))
    SELECT line_id, CAST(sum(CASE WHEN coalesce(li = pli AND abs(s - ps) <= 0.12::DOUBLE * greatest(s, ps) AND gap <= (CASE WHEN li THEN 1.8::DOUBLE ELSE 1.95::DOUBLE END) * greatest(s, ps), false) THEN 0 ELSE 1 END)
      OVER (PARTITION BY document_id, page_index ORDER BY baseline, line_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM p"""
)
def paragraph_islands(spark, d):
    lines = table(spark, d, "grouped_line").select("line_id", "document_id", "page_index", "baseline", "font_size", "list_marker").distinct()
    return U.paragraph_islands(lines)


@query(
    f"""WITH {_LINE1}, s AS (SELECT document_id, floor(font_size * 2 + 0.5::DOUBLE) / 2 AS size, sum(length(text)) AS n FROM l GROUP BY ALL)
    SELECT document_id, arg_max(size, n * 1000 - size) AS body_size, count(*) FILTER (n >= 8) AS n_sizes, max(size) AS largest FROM s GROUP BY 1"""
)
def font_stats(spark, d):
    return U.font_mode(table(spark, d, "grouped_line").select("line_id", "document_id", "font_size", "text").distinct())


# --- quality --------------------------------------------------------------------------------------------------------
@query(
    f"""WITH {NEWEST}, k AS (SELECT block_id, project_id, document_id, {norm_sql('translated_text')} AS t, {norm_sql('source_text')} AS s FROM u WHERE unit_status IN ('translated', 'reviewed') AND {trim_sql('translated_text')} <> ''),
    m AS (SELECT document_id, t FROM k GROUP BY ALL HAVING count(DISTINCT s) >= 2) SELECT k.project_id, count(*) AS flagged, count(DISTINCT k.document_id) AS documents FROM k JOIN m ON m.document_id = k.document_id AND m.t = k.t GROUP BY 1"""
)
def duplicate_translation(spark, d):
    u = _units(spark, d, "source_text", "translated_text", "unit_status")
    return quality.duplicate_units(u).groupBy("project_id").agg(F.count("*").alias("flagged"), F.countDistinct("document_id").alias("documents"))


def _with_differ(spark, d) -> DataFrame:
    u = _units(spark, d, "source_text", "translated_text", "unit_status")
    langs = table(spark, d, "export_document").groupBy("document_id").agg(F.max("source_language").alias("a"), F.max("target_language").alias("b"))
    return u.join(langs, "document_id", "left").withColumn("differ", F.coalesce(F.col("a") != F.col("b"), F.lit(True)))


@query()
def unit_warnings(spark, d):
    return quality.warnings(_with_differ(spark, d))


@query(
    f"""WITH {NEWEST}, k AS (SELECT source_text AS s, translated_text AS t FROM u WHERE unit_status IN ('translated', 'reviewed')),
    c AS (SELECT CASE WHEN t IS NULL THEN 'missing_text' WHEN {trim_sql('s')} <> '' AND {trim_sql('t')} = '' THEN 'unexpected_empty' END AS code FROM k)
    SELECT code, count(*) AS n FROM c WHERE code IS NOT NULL GROUP BY code"""
)
def empty_warning_counts(spark, d):
    return quality.warnings(_with_differ(spark, d)).where("code IN ('missing_text', 'unexpected_empty')").groupBy("code").agg(F.count("*").alias("n"))


@query()
def warning_counts(spark, d):
    return quality.warnings(_with_differ(spark, d)).groupBy("code").agg(F.count("*").alias("n"), F.countDistinct("block_id").alias("units"))


def _rules(spark) -> DataFrame:
    rows = [("export worker", "Exportdienst", "Ausfuhrdienst"), ("page planner", "Seitenplaner", None), ("key pool", "Schlüsselvorrat", None), ("style guide", "guide de style", "Stilleitfaden")]
    return spark.createDataFrame(rows, "source_term string, preferred string, forbidden string")


@query(
    f"""WITH {NEWEST}, r(st, p, f) AS (VALUES ('export worker', 'Exportdienst', 'Ausfuhrdienst'), ('page planner', 'Seitenplaner', NULL), ('key pool', 'Schlüsselvorrat', NULL), ('style guide', 'guide de style', 'Stilleitfaden')),
    k AS (SELECT block_id, {norm_sql('source_text')} AS s, {norm_sql('translated_text')} AS t FROM u WHERE unit_status IN ('translated', 'reviewed') AND translated_text IS NOT NULL)
    SELECT block_id, st AS term, CASE WHEN f IS NOT NULL AND contains(t, lower(f)) THEN 'forbidden: ' || f ELSE 'missing: ' || p END AS detail FROM k, r
    WHERE (f IS NOT NULL AND contains(t, lower(f))) OR (contains(s, st) AND NOT contains(t, lower(p)) AND NOT contains(t, st))"""
)
def glossary_violations(spark, d):
    u = _units(spark, d, "source_text", "translated_text", "unit_status")
    projects = table(spark, d, "projects").select("project_id").distinct()
    return quality.glossary_findings(u, projects.join(F.broadcast(_rules(spark)), how="cross"))  # four rules


@query()
def memory_autofill(spark, d):
    u = _units(spark, d, "source_text", "translated_text", "unit_status")
    t = table(spark, d, "export_document").groupBy("document_id").agg(F.max("target_language").alias("target"))
    m = u.where(U.is_done() & (T.trim(F.col("translated_text")) != "")).join(t, "document_id")
    m = m.groupBy("project_id", "target", F.col("source_text").alias("text")).agg(F.min("block_id").alias("id"))
    q = m.where(F.pmod(F.xxhash64("id"), F.lit(50)) == 0)  # the stated query set, against all units
    ship(spark)
    return quality.similar_units(q, m, 0.9, 1)


@query()
def memory_suggest(spark, d):
    # of a translation only whether there is one moves
    b = table(spark, d, "export_block").withColumn("filled", T.trim(F.col("translated_text")) != "")
    u = U.units(b, "source_text", "filled", "unit_status")
    t = table(spark, d, "export_document").groupBy("document_id").agg(F.max("target_language").alias("target"))
    stored = U.is_done() & F.coalesce("filled", F.lit(False))
    m = u.join(t, "document_id").select(F.col("block_id").alias("id"), "project_id", "target", F.col("source_text").alias("text"), F.lit(True).alias("asks"), stored.alias("stored"))
    ship(spark)
    return quality.suggested(m, quality.slices(b))  # all units, finished or not, against the finished ones


# --- usage and pools ------------------------------------------------------------------------------------------------
_EV = "e AS (SELECT DISTINCT result_id AS id, provider_id AS provider, model, key_id, finish_reason, input_tokens, output_tokens, cached_tokens, received_at AS tm FROM generate_result)"


def _events(spark, d) -> DataFrame:
    return table(spark, d, "generate_result").select(
        F.col("result_id").alias("id"), F.col("provider_id").alias("provider"), "model", "key_id", "finish_reason", "input_tokens", "output_tokens", "cached_tokens", F.col("received_at").alias("at")
    ).distinct()


@query(
    f"""WITH {_EV} SELECT provider, date_trunc('day', tm) AS day, count(*) AS requests, CAST(sum(coalesce(input_tokens, 0)) AS BIGINT) AS input_tokens, CAST(sum(coalesce(output_tokens, 0)) AS BIGINT) AS output_tokens,
    CAST(sum(coalesce(cached_tokens, 0)) AS BIGINT) AS cached_tokens, CASE WHEN bool_and(input_tokens IS NOT NULL AND output_tokens IS NOT NULL) THEN 'provider_reported' ELSE 'estimated' END AS basis
    FROM e WHERE provider IS NOT NULL AND tm IS NOT NULL GROUP BY 1, 2"""
)
def usage_daily(spark, d):
    return usage.daily(_events(spark, d)).drop("model")


@query(
    f"""WITH {_EV} SELECT CAST(grouping_id(provider, model) AS BIGINT) AS level, provider, model, count(*) AS requests, CAST(sum(coalesce(input_tokens, 0)) AS BIGINT) AS input_tokens,
    CAST(sum(coalesce(output_tokens, 0)) AS BIGINT) AS output_tokens, count(*) FILTER (output_tokens IS NULL) AS estimated FROM e GROUP BY GROUPING SETS ((), (provider), (provider, model))"""
)
def usage_breakdown(spark, d):
    return usage.breakdown(_events(spark, d))


@query(f"WITH {_EV} SELECT id, key_id, count(*) OVER w AS requests, CAST(sum(coalesce(output_tokens, 0)) OVER w AS BIGINT) AS tokens FROM e WHERE key_id IS NOT NULL AND tm IS NOT NULL WINDOW w AS (PARTITION BY key_id ORDER BY tm RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW)")
def rolling_60s(spark, d):
    return usage.rolling(_events(spark, d))


@query(
    f"""WITH {_EV}, f AS (SELECT key_id, sum(CAST(coalesce(lower(finish_reason), '') IN ('stop', 'end_turn') AS INT)) OVER (PARTITION BY key_id ORDER BY tm DESC, id DESC ROWS UNBOUNDED PRECEDING) AS k FROM e WHERE key_id IS NOT NULL)
    SELECT key_id, count(*) FILTER (k = 0) AS streak FROM f GROUP BY 1"""
)
def failure_streak(spark, d):
    return usage.failure_streaks(_events(spark, d).withColumn("ok", F.coalesce(F.lower("finish_reason").isin("stop", "end_turn"), F.lit(False))))


_KEYS = f"""WITH {_EV}, k AS (SELECT key_id, min(provider) AS provider, count(*) AS n, count(*) FILTER (coalesce(lower(finish_reason), '') NOT IN ('stop', 'end_turn')) AS bad, max(epoch_ms(tm)) AS last FROM e WHERE key_id IS NOT NULL GROUP BY 1),
    c AS (SELECT key_id, provider, n % 13 <> 0 AS enabled, CASE n % 5 WHEN 0 THEN 'unverified' WHEN 1 THEN 'revoked' ELSE 'valid' END AS verification, CASE WHEN bad * 4 > n THEN 'degraded' ELSE 'healthy' END AS health,
    n % 17 = 0 AS cooling, n % 19 <> 0 AS supports_model, bad % 6 AS recent_failures, bad % 4 AS recent_rate_limits, n % 60 AS requests_in_window, n * 37 % 9000 AS tokens_in_window, last FROM k)"""


def _keys(spark, d) -> DataFrame:
    ok = F.coalesce(F.lower("finish_reason").isin("stop", "end_turn"), F.lit(False))
    k = _events(spark, d).where("key_id IS NOT NULL").groupBy("key_id").agg(F.min("provider").alias("provider"), F.count("*").alias("n"), F.count_if(~ok).alias("bad"), F.max(F.unix_millis("at")).alias("last_used_ms"))
    n, bad = F.col("n"), F.col("bad")
    return k.select(
        "key_id", "provider", "last_used_ms", (n % 13 != 0).alias("enabled"), F.when(n % 5 == 0, "unverified").when(n % 5 == 1, "revoked").otherwise("valid").alias("verification"),
        F.when(bad * 4 > n, "degraded").otherwise("healthy").alias("health"), F.when(n % 17 == 0, F.col("last_used_ms") + 1).otherwise(0).alias("cooldown_until"), (n % 19 != 0).alias("supports_model"),
        (bad % 6).alias("recent_failures"), (bad % 4).alias("recent_rate_limits"), (n % 60).alias("requests_in_window"), (n * 37 % 9000).alias("tokens_in_window"), F.lit(50).alias("rpm_limit"), F.lit(8000).alias("tpm_limit"), F.lit(500).alias("estimated_tokens"),
    )


@query(
    _KEYS
    + """ SELECT key_id, CASE WHEN NOT enabled THEN 'disabled' WHEN verification = 'revoked' THEN 'verification_failed' WHEN cooling THEN 'cooling' WHEN NOT supports_model THEN 'unsupported_model'
    WHEN requests_in_window >= 50 THEN 'rpm_exhausted' WHEN tokens_in_window + 500 > 8000 THEN 'tpm_exhausted' END AS rejection FROM c"""
)
def key_rejections(spark, d):
    return _keys(spark, d).select("key_id", usage.rejection(F.col("last_used_ms")).alias("rejection"))


_WEIGHT = """CASE health WHEN 'healthy' THEN 1.0::DOUBLE ELSE 0.35::DOUBLE END * CASE verification WHEN 'valid' THEN 1.25::DOUBLE ELSE 0.6::DOUBLE END * (1.0::DOUBLE / (1.0::DOUBLE + 0.5::DOUBLE * recent_failures + 0.75::DOUBLE * recent_rate_limits))
    * (0.3::DOUBLE + 0.7::DOUBLE * least(1.0::DOUBLE, greatest(0.0::DOUBLE, 1.0::DOUBLE - requests_in_window / 50.0::DOUBLE))) * (0.3::DOUBLE + 0.7::DOUBLE * least(1.0::DOUBLE, greatest(0.0::DOUBLE, (8000 - tokens_in_window - 500) / 8000.0::DOUBLE)))
    * (1.0::DOUBLE + 0.5::DOUBLE * (120000 / 300000.0::DOUBLE))"""


@query(_KEYS + f" SELECT key_id, round({_WEIGHT}, 9) AS w FROM c")
def key_weights(spark, d):
    return _keys(spark, d).select("key_id", F.round(usage.weight(F.col("last_used_ms") + 120_000), 9).alias("w"))


@query(
    _KEYS
    + f""", w AS (SELECT provider, key_id, round({_WEIGHT}, 9) AS w FROM c WHERE enabled AND verification <> 'revoked' AND NOT cooling AND supports_model AND requests_in_window < 50 AND tokens_in_window + 500 <= 8000),
    s AS (SELECT provider, key_id, sum(w) OVER (PARTITION BY provider ORDER BY key_id ROWS UNBOUNDED PRECEDING) AS s, sum(w) OVER (PARTITION BY provider) AS t FROM w) SELECT provider, min(key_id) AS key_id FROM s WHERE s >= 0.37::DOUBLE * t GROUP BY 1"""
)
def key_pick(spark, d):
    k = _keys(spark, d)
    w = k.where(usage.rejection(F.col("last_used_ms")).isNull()).select("provider", "key_id", F.round(usage.weight(F.col("last_used_ms") + 120_000), 9).alias("w"))
    return usage.pick(w, F.lit(0.37))


@query(
    f"""WITH {_EV} SELECT provider, count(DISTINCT key_id) AS keys, count(*) FILTER (coalesce(lower(finish_reason), '') IN ('stop', 'end_turn')) AS succeeded, count(*) AS requests, max(tm) AS last_at FROM e GROUP BY 1"""
)
def pool_state(spark, d):
    ok = F.coalesce(F.lower("finish_reason").isin("stop", "end_turn"), F.lit(False))
    return _events(spark, d).groupBy("provider").agg(F.countDistinct("key_id").alias("keys"), F.count_if(ok).alias("succeeded"), F.count("*").alias("requests"), F.max("at").alias("last_at"))


_JOBS = "(SELECT o_orderkey AS id, 6 - CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority, o_orderdate AS queued_at, o_orderstatus AS status FROM orders)"


def _jobs(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (6 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority"), F.col("o_orderdate").alias("queued_at"), F.col("o_orderstatus").alias("status"))


@query(f"SELECT id, priority FROM {_JOBS} ORDER BY priority DESC, queued_at, id LIMIT 1")
def next_job(spark, d):
    return usage.next_jobs(_jobs(spark, d), 1, oldest=True).select("id", "priority")


@query(f"SELECT id, priority FROM {_JOBS} ORDER BY priority DESC, queued_at DESC, id LIMIT 50")
def recent_jobs(spark, d):
    return usage.next_jobs(_jobs(spark, d), 50, oldest=False).select("id", "priority")


def _edges_sql() -> str:
    states = ", ".join(f"('{s}')" for s in usage.TRANSITIONS)
    edges = ", ".join(f"('{k}', '{x}')" for k, v in usage.TRANSITIONS.items() for x in v)
    return f"WITH s(x) AS (VALUES {states}), e(a, b) AS (VALUES {edges}) SELECT s.x AS a, t.x AS b, s.x = t.x OR e.a IS NOT NULL AS may FROM s, s t LEFT JOIN e ON e.a = s.x AND e.b = t.x"


@query(_edges_sql())
def job_transitions(spark, d):
    s = spark.createDataFrame([(x,) for x in usage.TRANSITIONS], "a string")
    return s.join(F.broadcast(s.withColumnRenamed("a", "b")), how="cross").select("a", "b", usage.may_go(F.col("a"), F.col("b")).alias("may"))  # nine states


# --- relational core ------------------------------------------------------------------------------------------------
@query(
    f"""WITH {NEWEST}, dd AS (SELECT DISTINCT document_id, title, target_language FROM export_document)
    SELECT dd.document_id, u.page_index, count(u.block_id) AS blocks, CAST(sum(length(coalesce(nullif({trim_sql('u.translated_text')}, ''), u.source_text))) AS BIGINT) AS chars FROM dd LEFT JOIN u ON u.document_id = dd.document_id GROUP BY ALL"""
)
def page_model(spark, d):
    u = _units(spark, d, "page_index", "source_text", "translated_text")
    docs = table(spark, d, "export_document").select("document_id", "title", "target_language").distinct()
    shown = F.coalesce(F.nullif(T.trim(F.col("translated_text")), F.lit("")), F.col("source_text"))
    pages = u.groupBy("document_id", "page_index").agg(F.count("*").alias("blocks"), F.sum(F.length(shown)).alias("chars"))
    return docs.select("document_id").distinct().join(pages, "document_id", "left").select("document_id", "page_index", F.coalesce("blocks", F.lit(0)).alias("blocks"), "chars")


@query("SELECT DISTINCT c.call_id FROM translation_call c ANTI JOIN generate_result r ON r.call_id = c.call_id")
def orphan_calls(spark, d):
    return table(spark, d, "translation_call").select("call_id").distinct().join(table(spark, d, "generate_result").select("call_id"), "call_id", "left_anti")


@query("SELECT call_id, count(DISTINCT result_id) AS results FROM generate_result GROUP BY 1 HAVING count(DISTINCT result_id) > 1")
def repeated_calls(spark, d):
    return table(spark, d, "generate_result").groupBy("call_id").agg(F.countDistinct("result_id").alias("results")).where("results > 1")


@query("SELECT project_id, name FROM projects WHERE contains(lower(name), 'a') ORDER BY updated_at DESC NULLS LAST, project_id LIMIT 5")
def recent_projects(spark, d):
    return table(spark, d, "projects").where(F.contains(F.lower("name"), F.lit("a"))).orderBy(F.desc_nulls_last("updated_at"), "project_id").select("project_id", "name").limit(5)


@query("SELECT block_id, translated_text FROM (SELECT DISTINCT block_id, regexp_replace(translated_text, 'a\\.m\\.', 'o''clock', 'gi') AS translated_text, translated_text AS t FROM export_block) WHERE translated_text <> t")
def replace_all(spark, d):
    b = table(spark, d, "export_block").select("block_id", "translated_text").distinct()
    new = F.regexp_replace("translated_text", r"(?i)\Qa.m.\E", "o'clock")
    return b.where(new != F.col("translated_text")).select("block_id", new.alias("translated_text"))




@query("SELECT event_id, event_type FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 100")
def error_log(spark, d):
    return table(spark, d, "events").where("event_type = 'error'").orderBy(F.desc("ts"), "event_id").select("event_id", "event_type").limit(100)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from folioflow.plans import documents, records, reports, translate  # noqa: F401

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from folioflow.plans import documents, records, reports, translate  # noqa: F401

    return dict(_SQL)
