"""Queries of record stores, spatial joins, responses and pagination."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import pages, records, responses, spatial
from folioflow.operators import units as U
from folioflow.plans.catalog import NEWEST, _events, _units, query
from folioflow.tables import ship, table


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 7")
def point_lookup(spark, d):
    return records.get(table(spark, d, "orders"), "o_orderkey", 7).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders WHERE o_custkey BETWEEN 100 AND 200 ORDER BY o_custkey, o_orderkey LIMIT 50")
def index_range(spark, d):
    return records.by_index(table(spark, d, "orders"), "o_custkey", "o_orderkey", low=100, high=200, count=50).select("o_orderkey")


@query("SELECT status, count(*) AS n FROM projects WHERE status IS NOT NULL GROUP BY 1")
def index_counts(spark, d):
    return records.by_index(table(spark, d, "projects"), "status", "project_id").groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT max(c_custkey) + 1, 0.0::DOUBLE FROM customer")
def upserted(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    new = c.where("c_custkey % 10 = 0").select("c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal"))
    extra = c.agg((F.max("c_custkey") + 1).alias("c_custkey")).select("c_custkey", F.lit(0.0).alias("c_acctbal"))
    return records.upsert(c, new.unionByName(extra), "c_custkey")


@query("SELECT 'customer' AS store, count(*) AS n FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey % 3 <> 0")
def cascade_delete(spark, d):
    gone = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"))
    left = records.cascade({"customer": table(spark, d, "customer").withColumnRenamed("c_custkey", "k"), "orders": table(spark, d, "orders").withColumnRenamed("o_custkey", "k")}, gone, "k")
    return left["customer"].agg(F.lit("customer").alias("store"), F.count("*").alias("n")).unionByName(left["orders"].agg(F.lit("orders").alias("store"), F.count("*").alias("n")))


@query(
    """SELECT entity, entity_id, op, max(tm) AS changed_at, arg_max(payload, o) AS payload FROM (SELECT event_type AS entity, CAST(user_id AS VARCHAR) AS entity_id, CASE event_id % 3 WHEN 0 THEN 'delete' ELSE 'upsert' END AS op,
    ts AS tm, event_id AS payload, (ts, event_id) AS o FROM events WHERE event_type IS NOT NULL AND user_id IS NOT NULL) GROUP BY 1, 2, 3"""
)
def change_queue(spark, d):
    e = table(spark, d, "events").where("event_type IS NOT NULL AND user_id IS NOT NULL")
    op = F.when(F.col("event_id") % 3 == 0, "delete").otherwise("upsert")
    log = e.select(F.col("event_type").alias("entity"), F.col("user_id").cast("string").alias("entity_id"), op.alias("op"), F.struct("ts", "event_id").alias("at"), F.col("event_id").alias("payload"))
    return records.changes(log).select("entity", "entity_id", "op", F.col("at.ts").alias("changed_at"), "payload")


@query("SELECT p.project_id, coalesce(max(CASE WHEN d.page_count > 3 THEN 'large' END), 'small') AS size FROM projects p LEFT JOIN export_document d ON d.project_id = p.project_id GROUP BY 1")
def project_defaults(spark, d):
    big = table(spark, d, "export_document").where("page_count > 3").select("project_id", F.lit("large").alias("size")).distinct()
    return records.with_defaults(big, table(spark, d, "projects"), "project_id", {"size": "small"})




@query("SELECT n_nationkey, n_name, CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey + 10 ELSE n_regionkey END AS n_regionkey FROM nation")
def catalog_overlay(spark, d):
    n = table(spark, d, "nation")
    patch = n.where("n_nationkey % 2 = 0").select("n_nationkey", F.lit(None).cast("string").alias("n_name"), (F.col("n_regionkey") + 10).cast("int").alias("n_regionkey"))
    return records.overlay(n, patch, ("n_nationkey",), ("n_name", "n_regionkey"))


@query("SELECT 'nation' AS store, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region")
def bundle_counts(spark, d):
    b = records.bundle({"nation": table(spark, d, "nation"), "region": table(spark, d, "region")})
    return b.groupBy("store").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT document_id, regexp_replace(file_name, '\\.[^.]*$', '') || '-' || target_language || '.docx' AS output FROM export_document WHERE file_name IS NOT NULL")
def output_names(spark, d):
    x = table(spark, d, "export_document").where("file_name IS NOT NULL")
    return x.select("document_id", records.output_name(F.col("file_name"), F.col("target_language"), "docx").alias("output")).distinct()


_BOX = f"WITH {NEWEST}, b AS (SELECT block_id, document_id, page_index, kind, bbox.x AS x, bbox.y AS y, bbox.width AS w, bbox.height AS h FROM u WHERE bbox IS NOT NULL)"


@query(
    _BOX
    + """ SELECT DISTINCT p.block_id FROM b p JOIN b q ON p.document_id = q.document_id AND p.page_index = q.page_index WHERE p.kind <> 'table' AND q.kind = 'table'
    AND greatest(0, least(p.x + p.w, q.x + q.w) - greatest(p.x, q.x)) >= 0.4::DOUBLE * least(p.w, q.w) AND p.y - (q.y + q.h) BETWEEN -4 AND 32"""
)
def caption_semi(spark, d):
    b = _units(spark, d, "page_index", "kind", "bbox").where("bbox IS NOT NULL").withColumn("box", F.col("bbox"))
    return spatial.captions(b.where("kind <> 'table'"), b.where("kind = 'table'")).select("block_id").distinct()


@query(
    _BOX
    + """, a AS (SELECT block_id AS link_id, document_id, page_index, x + 5 AS x, y + 2 AS y, w * 0.5::DOUBLE AS w, h AS h, 'u' || block_id AS url FROM b WHERE kind = 'heading'),
    j AS (SELECT b.block_id, a.link_id, a.url, greatest(0, least(b.x + b.w, a.x + a.w) - greatest(b.x, a.x)) * greatest(0, least(b.y + b.h, a.y + a.h) - greatest(b.y, a.y)) / greatest(1e-9::DOUBLE, a.w * a.h) AS s FROM b JOIN a ON a.document_id = b.document_id AND a.page_index = b.page_index),
    r AS (SELECT *, row_number() OVER (PARTITION BY link_id ORDER BY s DESC, block_id) AS rn FROM j WHERE s >= 0.5::DOUBLE) SELECT block_id, arg_max(url, link_id) AS url FROM r WHERE rn = 1 GROUP BY 1"""
)
def link_argmax(spark, d):
    b = _units(spark, d, "page_index", "kind", "bbox").where("bbox IS NOT NULL").select("block_id", "document_id", "page_index", "kind", F.col("bbox").alias("box"))
    box = F.struct((F.col("box.x") + 5).alias("x"), (F.col("box.y") + 2).alias("y"), (F.col("box.width") * 0.5).alias("width"), F.col("box.height").alias("height"))
    a = b.where("kind = 'heading'").select(F.col("block_id").alias("link_id"), "document_id", "page_index", box.alias("box"), F.concat(F.lit("u"), "block_id").alias("url"))
    return spatial.links(b, a)


@query(_BOX + " SELECT block_id, CASE WHEN greatest(40 - x, x - 250, 0) <= greatest(300 - x, x - 500, 0) THEN 0 ELSE 1 END AS region FROM b")
def nearest_region(spark, d):
    b = _units(spark, d, "bbox").where("bbox IS NOT NULL")
    return b.select("block_id", spatial.nearest_region(F.col("bbox.x"), [(40.0, 250.0), (300.0, 500.0)]).alias("region"))


@query()
def parsed_responses(spark, d):
    r = table(spark, d, "generate_result").where("structured").select("result_id", "text")
    return responses.translations(r).select("result_id", "unit_id", F.length("text").alias("chars"))


@query()
def incomplete_responses(spark, d):
    return responses.incomplete(table(spark, d, "translation_call"), table(spark, d, "generate_result").where("structured"))


@query("SELECT provider, CAST(sum(floor(((coalesce(i, 0) * 0.5::DOUBLE + coalesce(o, 0) * 1.5::DOUBLE) / 1e6::DOUBLE) * 10000 + 0.5::DOUBLE)) AS BIGINT) AS cost_e4 FROM (SELECT DISTINCT result_id, provider_id AS provider, input_tokens AS i, output_tokens AS o FROM generate_result) GROUP BY 1")
def usage_cost(spark, d):
    e = _events(spark, d)
    c = responses.cost(F.col("input_tokens"), F.col("output_tokens"), F.lit(0.5), F.lit(1.5))
    return e.groupBy("provider").agg(F.sum(F.floor(c * 10_000 + F.lit(0.5))).cast("bigint").alias("cost_e4"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '[\\x{1000}-\\x{109F}\\x{A9E0}-\\x{A9FF}\\x{AA60}-\\x{AA7F}]+|[^\\x{1000}-\\x{109F}\\x{A9E0}-\\x{A9FF}\\x{AA60}-\\x{AA7F}]+')) AS BIGINT) AS runs FROM documents WHERE text IS NOT NULL")
def script_runs(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.size(responses.script_runs(F.col("text"))).cast("bigint").alias("runs"))


@query()
def render_plan(spark, d):
    ship(spark)
    b = table(spark, d, "structured_block").select("document_id", "pos", "kind", "level", "text").distinct()
    return pages.render_plan(b)


@query(f"WITH {NEWEST} SELECT block_id FROM u WHERE contains(lower(source_text), 'key pool') OR contains(lower(coalesce(translated_text, '')), 'key pool')")
def unit_search(spark, d):
    u = _units(spark, d, "source_text", "translated_text")
    has = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit("key pool"))
    return u.where(has("source_text") | has("translated_text")).select("block_id")


@query(f"WITH {NEWEST} SELECT project_id, CAST(floor(100.0::DOUBLE * count(*) FILTER (unit_status IN ('translated', 'reviewed')) / count(*) + 0.5::DOUBLE) AS INT) AS percent FROM u GROUP BY 1")
def project_progress(spark, d):
    u = _units(spark, d, "unit_status")
    return u.groupBy("project_id").agg(T.percent(F.count_if(U.is_done()), F.count("*")).alias("percent"))
