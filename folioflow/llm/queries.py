"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import bpe, language, leakage, packing, pairs, residue, scans, sentences, split, truncation
from folioflow.tables import newest, settle, ship, table

#: Where the public vocabularies are; a parameter of the encoding queries.
TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")


def _items(spark, d) -> DataFrame:
    blocks = table(spark, d, "export_block").select(F.lit("export_block").alias("item_kind"), "document_id", F.col("order_index").cast("int").alias("item_no"), F.col("source_text").alias("text"), "updated_at", "ingested_at")
    parts = table(spark, d, "structured_block").select(F.lit("structured_block").alias("item_kind"), "document_id", F.col("pos").cast("int").alias("item_no"), "text", *[F.lit(None).cast("timestamp").alias(c) for c in ("updated_at", "ingested_at")])
    return blocks.unionByName(parts)


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return split.split_oversized(_items(spark, d), table(spark, d, "size_limit"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_pieces(spark, d).where("piece_no = 0").select("item_kind", "document_id", "item_no")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    every = table(spark, d, "export_block")
    model = sentences.train(every)
    # scanned blocks are told by their ids, so that texts move once, to find the newest rows
    scanned = every.select("block_id", "document_id").join(table(spark, d, "grouped_line").select("document_id").distinct(), "document_id", "left_semi").select("block_id").distinct()
    blocks = every.select("block_id", "kind", "source_text", "translated_text", "updated_at", "ingested_at")
    last = newest(blocks, "block_id", "updated_at", "ingested_at").where("kind IN ('paragraph', 'quote')").join(scanned, "block_id", "left_anti")
    return sentences.split_sentences(last, model)


def _newest_blocks(spark, d, *more: str) -> DataFrame:
    b = table(spark, d, "export_block").select("block_id", "project_id", "translated_text", *more, "updated_at", "ingested_at")
    return newest(b, "block_id", "updated_at", "ingested_at")


def _measured(spark, d) -> DataFrame:
    ship(spark)
    return settle(truncation.measure(truncation.records(table(spark, d, "generate_result"), _newest_blocks(spark, d), table(spark, d, "translation_call"))))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(_measured(spark, d)).select("record_kind", "record_id").distinct()


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    m = _measured(spark, d)
    return truncation.rates(m, truncation.truncated(m))


def p3_limits(spark: SparkSession, d: str) -> DataFrame:
    return truncation.hidden_limits(_measured(spark, d))


def p4_requests(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return packing.pack_calls(table(spark, d, "translation_call"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_requests(spark, d).where("oversized AND part_no = 0").select("call_id", "unit_id")


def p4_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p4_requests(spark, d))


def p4_windows(spark: SparkSession, d: str) -> DataFrame:
    """All units of all calls in windows of 4,096 tokens that hold each project's share."""
    ship(spark)
    u = table(spark, d, "translation_call").select("project_id", F.explode("units").alias("u"))
    return packing.mix_windows(u.select(F.col("u.id").alias("item_id"), F.col("project_id").alias("source"), F.col("u.tokens").alias("tokens")), 4096)


def _languages(spark, d):
    ship(spark)
    blocks, docs = table(spark, d, "export_block"), table(spark, d, "export_document")
    dictionaries = language.fit(language.labelled_sample(blocks, docs))
    return language.languages(blocks, docs, settle(language.block_languages(blocks, dictionaries)))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return language.language_cases(*_languages(spark, d))


def p5_documents(spark: SparkSession, d: str) -> DataFrame:
    return _languages(spark, d)[0]


def p5_stretches(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    blocks = table(spark, d, "export_block")
    return language.block_languages(blocks, language.fit(language.labelled_sample(blocks, table(spark, d, "export_document")))).distinct()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    last = _newest_blocks(spark, d, "source_text", "unit_status")
    target = pairs.targets(table(spark, d, "export_block"), table(spark, d, "export_document"))
    return pairs.pair_defects(settle(pairs.examine(last, target)))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return scans.repairs(table(spark, d, "grouped_line"))[0]


def p7_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return scans.paragraphs(table(spark, d, "grouped_line"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return bpe.encode_documents(table(spark, d, "documents"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, same): whether decoding the ids gives the text again."""
    path = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
    ship(spark)
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    back = bpe.decode_documents(bpe.encode_documents(docs, path), path).withColumnRenamed("text", "again")
    return docs.join(back, "doc_id").select("doc_id", (F.col("text") == F.col("again")).alias("same"))


def _leaks(spark, d) -> DataFrame:
    ship(spark)
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_item"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    return leakage.remove_leaks(docs, _leaks(spark, d))


def _residue(spark, d) -> DataFrame:
    ship(spark)
    docs = table(spark, d, "documents")
    return residue.find_residue(docs, residue.fit(docs))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _residue(spark, d).select("doc_id", "residue").distinct()


def p10_clean(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    return residue.exclude(docs, _residue(spark, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (p1_found, p1_pieces, p2_found, p3_found, p3_rates, p3_limits, p4_found, p4_requests, p4_fill, p4_windows, p5_found, p5_documents, p5_stretches, p6_found, p7_found, p7_paragraphs, p8_ids, p8_round_trip, p9_found, p9_clean, p10_found, p10_clean)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": """
            SELECT DISTINCT x.item_kind, x.document_id, x.item_no FROM (
              SELECT 'export_block' AS item_kind, document_id, CAST(order_index AS INT) AS item_no, source_text AS text FROM export_block
              UNION ALL SELECT 'structured_block', document_id, CAST(pos AS INT), text FROM structured_block) x
            JOIN size_limit s ON s.item_kind = x.item_kind WHERE length(x.text) > s.max_chars""",
        "p4_found": """
            SELECT DISTINCT call_id, u.id AS unit_id FROM (SELECT call_id, max_output_tokens AS cap, unnest(units) AS u FROM translation_call)
            WHERE u.tokens > cap""",
        "p8_round_trip": "SELECT doc_id, true AS same FROM documents",
    }
