"""The unit store: newest rows, furniture, joins with pages and documents, progress, incremental merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.tables import newest

DONE = ("translated", "reviewed")
FURNITURE = ("page_number", "header_footer")


def units(blocks: DataFrame, *more: str) -> DataFrame:
    """The newest row of each block as a unit: only the columns named move in the shuffle."""
    cols = list(dict.fromkeys(["block_id", "document_id", "project_id", *more, "updated_at", "ingested_at"]))
    return newest(blocks.select(*cols), "block_id", "updated_at", "ingested_at")


def is_done(c: Column | str = "unit_status") -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).isin(*DONE), F.lit(False))


def is_furniture(flags: Column) -> Column:
    """True if the block is a page number, header or footer; null flags mean no."""
    return F.coalesce(F.arrays_overlap(flags, F.array(*map(F.lit, FURNITURE))), F.lit(False))


def page_progress(u: DataFrame) -> DataFrame:
    """(document_id, page_index, total, done, failed): units of each page."""
    return u.groupBy("document_id", "page_index").agg(F.count("*").alias("total"), F.count_if(is_done()).alias("done"), F.count_if(F.coalesce(F.col("unit_status") == "failed", F.lit(False))).alias("failed"))


def document_progress(u: DataFrame) -> DataFrame:
    """(document_id, pages, completed_pages, total, done, percent): a page is complete if all its units are done."""
    p = page_progress(u)
    d = p.groupBy("document_id").agg(F.count("*").alias("pages"), F.count_if(F.col("done") >= F.col("total")).alias("completed_pages"), F.sum("total").alias("total"), F.sum("done").alias("done"))
    return d.withColumn("percent", T.percent(F.col("done"), F.col("total")))


def sample_prefix(u: DataFrame, most: int = 50_000) -> DataFrame:
    """The blocks of a document, in order, until their characters before reach ``most``."""
    w = Window.partitionBy("document_id").orderBy("order_index").rowsBetween(Window.unboundedPreceding, -1)
    return u.withColumn("chars_before", F.coalesce(F.sum(F.length("source_text")).over(w), F.lit(0)).cast("bigint")).where(F.col("chars_before") < most)


def missing_pages(documents: DataFrame, u: DataFrame) -> DataFrame:
    """(document_id, page_index): pages a document should have by page_count but has no unit on."""
    want = documents.where("page_count > 0").groupBy("document_id").agg(F.max("page_count").alias("n")).select("document_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("page_index"))
    return want.join(u.select("document_id", "page_index").distinct(), ["document_id", "page_index"], "left_anti")


def merge(prior: DataFrame, following: DataFrame) -> DataFrame:
    """Incremental upsert: work is kept where the source text's checksum is unchanged.

    Both have block_id, checksum; prior also translated_text and unit_status.
    action is keep, reset (text changed), insert or delete (gone from the source).
    """
    p = prior.select("block_id", F.col("checksum").alias("_old"), "translated_text", "unit_status")
    j = following.select("block_id", "checksum", F.lit(True).alias("_in")).join(p, "block_id", "full")
    same = F.col("_in") & (F.col("checksum") == F.col("_old"))
    action = F.when(F.col("_in").isNull(), "delete").when(F.col("_old").isNull(), "insert").when(same, "keep").otherwise("reset")
    return j.select("block_id", action.alias("action"), F.when(same, F.col("translated_text")).alias("translated_text"), F.when(same, F.col("unit_status")).when(F.col("_in"), "pending").alias("unit_status"))


def reading_order(u: DataFrame) -> DataFrame:
    """(block_id, reading_order): bands opened by blocks of at least .6 of the page's width, within them region by region, then top to bottom.

    u: block_id, document_id, page_index, x, y, width, region, page_width.
    Null regions come first, as region 0; ties go by block_id.
    """
    page = Window.partitionBy("document_id", "page_index")
    flow = page.orderBy("y", "x", "block_id").rowsBetween(Window.unboundedPreceding, 0)
    r = u.withColumn("_full", (F.col("width") >= F.lit(0.6) * F.col("page_width")).cast("int")).withColumn("_region", F.coalesce("region", F.lit(0)))
    r = r.withColumn("_band", F.sum("_full").over(flow))
    return r.select("block_id", (F.row_number().over(page.orderBy("_band", F.desc("_full"), "_region", "y", "x", "block_id")) - 1).alias("reading_order"))


def paragraph_islands(lines: DataFrame) -> DataFrame:
    """(line_id, island): runs of lines with like type and close baselines; a line joins the one before it or opens a run."""
    w = Window.partitionBy("document_id", "page_index").orderBy("baseline", "line_id")
    size, prev = F.col("font_size"), F.lag("font_size").over(w)
    fits = (
        (F.lag(F.col("list_marker").isNotNull()).over(w) == F.col("list_marker").isNotNull())
        & (F.abs(size - prev) <= F.lit(0.12) * F.greatest(size, prev))
        & (F.col("baseline") - F.lag("baseline").over(w) <= F.when(F.col("list_marker").isNotNull(), F.lit(1.8)).otherwise(F.lit(1.95)) * F.greatest(size, prev))
    )
    r = lines.withColumn("_new", F.when(F.coalesce(fits, F.lit(False)), 0).otherwise(1))
    return r.select("line_id", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("island"))


def font_mode(lines: DataFrame) -> DataFrame:
    """(document_id, body_size, n_sizes, largest): the size of most characters, in half points; ties to the smaller."""
    s = lines.groupBy("document_id", (F.floor(F.col("font_size") * 2 + F.lit(0.5)) / 2).alias("size")).agg(F.sum(F.length("text")).alias("n"))
    return s.groupBy("document_id").agg(F.max_by("size", F.struct(F.col("n"), -F.col("size"))).alias("body_size"), F.count_if(F.col("n") >= 8).alias("n_sizes"), F.max("size").alias("largest"))
