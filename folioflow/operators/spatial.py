"""Joins by place on a page: captions under figures, links over blocks, the nearest column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Overlap of widths, gap in points, and overlap of areas.
CAPTION_OVERLAP, CAPTION_GAP, LINK_OVERLAP = 0.4, (-4.0, 32.0), 0.5


def _overlap(a: str, b: str, at: str, size: str) -> Column:
    lo, hi = F.greatest(F.col(f"{a}.{at}"), F.col(f"{b}.{at}")), F.least(F.col(f"{a}.{at}") + F.col(f"{a}.{size}"), F.col(f"{b}.{at}") + F.col(f"{b}.{size}"))
    return F.greatest(F.lit(0.0), hi - lo)


def captions(blocks: DataFrame, figures: DataFrame) -> DataFrame:
    """Blocks right under a figure or table of their page that they share width with; both have document_id, page_index, box."""
    a, b = blocks.alias("p"), figures.alias("q")
    same = (F.col("p.document_id") == F.col("q.document_id")) & (F.col("p.page_index") == F.col("q.page_index"))
    gap = F.col("p.box.y") - (F.col("q.box.y") + F.col("q.box.height"))
    wide = _overlap("p.box", "q.box", "x", "width") >= F.lit(CAPTION_OVERLAP) * F.least(F.col("p.box.width"), F.col("q.box.width"))
    return a.join(b, same & wide & gap.between(*map(F.lit, CAPTION_GAP)), "left_semi")


def links(blocks: DataFrame, areas: DataFrame) -> DataFrame:
    """(block_id, url): the block each link area lies on by at least half of its area; ties to the smaller block_id, the last url of a block wins."""
    a, b = blocks.alias("p"), areas.alias("q")
    same = (F.col("p.document_id") == F.col("q.document_id")) & (F.col("p.page_index") == F.col("q.page_index"))
    share = _overlap("p.box", "q.box", "x", "width") * _overlap("p.box", "q.box", "y", "height") / F.greatest(F.lit(1e-9), F.col("q.box.width") * F.col("q.box.height"))
    j = a.join(b, same).select("block_id", "link_id", "url", share.alias("share")).where(F.col("share") >= LINK_OVERLAP)
    best = j.withColumn("rn", F.row_number().over(Window.partitionBy("link_id").orderBy(F.desc("share"), "block_id"))).where("rn = 1")
    return best.groupBy("block_id").agg(F.max_by("url", "link_id").alias("url"))


def nearest_region(x: Column, regions: list[tuple[float, float]]) -> Column:
    """Index of the region whose interval is nearest to x, ties to the first."""
    d = [F.greatest(F.lit(lo) - x, x - F.lit(hi), F.lit(0.0)) for lo, hi in regions]
    least = F.least(*d) if len(d) > 1 else d[0]
    return F.coalesce(*[F.when(v == least, F.lit(i)) for i, v in enumerate(d)])
