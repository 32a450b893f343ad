"""Budgeted request planning that keeps the order of units."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.arrow import map_rows
from folioflow.functions import text as T
from folioflow.operators import translate

#: Fixed values of the planner.
MOST_UNITS, FRAME, UNIT_FRAME, RESERVE = 32, 16, 8, 512
QUALITY = {"draft": 1.6, "standard": 1.0, "precise": 0.55}
DOCUMENT = {"pdf": 0.75, "docx": 0.9, "text": 1.0, "markdown": 0.9, "html": 0.75, "csv": 0.5, "json": 0.5}


def payload_budget(context: int, output: int, target: str, document: str = "text", quality: str = "standard", rpm: int | None = None, overhead: int = 0) -> int:
    """Tokens of text that one request may hold."""
    room = max(32, max(128, context - output - RESERVE) - overhead)
    budget = min(room, math.floor((output * 0.95 - FRAME) / (6 if target == "my" else 2)))
    budget *= QUALITY[quality] * DOCUMENT.get(document, 1.0) * (1.5 if rpm and 0 < rpm < 10 else 1.0)
    return max(32, math.floor(min(budget, room)))


def plan(tokens: list[int], chars: list[int], budget: int, output: int, per_char: float, most: int = MOST_UNITS) -> list[tuple[int, bool]]:
    """(batch number, oversized) of each unit, greedily in order; one that fits nowhere goes alone."""
    out: list[tuple[int, bool]] = []
    batch, n, used, size = -1, 0, 0, 0
    for t, c in zip(tokens, chars):
        t += UNIT_FRAME
        if t > budget or c * per_char + FRAME > output:
            batch, n = batch + 1, 0
            out.append((batch, True))
            continue
        if n == 0 or used + t > budget or n >= most or (size + c) * per_char + FRAME > output:
            batch, n, used, size = batch + 1, 0, 0, 0
        n, used, size = n + 1, used + t, size + c
        out.append((batch, False))
    return out


def plan_batches(units: DataFrame, context: int, output: int, quality: str = "standard", rpm: int | None = None) -> DataFrame:
    """(document_id, block_id, batch_no, oversized): batches of each document's units in order.

    units: document_id, block_id, order_index, source_text, source, target,
    document. The tokens of the instructions (translate.instructions) leave the
    window first. Only ids, token counts and lengths are gathered by document, not texts.
    """
    told = translate.message_tokens(translate.instructions(F.max("source"), F.max("target"), F.max("document")))
    if "source" not in units.columns:  # an unknown language
        units = units.withColumn("source", F.lit(None).cast("string"))
    rows = units.select("document_id", "source", "target", "document", F.struct("order_index", "block_id", T.estimate_tokens(F.col("source_text")).alias("t"), F.length("source_text").alias("c")).alias("u"))
    docs = rows.groupBy("document_id").agg(F.max("target").alias("target"), F.max("document").alias("document"), told.alias("told"), F.sort_array(F.collect_list("u")).alias("us"))

    def make():
        def kernel(ids, targets, documents, overheads, lists):
            out = [[], [], [], []]
            for i, target, document, overhead, us in zip(ids, targets, documents, overheads, lists):
                b = payload_budget(context, output, target or "", document or "text", quality, rpm, overhead)
                for u, (k, big) in zip(us, plan([x["t"] for x in us], [x["c"] for x in us], b, output, 1.6 if target == "my" else 0.5)):
                    for col, v in zip(out, (i, u["block_id"], k, big)):
                        col.append(v)
            return out

        return kernel

    return map_rows(docs.select("document_id", "target", "document", "told", "us"), "document_id string, block_id string, batch_no int, oversized boolean", make)
