"""A translation run over tables: prompts and their tokens, budgets, halves of failed batches, candidates, and what a run writes back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as T

#: Least tokens of an answer, frame of a message in tokens, and limits of a model that isn't in the catalog.
LEAST_OUTPUT, MESSAGE_FRAME, CONTEXT, OUTPUT = 512, 4, 8192, 2048
#: The order in which providers are tried is the caller's; pools in these states give no candidate.
SPENT = ["no_keys", "quota", "invalid"]

#: Our wording of the instructions; a parameter wherever it is used.
INSTRUCTIONS = (
    "Translate each unit from {source} to {target}. Keep numbers, units of measurement, formulas, code, addresses, citation marks and markup as they are. "
    "Use one term for one thing. Keep names unless {target} has a form of its own. Keep tone, paragraphs and punctuation. "
    "The units come from a document of type {document}. Answer with one JSON object and nothing else: "
    'an object whose member "translations" lists each unit once, in order, with its id and its text.'
)


def instructions(source: Column, target: Column, document: Column, wording: str = INSTRUCTIONS) -> Column:
    """The instruction text for a pair of languages and a type of document; null fields count as und."""
    out = F.lit(wording)
    for name, c in (("{source}", source), ("{target}", target), ("{document}", document)):
        out = F.replace(out, F.lit(name), F.coalesce(c, F.lit("und")))
    return out


def message_tokens(*contents: Column) -> Column:
    """Estimated tokens of messages: each one's text and frame."""
    total = F.lit(0).cast("bigint")
    for c in contents:
        total = total + T.estimate_tokens(F.coalesce(c, F.lit(""))) + MESSAGE_FRAME
    return total


def payload(units: Column) -> Column:
    """The units (array of struct<id, text>) of a request as JSON."""
    return F.to_json(F.struct(units.alias("units")))


def glossary_rules(entries: DataFrame) -> DataFrame:
    """(project_id, rules): each project's rules, by term, as compact structs without empty members."""
    blank = lambda c: F.when(T.trim(F.col(c)) != "", T.trim(F.col(c)))
    r = entries.select("project_id", F.struct(blank("source_term").alias("source"), blank("preferred").alias("preferred"), blank("forbidden").alias("forbidden")).alias("r")).where("r.source IS NOT NULL AND r.preferred IS NOT NULL")
    return r.groupBy("project_id").agg(F.sort_array(F.collect_set("r")).alias("rules"))


def output_budget(context: Column, most: Column, prompt: Column) -> Column:
    """Tokens that an answer may have: what the window leaves, LEAST_OUTPUT at least."""
    return F.greatest(F.lit(LEAST_OUTPUT), F.least(F.coalesce(most, F.lit(OUTPUT)), F.coalesce(context, F.lit(CONTEXT)) - prompt))


def halves(batches: DataFrame, budget: str = "budget") -> DataFrame:
    """Failed batches of two units or more, halved: batch_id, half (0 or 1), unit_id, position, chars, budget.

    batches: batch_id, unit_id, position, chars, budget. The first half has the
    odd unit; each half gets the share of the parent's budget that its
    characters have, rounded up, LEAST_OUTPUT at least. Batches of one unit
    give no row.
    """
    whole = Window.partitionBy("batch_id")
    b = batches.withColumn("_n", F.count("*").over(whole)).withColumn("_i", F.row_number().over(whole.orderBy("position", "unit_id"))).where("_n > 1")
    b = b.withColumn("half", (F.col("_i") > F.ceil(F.col("_n") / 2)).cast("int"))
    own, all_ = F.sum("chars").over(Window.partitionBy("batch_id", "half")), F.sum("chars").over(whole)
    share = F.when(all_ > 0, F.greatest(F.lit(LEAST_OUTPUT), F.ceil(F.col(budget) * own / all_))).otherwise(F.col(budget)).cast("bigint")
    return b.select("batch_id", "half", "unit_id", "position", "chars", share.alias("budget"))


def candidates(configs: DataFrame, catalog: DataFrame, pools: DataFrame) -> DataFrame:
    """Configurations that a run may use: provider, model, context, output, rank; by rank.

    configs: provider, model, enabled, rank; catalog: provider, model, context,
    output; pools: provider, exhaustion. A model outside the catalog has the
    default limits; pools without a row count as without keys.
    """
    c = configs.where("enabled AND model IS NOT NULL").join(catalog.select("provider", "model", "context", "output"), ["provider", "model"], "left").join(pools.select("provider", "exhaustion"), "provider", "left")
    c = c.where(~F.coalesce("exhaustion", F.lit("no_keys")).isin(*SPENT))
    return c.select("provider", "model", F.coalesce("context", F.lit(CONTEXT)).alias("context"), F.coalesce("output", F.lit(OUTPUT)).alias("output"), "rank").orderBy("rank", "provider", "model")


def write_back(units: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The units after a batch: unit_id, unit_status, translated_text, tokens, retries.

    units: unit_id, unit_status, translated_text, retries; outcomes: unit_id,
    batch_id, text (null where it failed), batch_tokens. A translated unit
    takes an equal share of its batch's tokens, rounded; a failed one keeps its
    text and counts a retry. Reviewed units and units without an outcome stay
    as they are.
    """
    share = F.floor(F.col("batch_tokens") / F.count("*").over(Window.partitionBy("batch_id")) + F.lit(0.5)).cast("bigint")
    o = outcomes.select("unit_id", F.col("text").alias("_text"), share.alias("_tokens"), F.lit(True).alias("_ran"))
    j = units.join(o, "unit_id", "left").withColumn("_ran", F.coalesce("_ran", F.lit(False)) & (F.coalesce("unit_status", F.lit("pending")) != "reviewed"))
    done, failed = F.col("_ran") & F.col("_text").isNotNull(), F.col("_ran") & F.col("_text").isNull()
    return j.select(
        "unit_id", F.when(done, "translated").when(failed, "failed").otherwise(F.col("unit_status")).alias("unit_status"), F.when(done, F.col("_text")).otherwise(F.col("translated_text")).alias("translated_text"),
        F.when(done, F.col("_tokens")).alias("tokens"), (F.coalesce("retries", F.lit(0)) + failed.cast("int")).alias("retries"),
    )


def set_language(units: DataFrame, detected: DataFrame) -> DataFrame:
    """(unit_id, source_language): units whose document's language was found to be another; unknown never overwrites."""
    j = units.join(detected.select("document_id", F.col("language").alias("_new")), "document_id").where(F.col("_new").isNotNull() & (F.col("_new") != "unknown"))
    return j.where(~F.col("source_language").eqNullSafe(F.col("_new"))).select("unit_id", F.col("_new").alias("source_language"))


def resume_at(units: DataFrame) -> DataFrame:
    """(document_id, furthest, left): the last finished unit of each document and how many wait."""
    done = F.col("unit_status").isin("translated", "reviewed")
    return units.groupBy("document_id").agg(F.max(F.when(done, F.col("order_index"))).alias("furthest"), F.count_if(~F.coalesce(done, F.lit(False))).alias("left"))


#: The type of a document by its file name's end.
TYPES = {".docx": "docx", ".md": "markdown", ".markdown": "markdown", ".html": "html", ".htm": "html", ".csv": "csv", ".json": "json"}


def document_type(kind: Column, file_name: Column) -> Column:
    """pdf by its kind, others by the file name's end, text where that says nothing."""
    name = F.lower(F.coalesce(file_name, F.lit("")))
    return F.when(kind == "pdf", "pdf").otherwise(F.coalesce(*[F.when(F.endswith(name, F.lit(end)), F.lit(v)) for end, v in TYPES.items()], F.lit("text")))


def document_title(title: Column, file_name: Column) -> Column:
    """The title, or the file name where there is none."""
    return F.coalesce(F.when(T.trim(title) != "", T.trim(title)), file_name)
