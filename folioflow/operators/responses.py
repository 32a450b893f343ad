"""Model responses and provider metadata: translations out of JSON, retry hints, costs, display forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import text as T


def json_part(text: Column) -> Column:
    """The JSON of a response: without fences, from the first brace to the last."""
    t = F.regexp_replace(text, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", "")
    return F.regexp_extract(t, r"(?s)\{.*\}", 0)


def translations(results: DataFrame) -> DataFrame:
    """(result_id, unit_id, text) of structured responses, in either shape; malformed ones give no row.

    results: result_id, text. Shapes: {"translations": [{"id", "text"}]} and
    {"<id>": "<text>"}. Blank translations are left out.
    """
    j = results.where("result_id IS NOT NULL").select("result_id", json_part(F.col("text")).alias("j"))
    listed = j.select("result_id", F.explode(F.from_json("j", "translations array<struct<id:string,text:string>>")["translations"]).alias("u")).select("result_id", F.col("u.id").alias("unit_id"), F.col("u.text").alias("text"))
    mapped = j.where(~F.col("j").rlike(r'"translations"\s*:\s*\[')).select("result_id", F.explode(F.from_json("j", "map<string,string>")).alias("unit_id", "text"))
    return listed.unionByName(mapped).where(F.col("unit_id").isNotNull() & (T.trim(F.coalesce("text", F.lit(""))) != "")).dropDuplicates(["result_id", "unit_id"])


def incomplete(calls: DataFrame, results: DataFrame) -> DataFrame:
    """(result_id, missing): how many units of its call a structured response lacks, if any."""
    want = calls.groupBy("call_id").agg(F.max("units").alias("units")).select("call_id", F.explode(F.array_distinct(F.transform("units", lambda u: u["id"]))).alias("unit_id"))
    got = translations(results)
    r = results.select("result_id", "call_id").distinct().join(want, "call_id").join(got.select("result_id", "unit_id", F.lit(1).alias("_got")), ["result_id", "unit_id"], "left")
    return r.groupBy("result_id").agg(F.count_if(F.col("_got").isNull()).alias("missing")).where("missing > 0")


def retry_after_ms(value: Column, now_ms: Column) -> Column:
    """Milliseconds of a Retry-After value: seconds, compact (1m30s, 250ms) or an HTTP date; null if it is none of them."""
    v = F.trim(value)
    seconds = F.when(v.rlike(r"^\d+(\.\d+)?$"), (v.cast("double") * 1000).cast("bigint"))
    unit = lambda u, k: F.coalesce(F.regexp_extract(v, rf"(\d+(?:\.\d+)?){u}(?![a-z])", 1).try_cast("double"), F.lit(0.0)) * k
    compact = F.when(v.rlike(r"^(\d+(\.\d+)?(h|ms|m|s))+$"), (unit("h", 3_600_000) + unit("m", 60_000) + unit("s", 1000) + unit("ms", 1)).cast("bigint"))
    at = F.unix_millis(F.try_to_timestamp(F.regexp_replace(v, r"^\w{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss")))
    date = F.when(at.isNotNull(), F.greatest(F.lit(0), at - now_ms))
    return F.coalesce(seconds, compact, date)


def cost(input_tokens: Column, output_tokens: Column, input_price: Column, output_price: Column) -> Column:
    """Cost by prices a million tokens, to four places; null without a price."""
    total = (F.coalesce(input_tokens, F.lit(0)) * F.coalesce(input_price, F.lit(0.0)) + F.coalesce(output_tokens, F.lit(0)) * F.coalesce(output_price, F.lit(0.0))) / F.lit(1e6)
    return F.when((F.coalesce(input_price, F.lit(0.0)) > 0) | (F.coalesce(output_price, F.lit(0.0)) > 0), F.floor(total * 10_000 + F.lit(0.5)) / 10_000)


def format_bytes(n: Column) -> Column:
    k = F.lit(1024.0)
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024**2, F.concat(F.format_number(n / k, 1), F.lit(" KB")))
        .when(n < 1024**3, F.concat(F.format_number(n / (k * k), 1), F.lit(" MB")))
        .otherwise(F.concat(F.format_number(n / (k * k * k), 1), F.lit(" GB")))
    )


def script_runs(text: Column) -> Column:
    """Maximal runs of Burmese and of other characters."""
    return F.regexp_extract_all(text, F.lit(r"[\x{1000}-\x{109F}\x{A9E0}-\x{A9FF}\x{AA60}-\x{AA7F}]+|[^\x{1000}-\x{109F}\x{A9E0}-\x{A9FF}\x{AA60}-\x{AA7F}]+"), F.lit(0))


#: Headers that tell a pool's limits, by the hint's name.
LIMIT_HEADERS = {"limit_rpm": "x-ratelimit-limit-requests", "remaining_requests": "x-ratelimit-remaining-requests", "limit_tpm": "x-ratelimit-limit-tokens", "remaining_tokens": "x-ratelimit-remaining-tokens"}


def reset_ms(value: Column, now_ms: Column) -> Column:
    """When a limit resets, in milliseconds since 1970: a compact duration (1h2m3s), seconds, a time in seconds, or a date; null for others."""
    v = F.trim(value)
    part = lambda unit: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(v, rf"(\d+){unit}", 1), F.lit("")), F.lit("999999999")).cast("bigint"), F.lit(0))
    compact = v.rlike(r"^(?:\d+h)?(?:\d+m)?(?:\d+s?)?$") & v.rlike(r"\d[hms]")
    tail = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(v, r"(\d+)s?$", 1), F.lit("")), F.lit("999999999")).cast("bigint"), F.lit(0))
    number = F.when(v.rlike(r"^\d+(\.\d+)?$"), v.cast("double"))
    date = F.coalesce(F.unix_millis(F.try_to_timestamp(v)), F.unix_millis(F.try_to_timestamp(F.regexp_replace(v, r"^\w+, ", ""), F.lit("dd MMM yyyy HH:mm:ss 'GMT'"))))
    return (
        F.when(compact, now_ms + part("h") * 3_600_000 + part("m") * 60_000 + tail * 1000)
        .when(number > 1_000_000_000, (number * 1000).cast("bigint"))
        .when(number.isNotNull(), (now_ms + number * 1000).cast("bigint"))
        .otherwise(date)
    )


def rate_hints(headers: Column, now_ms: Column) -> Column:
    """struct(retry_after_ms, limit_rpm, remaining_requests, limit_tpm, remaining_tokens) from a map of lower-case headers; what they don't say is null."""
    at = F.coalesce(reset_ms(headers["x-ratelimit-reset-requests"], now_ms), reset_ms(headers["x-ratelimit-reset"], now_ms))
    wait = F.coalesce(retry_after_ms(headers["retry-after"], now_ms), F.when(at.isNotNull(), F.greatest(F.lit(0), at - now_ms)))
    numbers = [F.when(F.trim(headers[h]).rlike(r"^-?\d+(\.\d+)?$"), F.trim(headers[h]).cast("double")).alias(k) for k, h in LIMIT_HEADERS.items()]
    return F.struct(wait.cast("bigint").alias("retry_after_ms"), *numbers)


def missing_glyphs(text: Column, covered: str) -> Column:
    """The distinct characters that a font with the class ``covered`` lacks, in order of first use; white space is never missing."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"[^{covered}\s]"), F.lit(0)))


#: Wordings with which a maker refuses an optional parameter of a request.
OUTPUT_PARAM = r"(?i)max[_\s-]*(?:output[_\s-]*)?(?:completion[_\s-]*)?tokens?|maximum(?:\s+number\s+of)?\s+tokens?|too many tokens|token limit"
FORMAT_PARAM = r"(?i)response[_\s-]?(?:format|mime)|json[_\s-]?(?:object|mode)|structured output|mime type"


def refused_parameter(error_class: Column, message: Column) -> Column:
    """output_tokens or response_format where a rejected request's message names it, else null."""
    m = F.coalesce(message, F.lit(""))
    return F.when(error_class == "rejected", F.when(m.rlike(OUTPUT_PARAM), "output_tokens").when(m.rlike(FORMAT_PARAM), "response_format"))
