"""Streaming twins: daily usage by event time, and key health as keyed state."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Cooldowns in milliseconds (first, most), failures that degrade a key, window of quota hits, age and number of events kept.
RATE, QUOTA, SERVER = (5_000, 300_000), (900_000, 21_600_000), (10_000, 300_000)
DEGRADED_AT, WINDOW_MS, AGE_MS, KEPT = 3, 60_000, 600_000, 120


def daily_stream(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Requests and tokens by provider and day of a stream of (provider, at, output_tokens); for update or complete mode."""
    at = F.col("at").cast("timestamp")
    return (
        events.withColumn("at", at).withWatermark("at", late).groupBy(F.window("at", "1 day").alias("w"), "provider").agg(F.count("*").alias("requests"), F.sum(F.coalesce("output_tokens", F.lit(0))).cast("bigint").alias("output_tokens")).select(F.col("w.start").alias("day"), "provider", "requests", "output_tokens")
    )


START = {"health": "healthy", "cooldown_until": 0, "reason": None, "hits": 0, "requests": 0, "failed": 0, "events": ()}
SCHEMA = "key_id string, health string, cooldown_until bigint, reason string, hits int, requests int, failed int"


def backoff(attempt: int, bounds: tuple[int, int], u: float) -> int:
    """Half of the doubled first wait, and ``u`` of the other half."""
    most = min(bounds[1], bounds[0] * 2 ** min(max(0, attempt), 30))
    return max(1, math.floor(most / 2 + u * most / 2 + 0.5))


def advance(state: dict, at: int, outcome: str, retry_after: int | None = None, u: float = 0.5) -> dict:
    """The state of a key after one outcome: ok, rate_limit, quota_exceeded, server_error, auth, or any other failure, which only counts.

    A success heals. A rate limit cools by the number of limits so far or as
    long as the provider says; a quota by the quota hits of the last minute; a
    server error by the failures in a row, and degrades the key from the third
    on; a rejected key is invalid at once and not cooled.
    """
    events = [e for e in (*state["events"], (at, outcome)) if e[0] >= at - AGE_MS][-KEPT:]
    s = state | {"events": tuple(events), "requests": state["requests"] + 1}
    if outcome == "ok":
        return s | {"health": "healthy", "cooldown_until": 0, "reason": None}
    s["failed"] += 1
    row = next((i for i, e in enumerate(reversed(events)) if e[1] == "ok"), len(events))
    wait = None
    if outcome == "rate_limit":
        s["hits"] += 1
        wait = max(retry_after or 0, backoff(min(s["hits"], 6), RATE, u))
    elif outcome == "quota_exceeded":
        s["hits"] += 1
        again = sum(e[1] == "quota_exceeded" and e[0] >= at - WINDOW_MS for e in events)
        wait = min(max(QUOTA[0] * 2 ** min(max(again - 1, 0), 4), retry_after or 0), QUOTA[1])
    elif outcome == "server_error":
        wait = backoff(min(row, 6), SERVER, u)
        if row >= DEGRADED_AT:
            s["health"] = "degraded"
    elif outcome == "auth":
        return s | {"health": "invalid", "cooldown_until": 0, "reason": "auth"}
    if wait is not None:
        s |= {"cooldown_until": at + wait, "reason": "quota" if outcome == "quota_exceeded" else outcome}
    return s


def key_health_batch(events: DataFrame, u: float = 0.5) -> DataFrame:
    """The fold of advance() over each key's (at_ms, id, outcome, retry_after_ms), in closed form; u is the jitter.

    What set the cooldown is the last event that can; its waits follow from
    counts up to it, so aggregations suffice and no key's events are sorted.
    Failures in a row are counted in buckets of AGE_MS with the one before as
    context, so that a hot key is many tasks. Of the quota hits of a minute
    all count, also where more than KEPT events lie between. Null keys, times
    and outcomes give no row.
    """
    c = F.col
    e = events.where("key_id IS NOT NULL AND at_ms IS NOT NULL AND outcome IS NOT NULL").select("key_id", "at_ms", "id", "outcome", c("retry_after_ms").cast("bigint").alias("retry"), F.struct("at_ms", "id").alias("o"))
    hit = c("outcome").isin("rate_limit", "quota_exceeded")
    setter = c("outcome").isin("ok", "rate_limit", "quota_exceeded", "server_error", "auth")
    keys = e.groupBy("key_id").agg(
        F.max(F.when(c("outcome") == "ok", c("o"))).alias("ok"), F.max(F.when(setter, F.struct("o", "outcome", "retry"))).alias("last"), F.count_if(hit).cast("int").alias("hits"),
        F.count("*").cast("int").alias("requests"), F.count_if(c("outcome") != "ok").cast("int").alias("failed"),
    )
    j = e.join(keys.select("key_id", "ok", "last"), "key_id")
    since = c("ok").isNull() | (c("o") > c("ok"))
    upto = c("o") <= c("last.o")
    counts = j.groupBy("key_id").agg(
        F.count_if(upto & hit).alias("n_hits"),
        F.count_if(upto & (c("outcome") == "quota_exceeded") & (c("at_ms") >= c("last.o.at_ms") - WINDOW_MS)).alias("n_quota"),
        F.count_if(upto & since & (c("outcome") != "ok") & (c("at_ms") >= c("last.o.at_ms") - AGE_MS)).alias("n_row"),
        F.max(F.when(since & (c("outcome") == "auth"), c("o"))).alias("auth"),
    )
    # the last server error that came third in a row or later
    bad = j.where(since & (c("outcome") != "ok")).select("key_id", "at_ms", "id", "o", "outcome", F.floor(c("at_ms") / AGE_MS).alias("b"))
    near = bad.withColumn("b", F.explode(F.array(F.struct(c("b"), F.lit(True).alias("own")), F.struct((c("b") + 1).alias("b"), F.lit(False).alias("own")))))
    w = Window.partitionBy("key_id", "b.b")
    row = F.count("*").over(w.orderBy("at_ms").rangeBetween(-AGE_MS, 0)) - F.row_number().over(Window.partitionBy("key_id", "b.b", "at_ms").orderBy(F.desc("id"))) + 1
    third = near.withColumn("row", row).where(c("b.own") & (c("outcome") == "server_error") & (c("row") >= DEGRADED_AT)).groupBy("key_id").agg(F.max("o").alias("degraded"))

    def wait(n, bounds):
        most = F.least(F.lit(float(bounds[1])), F.lit(float(bounds[0])) * F.pow(F.lit(2.0), F.least(n, F.lit(6))))
        return F.greatest(F.lit(1), F.floor(most / 2 + F.lit(u) * most / 2 + F.lit(0.5)))

    what, retry = c("last.outcome"), F.coalesce(c("last.retry"), F.lit(0))
    cool = (
        F.when(what == "rate_limit", F.greatest(retry, wait(c("n_hits"), RATE)))
        .when(what == "quota_exceeded", F.least(F.greatest(F.lit(float(QUOTA[0])) * F.pow(F.lit(2.0), F.least(F.greatest(c("n_quota") - 1, F.lit(0)), F.lit(4))), retry), F.lit(QUOTA[1])))
        .when(what == "server_error", wait(c("n_row"), SERVER))
    )
    health = F.when(c("auth").isNotNull() & (c("degraded").isNull() | (c("auth") > c("degraded"))), "invalid").when(c("degraded").isNotNull(), "degraded").otherwise("healthy")
    reason = F.when(what == "quota_exceeded", "quota").when(what != "ok", what)
    return keys.join(counts, "key_id").join(third, "key_id", "left").select("key_id", health.alias("health"), F.coalesce((c("last.o.at_ms") + cool).cast("bigint"), F.lit(0)).alias("cooldown_until"), reason.alias("reason"), "hits", "requests", "failed")


def key_health_stream(events: DataFrame) -> DataFrame:
    """The same fold over a stream, a row for each key of each batch; for update mode."""

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        s = json.loads(state.get[0]) if state.exists else dict(START)
        for e in pd.concat(list(batches)).sort_values(["at_ms", "id"]).itertuples():
            s = advance(s | {"events": tuple(map(tuple, s["events"]))}, int(e.at_ms), e.outcome, None if pd.isna(e.retry_after_ms) else int(e.retry_after_ms))
        state.update((json.dumps(s),))
        yield pd.DataFrame([{"key_id": key[0], **{k: v for k, v in s.items() if k != "events"}}])

    return events.groupBy("key_id").applyInPandasWithState(step, SCHEMA, "state string", "update", "NoTimeout")
