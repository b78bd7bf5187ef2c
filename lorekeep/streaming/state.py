"""Keyed state of the crawler as Structured Streaming operators, and batch forms of them.

Throttle: a host's delay jumps up to what its latency asks for, decays by a
quarter of the gap, doubles on 429 and 503. Breaker: a provider that fails
three times in a row rests for fifteen minutes. Both are functions of the
previous state and one event, used by applyInPandasWithState in streams.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.plans.registry import query
from lorekeep.sources.tables import table

LEAST_MS, MOST_MS = 250.0, 60_000.0
FAILURES, REST_S = 3, 900


def next_delay(delay: float, latency_ms: float, status: int, retry_after_ms: float | None = None) -> float:
    if retry_after_ms is not None:
        return min(retry_after_ms, MOST_MS)
    if status in (429, 503):
        return min(delay * 2, MOST_MS)
    target = max(LEAST_MS, latency_ms)
    return min(target if target > delay else delay - 0.25 * (delay - target), MOST_MS)


def next_breaker(failures: int, open_until: float, at_s: float, ok: bool) -> tuple[int, float, bool]:
    """(failures, open until, whether the call is let through)."""
    if at_s < open_until:
        return failures, open_until, False
    if ok:
        return 0, 0.0, True
    failures += 1
    return (0, at_s + REST_S, True) if failures >= FAILURES else (failures, 0.0, True)


THROTTLE_OUT = "host string, event_id bigint, delay_ms double"
BREAKER_OUT = "provider string, event_id bigint, allowed boolean, failures int"


def throttle_rows(host: str, delay: float, events: pd.DataFrame) -> tuple[float, pd.DataFrame]:
    rows = []
    for e in events.sort_values(["at_s", "event_id"]).itertuples(index=False):
        delay = next_delay(delay, e.latency_ms, e.status)
        rows.append((host, e.event_id, round(delay, 6)))
    return delay, pd.DataFrame(rows, columns=["host", "event_id", "delay_ms"])


def breaker_rows(provider: str, state: tuple[int, float], events: pd.DataFrame) -> tuple[tuple[int, float], pd.DataFrame]:
    failures, until = state
    rows = []
    for e in events.sort_values(["at_s", "event_id"]).itertuples(index=False):
        failures, until, allowed = next_breaker(failures, until, e.at_s, e.status < 500)
        rows.append((provider, e.event_id, allowed, failures))
    return (failures, until), pd.DataFrame(rows, columns=["provider", "event_id", "allowed", "failures"])


def throttle_stream(events: DataFrame) -> DataFrame:
    """Stream (host, event_id, at_s, latency_ms, status) -> delay after each event."""

    def step(key: tuple, batches: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        delay = state.get[0] if state.exists else LEAST_MS
        delay, out = throttle_rows(key[0], delay, pd.concat(list(batches)))
        state.update((delay,))
        yield out

    return events.groupBy("host").applyInPandasWithState(step, THROTTLE_OUT, "delay double", "append", "NoTimeout")


def breaker_stream(events: DataFrame) -> DataFrame:
    """Stream (provider, event_id, at_s, status) -> whether each call is let through."""

    def step(key: tuple, batches: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else (0, 0.0)
        now, out = breaker_rows(key[0], now, pd.concat(list(batches)))
        state.update(now)
        yield out

    return events.groupBy("provider").applyInPandasWithState(step, BREAKER_OUT, "failures int, until double", "append", "NoTimeout")


def dedup_stream(reads: DataFrame, ttl: str = "12 hours") -> DataFrame:
    """First reads only, by mission, tool and target; state goes after the watermark."""
    return reads.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["mission", "tool", "id"])


def crawl_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_id") % 11 == 0, 429).when(F.col("event_id") % 13 < 4, 503).otherwise(200)
    return e.select(F.concat(F.lit("h"), (F.col("user_id") % 25).cast("string")).alias("host"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at_s"), (F.col("value") * 10).alias("latency_ms"), status.alias("status"))


@query(None)
def throttle_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-THROTTLE over the whole history in one batch."""
    return crawl_events(spark, sf_dir).groupBy("host").applyInPandas(lambda key, p: throttle_rows(key[0], LEAST_MS, p)[1], THROTTLE_OUT)


@query(None)
def breaker_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-BREAKER over the whole history in one batch."""
    return crawl_events(spark, sf_dir).withColumnRenamed("host", "provider").groupBy("provider").applyInPandas(lambda key, p: breaker_rows(key[0], (0, 0.0), p)[1], BREAKER_OUT)
