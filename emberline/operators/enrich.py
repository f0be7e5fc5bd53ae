"""Validation and enrichment of log entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..functions import levels, times
from ..schemas import ENTRY_FIELDS


def is_valid(keys: str | None = None) -> Column:
    """All seven keys present and a source given.

    ``keys`` names an array column of the keys a message had: a key that is
    present with a null value counts as present. Without it every column does.
    """
    has_source = F.coalesce(F.col("source") != "", F.lit(False))
    if keys is None:
        return has_source
    required = F.array(*[F.lit(name) for name in ENTRY_FIELDS])
    return has_source & (F.size(F.array_except(required, F.col(keys))) == 0)


def validate(entries: DataFrame, keys: str | None = None) -> DataFrame:
    return entries.where(is_valid(keys))


def rejected(entries: DataFrame, keys: str | None = None) -> DataFrame:
    return entries.where(~is_valid(keys))


def add_event_time(entries: DataFrame, batch_time: str, accept_offset: bool = False) -> DataFrame:
    """``event_time`` from the text, or ``batch_time`` (flagged) where it cannot be read."""
    parsed = times.parse_iso(F.col("timestamp"), accept_offset)
    return (
        entries.withColumn("event_time", parsed)
        .withColumn("timestamp_fallback", F.col("event_time").isNull())
        .withColumn("event_time", F.coalesce("event_time", F.lit(batch_time).cast("timestamp")))
    )


def enrich(entries: DataFrame, batch_time: str, processed_at: str | None = None, keys: str | None = None,
           accept_offset: bool = False) -> DataFrame:
    """Validated entries with UTC time, calendar columns, folded level and rule flag.

    One narrow stage, no shuffle. ``processed_at`` defaults to ``batch_time``:
    one stamp for the whole batch. ``event_time`` stays a timestamp for windows.
    """
    stamp = F.lit(processed_at) if processed_at else times.iso_utc(F.lit(batch_time).cast("timestamp"))
    timed = add_event_time(validate(entries, keys), batch_time, accept_offset)
    return timed.withColumns({
        "timestamp": times.iso_utc(F.col("event_time")),
        "level": levels.normalised_level(F.col("level")),
        "year": F.year("event_time"),
        "month": F.month("event_time"),
        "day": F.dayofmonth("event_time"),
        "hour": F.hour("event_time"),
        "is_anomaly_candidate": levels.is_candidate(levels.normalised_level(F.col("level"))),
        "processed_at": stamp,
    })


def rule_anomalies(enriched: DataFrame) -> DataFrame:
    return enriched.where("is_anomaly_candidate")


def batch_counters(enriched: DataFrame, *by: str) -> DataFrame:
    """Rows, rule anomalies and their percentage, optionally per group."""
    n = F.count("*")
    hits = F.count_if(F.col("is_anomaly_candidate"))
    return enriched.groupBy(*by).agg(
        n.alias("records"), hits.alias("anomalies"), (F.lit(100.0) * hits / F.nullif(n, F.lit(0))).alias("anomaly_pct"),
    )


def observe_counters(enriched: DataFrame, name: str | Observation = "etl", *more: Column) -> DataFrame:
    """The same counters, and ``more``, as metrics of the running query, without another pass: for an observation or a listener."""
    return enriched.observe(
        name, F.count(F.lit(1)).alias("records"), F.count_if(F.col("is_anomaly_candidate")).alias("anomalies"), *more)


def anomaly_rate(enriched: DataFrame, *by: str, totals: bool = False) -> DataFrame:
    """Share of rule anomalies per group; ``totals`` adds roll-up rows."""
    grouped = enriched.rollup(*by) if totals else enriched.groupBy(*by)
    return grouped.agg(
        F.count("*").alias("records"),
        F.count_if(F.col("is_anomaly_candidate")).alias("anomalies"),
        F.avg(F.col("is_anomaly_candidate").cast("double")).alias("anomaly_rate"),
    )
