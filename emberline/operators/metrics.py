"""Infrastructure series (``ts``, ``metric``, labels, ``value``) aligned to fixed periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .windows import HOT_ROWS, count_windows

# --- Fixed values: periods, thresholds and durations of the declared alerts. ---
MEAN_SECONDS = 60
DELTA_SECONDS = 300
DISK_LIMIT_BYTES = 9116319744
DISK_DURATION_SECONDS = 120
RESTART_LIMIT = 3
# --- End of fixed values. ---


def period_start(ts: Column, seconds: int) -> Column:
    """Start of the period as epoch seconds."""
    return (F.floor(F.unix_seconds(ts.cast("timestamp")) / seconds) * seconds).cast("bigint")


def align_mean(points: DataFrame, series: list[str], seconds: int = MEAN_SECONDS) -> DataFrame:
    return points.groupBy(*series, period_start(F.col("ts"), seconds).alias("period")).agg(F.avg("value").alias("value"))


def increases(points: DataFrame, series: list[str], order: list[str], hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Adds ``increase`` since the previous point of the series; a counter reset counts as none."""
    points = points.select(*dict.fromkeys([*series, *order, "ts", "value"]))
    stepped = count_windows(
        points, lambda frame: {"_before": F.first("value").over(frame)}, order, series, size=2, full=False, hot_rows=hot_rows)
    # The first point of a series is its own predecessor, so it adds nothing.
    step = F.greatest(F.col("value") - F.col("_before"), F.lit(0.0))
    return stepped.withColumn("increase", F.coalesce(step, F.lit(0.0))).drop("_before")


def align_delta(points: DataFrame, series: list[str], order: list[str], seconds: int = DELTA_SECONDS,
                hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Increase of a counter per period."""
    grown = increases(points, series, order, hot_rows)
    return grown.groupBy(*series, period_start(F.col("ts"), seconds).alias("period")).agg(F.sum("increase").alias("value"))


def align_rate(points: DataFrame, series: list[str], order: list[str], seconds: int = MEAN_SECONDS,
               hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Increase of a counter per second."""
    return align_delta(points, series, order, seconds, hot_rows).withColumn("value", F.col("value") / seconds)


def disk_pressure(points: DataFrame, series: list[str], limit: float = DISK_LIMIT_BYTES, seconds: int = MEAN_SECONDS,
                  duration: int = DISK_DURATION_SECONDS) -> DataFrame:
    """Stretches in which the mean used bytes stay above the limit for the whole duration."""
    return sustained_alert(align_mean(points, series, seconds), series, limit, seconds, -(-duration // seconds))


def restart_alert(points: DataFrame, series: list[str], order: list[str], limit: float = RESTART_LIMIT,
                  seconds: int = DELTA_SECONDS, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Periods in which a restart counter grew by more than the limit, adjacent ones joined."""
    return sustained_alert(align_delta(points, series, order, seconds, hot_rows), series, limit, seconds)


def sustained_alert(aligned: DataFrame, series: list[str], threshold: float, seconds: int,
                    min_periods: int = 1) -> DataFrame:
    """Stretches of at least ``min_periods`` adjacent periods above ``threshold``.

    Works on aligned rows: a series has at most one row per period of its time span.
    """
    over = aligned.where(F.col("value") > threshold).withColumn("_i", F.floor(F.col("period") / seconds))
    place = F.row_number().over(W.partitionBy(*series).orderBy("_i"))
    return (
        over.withColumn("_run", F.col("_i") - place)
        .groupBy(*series, "_run")
        .agg(F.min("period").alias("first_period"), F.max("period").alias("last_period"),
             F.count("*").alias("periods"), F.max("value").alias("peak"))
        .where(F.col("periods") >= min_periods).drop("_run")
    )
