"""Board tables kept up to date by a stream of anomaly messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import board as bd
from ..schemas import ANOMALY_TEXT_SCHEMA
from ..sources import topics
from ..sources.files import delete_path, list_folders, list_paths

LATENESS = "10 minutes"


def topic_arrival() -> Column:
    """Place of a topic's message as text that sorts by time, then partition, then offset, and that no two messages share."""
    def wide(number: Column, width: int) -> Column:
        return F.lpad(number.cast("string"), width, "0")

    return F.concat_ws("-", wide(F.unix_micros("timestamp"), 17), wide(F.col("partition"), 7), wide(F.col("offset"), 19))


def anomaly_rows(messages: DataFrame, arrival: Column | None = None) -> DataFrame:
    """Anomaly messages of a topic with their order of arrival; what is no JSON object is skipped.

    ``arrival`` replaces the place in the topic where messages come from elsewhere; it must be unique.
    """
    numbered = messages.withColumn("arrival", topic_arrival() if arrival is None else arrival)
    return topics.decode(numbered, ANOMALY_TEXT_SCHEMA).select("arrival", *ANOMALY_TEXT_SCHEMA.names)


def with_event_time(anomalies: DataFrame) -> DataFrame:
    return anomalies.withColumn("detected_time", F.col("detected_at").try_cast("timestamp"))


def dedup_stream(anomalies: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Drops repeats of (second, source, host, score); state is dropped after ``lateness``."""
    keyed = with_event_time(anomalies).withColumn("detected_second", F.substring("detected_at", 1, 19))
    return (
        keyed.withWatermark("detected_time", lateness)
        .dropDuplicatesWithinWatermark(["detected_second", "source", "host", "anomaly_score"]).drop("detected_second")
    )


def incident_stream(board: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """First row of each incident (time, host, message) among the anomalies of a board stream."""
    timed = board.where(bd.is_anomaly()).withColumn("incident_time", F.col("timestamp").try_cast("timestamp"))
    return timed.withWatermark("incident_time", lateness).dropDuplicatesWithinWatermark(bd.INCIDENT_KEY)


def windowed_counts(anomalies: DataFrame, period: str = "1 minute", lateness: str = LATENESS) -> DataFrame:
    """Messages, mean score and worst ratio per source and period, for update mode."""
    return (
        with_event_time(anomalies).withWatermark("detected_time", lateness)
        .groupBy(F.window("detected_time", period), "source")
        .agg(F.count("*").alias("n"), F.avg("anomaly_score").alias("mean_score"), F.max("severity_ratio").alias("worst_ratio"))
    )


def latest_version(spark, table: str, before: int | None = None) -> int | None:
    versions = {int(p.rsplit("version=", 1)[1].split("/")[0]) for p in list_paths(spark, f"{table}/version=*/part-*")}
    versions = [x for x in versions if before is None or x < before]
    return max(versions, default=None)


def read_board(spark, table: str) -> DataFrame:
    """The board as of the last finished batch."""
    return spark.read.parquet(f"{table}/version={latest_version(spark, table)}")


def update_board(rows: DataFrame, batch_id: int, table: str, n: int = bd.MAX_ROWS) -> None:
    """Newest ``n`` of the last version and this batch, with the running count of messages received.

    A version belongs to a batch: a replay rewrites it from the same predecessor. A version is one file, so it is there
    whole or not at all; of older ones only the predecessor is kept.
    """
    spark = rows.sparkSession
    before = latest_version(spark, table, batch_id)
    rows = rows.persist()
    merged, total = rows, rows.agg(F.count("*")).scalar()
    if before is not None:
        old = spark.read.parquet(f"{table}/version={before}")
        merged = old.drop("received").unionByName(rows)
        total = total + old.agg(F.coalesce(F.max("received"), F.lit(0))).scalar()
    newest = merged.orderBy(F.desc("arrival")).limit(n)
    newest.withColumn("received", total).coalesce(1).write.mode("overwrite").parquet(f"{table}/version={batch_id}")
    rows.unpersist()
    for folder in list_folders(spark, f"{table}/version=*"):
        if int(folder.rsplit("=", 1)[1]) < (batch_id if before is None else before):
            delete_path(spark, folder)


def run_board(board: DataFrame, table: str, checkpoint: str, trigger: dict | None = None, n: int = bd.MAX_ROWS) -> StreamingQuery:
    return (
        board.writeStream.foreachBatch(lambda df, batch_id: update_board(df, batch_id, table, n))
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "3 seconds"})).start()
    )
