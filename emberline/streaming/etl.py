"""Raw topic to lake, processed messages and rule anomalies, one micro-batch at a time."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.enrich import enrich, observe_counters
from ..schemas import LAKE_PARTITIONS, RAW_SCHEMA
from ..sinks import lake, topics as sink
from ..sources import topics
from ..sources.files import read_text, write_new, write_text


@dataclass(frozen=True)
class EtlTargets:
    """Where a batch goes. ``kafka`` sends the two message streams to topics instead of folders."""

    lake: str
    processed: str
    anomalies: str
    quarantine: str
    counters: str
    kafka: dict[str, str] | None = None


def utc_now() -> str:
    return datetime.now(tz=timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")


def batch_stamp(spark, folder: str, batch_id: int, clock: Callable[[], str]) -> str:
    """Time of a batch, written on its first run and read back when it is replayed."""
    path = f"{folder}/stamps/batch_id={batch_id}"
    write_new(spark, path, clock())
    return read_text(spark, path)


def process_batch(messages: DataFrame, batch_id: int, targets: EtlTargets, clock: Callable[[], str] = utc_now) -> None:
    """Fans one batch out. Every write overwrites its own batch folder, so a replay repeats nothing.

    Counters are observed while the lake is written, the first job that sees the rows: counting takes no job of its own.
    """
    spark = messages.sparkSession
    stamp = batch_stamp(spark, targets.counters, batch_id, clock)
    arrived, kept = Observation(), Observation()
    messages = messages.observe(
        arrived, F.count(F.lit(1)).alias("received"), F.count_if(topics.is_object(F.col("value"))).alias("read")).persist()
    rows = enrich(topics.decode(messages, RAW_SCHEMA), stamp, keys="_keys").drop("_keys")
    rows = observe_counters(rows, kept, F.size(F.collect_set(F.struct(*LAKE_PARTITIONS))).alias("files")).persist()
    try:
        lake.write_lake(rows, targets.lake, batch_id)
        sink.write_messages(sink.processed_messages(rows), targets.processed, targets.kafka, batch_id)
        published = sink.rule_anomaly_messages(rows, stamp.replace(" ", "T"))
        sink.write_messages(published, targets.anomalies, targets.kafka, batch_id)
        bad = topics.quarantine(messages).select("value", "reason")
        bad.write.mode("overwrite").json(f"{targets.quarantine}/batch_id={batch_id}")
        counted = {**arrived.get, **kept.get}
        told = {
            "records": counted["records"], "anomalies": counted["anomalies"],
            "anomaly_pct": 100.0 * counted["anomalies"] / counted["records"] if counted["records"] else None,
            "received": counted["received"], "quarantined": counted["received"] - counted["read"],
            "rejected": counted["read"] - counted["records"], "files": counted["files"],
        }
        write_text(spark, f"{targets.counters}/counts/batch_id={batch_id}/counts.json", json.dumps(told))
    finally:
        rows.unpersist()
        messages.unpersist()


def run_etl(messages: DataFrame, targets: EtlTargets, checkpoint: str, trigger: dict | None = None,
            clock: Callable[[], str] = utc_now) -> StreamingQuery:
    """Starts the stream. ``trigger={"availableNow": True}`` drains what is there and stops."""
    return (
        messages.writeStream.foreachBatch(lambda df, batch_id: process_batch(df, batch_id, targets, clock))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": f"{topics.BATCH_SECONDS} seconds"}))
        .start()
    )
