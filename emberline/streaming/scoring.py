"""Processed topic to anomaly messages: windows, model score, threshold, sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.scoring import Inputs, score_runs
from ..schemas import ENRICHED_SCHEMA
from ..sinks import topics as sink
from ..sources import topics
from ..sources.lake import with_event_time
from .windows import LATENESS, RECORD, stream_runs

IDLE_MINUTES = 24 * 60


def processed_rows(messages: DataFrame) -> DataFrame:
    """Enriched rows from processed messages, with their event time back as a timestamp."""
    return with_event_time(topics.decode(messages, ENRICHED_SCHEMA).drop("_keys"))


def score_stream(enriched: DataFrame, position: str, inputs: Inputs, model, threshold: float, computed_at: str,
                 lateness: str = LATENESS, idle_minutes: int | None = IDLE_MINUTES) -> DataFrame:
    """Anomaly payload rows of windows whose score exceeds the threshold."""
    runs = stream_runs(enriched, position, inputs.seq_len, lateness, idle_minutes)
    hits = score_runs(runs, inputs, model, threshold, ["source", "host"], RECORD)
    return sink.anomaly_payload(hits, threshold, computed_at).drop("label")


def run_scoring(enriched: DataFrame, position: str, inputs: Inputs, model, threshold: float, computed_at: str, target: str,
                checkpoint: str, trigger: dict | None = None, kafka: dict[str, str] | None = None,
                lateness: str = LATENESS, idle_minutes: int | None = IDLE_MINUTES) -> StreamingQuery:
    """Keys silent for ``idle_minutes`` of event time lose their kept rows, so state stays as large as what is active."""
    payload = sink.anomaly_messages(score_stream(enriched, position, inputs, model, threshold, computed_at, lateness, idle_minutes))
    writer = payload.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.trigger(**(trigger or {"processingTime": "1 second"}))
    if kafka:
        return writer.format("kafka").options(**{"kafka.acks": "all", **kafka}).option("topic", target).start()
    return writer.format("json").option("path", target).start()
