"""Key/value messages for topics, and where they go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import times
from ..schemas import ENRICHED_FIELDS, ENTRY_FIELDS, FEEDBACK_SCHEMA

KEEP_NULLS = {"ignoreNullFields": "false"}


def as_message(df: DataFrame, key: str | Column, fields: list[str], *keep: str) -> DataFrame:
    """One ``key``, ``value`` row per input row, with the columns ``keep``; nulls stay in the JSON."""
    return df.select(
        (F.col(key) if isinstance(key, str) else key).alias("key"),
        F.to_json(F.struct(*fields), KEEP_NULLS).alias("value"),
        *keep,
    )


def raw_messages(entries: DataFrame) -> DataFrame:
    return as_message(entries, "source", ENTRY_FIELDS)


def processed_messages(enriched: DataFrame) -> DataFrame:
    return as_message(enriched, "source", ENRICHED_FIELDS)


def rule_anomaly_messages(enriched: DataFrame, published_at: str) -> DataFrame:
    """Rule anomalies keyed by level, all with the publishing time of their batch."""
    hits = enriched.where("is_anomaly_candidate").withColumn("anomaly_published_at", F.lit(published_at))
    return as_message(hits, "level", [*ENRICHED_FIELDS, "anomaly_published_at"])


ANOMALY_FIELDS = [
    "detected_at", "source", "host", "anomaly_score", "threshold", "severity_ratio", "sequence", "model_version",
]


def model_version(computed_at: str | Column) -> Column:
    """``lstm_v1_`` and the day the model was fitted."""
    stamp = F.lit(computed_at) if isinstance(computed_at, str) else computed_at
    return F.concat(F.lit("lstm_v1_"), F.replace(F.substring(stamp, 1, 10), F.lit("-"), F.lit("")))


def anomaly_payload(scored: DataFrame, threshold: float, computed_at: str, detected_at: Column | None = None,
                    sequence: str = "sequence", score: str = "score") -> DataFrame:
    """Anomaly rows from scored windows; source and host, the key of a window, are its last row's."""
    when = detected_at if detected_at is not None else times.iso_utc(F.current_timestamp())
    kept = [c for c in scored.columns if c not in (*ANOMALY_FIELDS, sequence, score)]
    ratio = F.round(F.col(score) / F.lit(threshold), 3) if threshold > 0 else F.lit(0.0)
    return scored.select(
        *kept,
        when.alias("detected_at"),
        F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce("host", F.lit("")).alias("host"),
        F.round(score, 6).alias("anomaly_score"),
        F.round(F.lit(float(threshold)), 6).alias("threshold"),
        ratio.alias("severity_ratio"),
        F.transform(
            sequence,
            lambda r: F.struct(*[F.coalesce(r[c], F.lit("")).alias(c) for c in ("timestamp", "level", "message")]),
        ).alias("sequence"),
        model_version(computed_at).alias("model_version"),
    )


def anomaly_messages(payload: DataFrame) -> DataFrame:
    return as_message(payload, F.when(F.col("source") == "", F.lit("unknown")).otherwise(F.col("source")), ANOMALY_FIELDS)


def write_messages(messages: DataFrame, target: str, kafka: dict[str, str] | None = None,
                   batch_id: int | None = None) -> None:
    """To topic ``target`` when Kafka options are given, else to a folder of JSON lines.

    With ``batch_id`` the folder of that batch is overwritten, so a replay adds nothing.
    """
    if kafka:
        messages.write.format("kafka").options(**{"kafka.acks": "all", **kafka}).option("topic", target).save()
    elif batch_id is None:
        messages.write.mode("append").json(target)
    else:
        messages.write.mode("overwrite").json(f"{target}/batch_id={batch_id}")


def append_feedback(records: DataFrame, path: str) -> None:
    """Adds feedback records to an append-only table of JSON lines."""
    records.select(*FEEDBACK_SCHEMA.names).write.mode("append").option("ignoreNullFields", "false").json(path)
