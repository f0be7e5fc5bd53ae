"""Message sources: Kafka topics, or folders of JSON lines with the same columns.

A decoded message frame has ``key`` and ``value`` text columns in both cases, so
what follows does not know which one it reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# --- Fixed values: micro-batch bounds of the ETL consumer. ---
BATCH_ROWS = 500
BATCH_SECONDS = 30
# --- End of fixed values. ---

#: What one micro-batch takes at most, from topics and from folders, unless the caller says otherwise.
MAX_ROWS, MAX_FILES = 200_000, 64

MESSAGE_SCHEMA = "key string, value string"


def kafka_options(servers: str, topic: str, group: str | None = None, starting: str = "earliest",
                  min_rows: int | None = None, max_rows: int | None = MAX_ROWS,
                  max_delay_seconds: int | None = None) -> dict[str, str]:
    """Options of a Kafka stream; offsets are committed by the query's checkpoint."""
    out = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting}
    if group:
        out["kafka.group.id"] = group
    if min_rows:
        out["minOffsetsPerTrigger"] = str(min_rows)
    if max_rows:
        out["maxOffsetsPerTrigger"] = str(max_rows)
    if max_delay_seconds:
        out["maxTriggerDelay"] = f"{max_delay_seconds}s"
    return out


def raw_topic_options(servers: str, topic: str, group: str) -> dict[str, str]:
    """ETL flavour: from the start, a batch at 500 messages or 30 seconds."""
    return kafka_options(servers, topic, group, "earliest", min_rows=BATCH_ROWS, max_delay_seconds=BATCH_SECONDS)


def processed_topic_options(servers: str, topic: str, group: str) -> dict[str, str]:
    """Scoring flavour: only messages that arrive from now on."""
    return kafka_options(servers, topic, group, "latest")


def board_topic_options(servers: str, topic: str) -> dict[str, str]:
    """Board flavour: everything retained, in a group of its own per run."""
    return kafka_options(servers, topic, None, "earliest")


def stream_kafka(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    df = spark.readStream.format("kafka").options(**options).load()
    return df.select(F.col("key").cast("string"), F.col("value").cast("string"), "partition", "offset", "timestamp")


def stream_folder(spark: SparkSession, path: str, files_per_batch: int = MAX_FILES) -> DataFrame:
    """Same columns as a topic, from a folder of JSON lines ``{"key":..,"value":..}``."""
    return spark.readStream.schema(MESSAGE_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(path)


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MESSAGE_SCHEMA).json(path)


def is_object(value: Column) -> Column:
    """True for a well-formed JSON object (listing its keys reads all of it)."""
    return F.json_object_keys(value).isNotNull()


def decode(messages: DataFrame, schema: T.StructType, value: str = "value") -> DataFrame:
    """Well-formed objects, with their fields as columns and ``_keys`` the keys present."""
    kept = [c for c in messages.columns if c not in (*schema.names, "key", value)]
    # a generator, so that filter and projection share one parse for the keys and one for the fields
    read = F.array(F.struct(F.json_object_keys(value).alias("_keys"), F.from_json(value, schema).alias("_doc")))
    return messages.select(*kept, F.inline(F.filter(read, lambda r: r["_keys"].isNotNull()))).select(*kept, "_doc.*", "_keys")


def quarantine(messages: DataFrame, value: str = "value") -> DataFrame:
    """Messages that are not JSON objects, with the reason; they never stop the stream."""
    reason = F.when(F.col(value).isNull(), F.lit("empty")).when(
        F.try_parse_json(value).isNull(), F.lit("malformed")).otherwise(F.lit("not an object"))
    return messages.where(~is_object(F.col(value))).withColumn("reason", reason)
