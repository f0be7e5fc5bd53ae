"""Row layouts exchanged between the stages."""

from pyspark.sql import types as T

# The seven keys of a raw log entry, in message order.
ENTRY_FIELDS = ["timestamp", "source", "host", "level", "component", "message", "raw"]

RAW_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in ENTRY_FIELDS])

ENRICHED_SCHEMA = T.StructType(
    RAW_SCHEMA.fields
    + [
        T.StructField("year", T.IntegerType()),
        T.StructField("month", T.IntegerType()),
        T.StructField("day", T.IntegerType()),
        T.StructField("hour", T.IntegerType()),
        T.StructField("is_anomaly_candidate", T.BooleanType()),
        T.StructField("processed_at", T.StringType()),
    ]
)
ENRICHED_FIELDS = ENRICHED_SCHEMA.names
LAKE_PARTITIONS = ["source", "year", "month", "day"]

SEQUENCE_TYPE = T.ArrayType(
    T.StructType([T.StructField(name, T.StringType()) for name in ("timestamp", "level", "message")])
)

ANOMALY_SCHEMA = T.StructType([
    T.StructField("detected_at", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("host", T.StringType()),
    T.StructField("anomaly_score", T.DoubleType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("severity_ratio", T.DoubleType()),
    T.StructField("sequence", SEQUENCE_TYPE),
    T.StructField("model_version", T.StringType()),
])

# The same message as a board reads it: numbers may come as text, a message may stand in for the sequence.
ANOMALY_TEXT_SCHEMA = T.StructType(
    [T.StructField(f.name, T.StringType() if f.dataType == T.DoubleType() else f.dataType) for f in ANOMALY_SCHEMA.fields]
    + [T.StructField("message", T.StringType())]
)

FEEDBACK_SCHEMA = T.StructType([
    T.StructField(name, T.StringType())
    for name in ("timestamp", "feedback", "log_id", "source", "host", "message", "score_ia", "ratio", "statut")
])
