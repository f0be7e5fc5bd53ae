"""Log data derived from the given tables, in Spark and as SQL with the same rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import times
from ..operators import board as bd, enrich as en, features as ft, scoring, windows as wd
from ..schemas import ENTRY_FIELDS
from ..session import dealt
from ..sinks.topics import anomaly_payload

BATCH_TIME = "2024-02-01 00:00:00"
BATCH_ISO = "2024-02-01T00:00:00+00:00"
REFERENCE_YEAR = 2024
THRESHOLD = 0.763474
ORDER = ["event_time", "event_id"]
SOURCE_ORDER = ["linux", "ssh", "hadoop", "spark", "supercomputer", "hdfs", "android"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def _message() -> Column:
    kind = F.col("event_type")
    lead = (
        F.when(kind == "error", "Authentication failed for invalid user").when(kind == "purchase", "Connection timeout")
        .when(kind == "signup", "session opened for").when(kind == "view", "debug trace by")
        .otherwise("Accepted request by")
    )
    return F.concat(lead, F.lit(" user=u"), F.col("user_id"), F.lit(" from 10.0."), F.col("user_id") % 256, F.lit("."),
                    F.col("event_id") % 256)


def _source() -> Column:
    out = F
    for i, name in enumerate(SOURCE_ORDER[:-1]):
        out = out.when(F.col("user_id") % 7 == i, F.lit(name))
    return F.when(F.col("event_id") % 97 == 0, F.lit("")).otherwise(out.otherwise(F.lit(SOURCE_ORDER[-1])))


def raw_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_logs_of(events(spark, sf_dir))


def raw_logs_of(event_rows: DataFrame, keep: list[str] = ()) -> DataFrame:
    e, kind = F.col("event_id"), F.col("event_type")
    stamp = (
        F.when(e % 101 == 0, F.lit("not-a-time"))
        .when(e % 13 == 0, F.concat(times.iso_seconds(F.col("ts")), F.lit("Z")))
        .when(e % 7 == 0, times.iso_seconds(F.col("ts")))
        .otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    )
    level = (
        F.when((kind == "error") & (F.col("value") > 150), F.lit("fatal")).when(kind == "error", F.lit("ERROR"))
        .when(kind == "purchase", F.lit("WARNING")).when(kind == "view", F.lit("debug")).otherwise(F.lit("INFO"))
    )
    rows = event_rows.select(
        *keep, "event_id", "value", stamp.alias("timestamp"), _source().alias("source"),
        F.concat(F.lit("host-"), "user_id").alias("host"), level.alias("level"), kind.alias("component"),
        _message().alias("message"))
    return rows.withColumn("raw", F.concat_ws(" ", "timestamp", "level", "component", "message"))


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return en.enrich(raw_logs(spark, sf_dir), BATCH_TIME)


def dealt_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows, dealt over all tasks before they are parsed: for vectors and models, whose work is in the rows and not in the bytes."""
    return en.enrich(raw_logs_of(dealt(events(spark, sf_dir), "event_id", "user_id", "ts")), BATCH_TIME)


def scored_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled windows with a score made from the last row's value."""
    labelled = wd.window_labels(enriched(spark, sf_dir), ORDER, keep=["value"])
    return labelled.withColumn("score", F.col("value") / 50)


def ml_anomalies(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    score = F.col("value") / 50
    rows = dealt_enriched(spark, sf_dir) if spread else enriched(spark, sf_dir)
    found = scoring.hit_windows(rows, ORDER, score > THRESHOLD, ["timestamp", "level", "message"], keep=["value"])
    hits = found.select("source", "host", F.col("event_id").alias("arrival"), "sequence", score.alias("score"))
    return anomaly_payload(hits, THRESHOLD, BATCH_ISO, detected_at=F.element_at("sequence", -1)["timestamp"])


RULE_THRESHOLD = 0.25


class ErrorShare:
    """A scorer of windows that SQL can state too: the share of rows at level ERROR."""

    def errors(self, windows: np.ndarray) -> np.ndarray:
        return windows[:, :, len(ft.SOURCES) + ft.LEVELS.index("ERROR")].astype(np.float64).mean(axis=1)


def rule_scorer(spark: SparkSession, sf_dir: str):
    """Inputs of production (vocabulary and embeddings of all messages), unscaled, and the scorer above."""
    return scoring.Inputs(ft.collect_encoder(ft.build_vocabulary(enriched(spark, sf_dir))), None), ErrorShare()


def board(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    return bd.board_rows(ml_anomalies(spark, sf_dir, spread))


def json_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = {"ignoreNullFields": "false"}
    e = F.col("event_id")
    value = (
        F.when(e % 83 == 0, F.lit("{bad")).when(e % 79 == 0, F.lit("[1]"))
        .when(e % 89 == 0, F.to_json(F.struct(*ENTRY_FIELDS[:-1]), keep))
        .otherwise(F.to_json(F.struct(*ENTRY_FIELDS), keep))
    )
    return raw_logs(spark, sf_dir).select("event_id", value.alias("value"))


def infra_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gauge and a counter (set back every 500 events) per resource."""
    return events(spark, sf_dir).select(
        "event_id", "ts", (F.col("user_id") % 4).alias("resource"), F.col("value").alias("gauge"),
        (F.col("event_id") % 500).cast("double").alias("counter"))


def feedback(board_rows: DataFrame) -> DataFrame:
    voted = board_rows.where(F.col("arrival") % 10 == 0)
    vote = F.when(F.col("arrival") % 3 != 0, F.lit("positive")).otherwise(F.lit("negative"))
    return bd.feedback_records(voted, vote, F.lit(BATCH_ISO))


def syslog_lines(spark: SparkSession, sf_dir: str, program: str = "kernel") -> DataFrame:
    """Syslog text with blank lines and stack traces among it."""
    e = F.col("event_id")
    line = F.concat(
        F.date_format("ts", "MMM"), F.lit(" "), F.lpad(F.dayofmonth("ts").cast("string"), 2, " "), F.lit(" "),
        F.date_format("ts", "HH:mm:ss"), F.lit(" host-"), F.col("user_id"), F.lit(f" {program}["), e, F.lit("]: "), _message(),
        F.when(e % 5 == 0, F.lit("\t ")).otherwise(F.lit("")))
    value = F.when(e % 17 == 0, F.lit("   ")).when(e % 19 == 0, F.lit("java.lang.Exception: boom")).otherwise(line)
    return events(spark, sf_dir).select("event_id", value.alias("value"))


def java_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    level = F.element_at(F.array(*[F.lit(x) for x in ("INFO", "WARN", "ERROR", "FATAL", "DEBUG")]), (e % 5 + 1).cast("int"))
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS "), level, F.lit(" [main] org.x."), F.col("event_type"),
                    F.lit(": "), _message())
    value = F.when(e % 19 == 0, F.lit("  at org.x.Main.run(Main.java:7)")).otherwise(line)
    return events(spark, sf_dir).select("event_id", F.concat(F.lit("app-"), F.col("user_id") % 9).alias("host"), value.alias("value"))


def bgl_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    names = ("info", "WARN", "Warning", "ERROR", "FATAL", "severe")
    level = F.element_at(F.array(*[F.lit(x) for x in names]), (e % 6 + 1).cast("int"))
    node = F.concat(F.lit("R"), F.col("user_id") % 64)
    line = F.concat(
        F.when(e % 11 == 0, F.lit("APPREAD")).otherwise(F.lit("-")), F.lit(" 1117838570 2005.06.03 "), node, F.lit(" "),
        F.date_format("ts", "yyyy-MM-dd-HH.mm.ss.SSSSSS"), F.lit(" "), node, F.lit(" RAS KERNEL "), level, F.lit(" "), _message())
    return events(spark, sf_dir).select("event_id", line.alias("value"))


def android_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    letter = F.element_at(F.array(*[F.lit(x) for x in "VDIWEF"]), (e % 6 + 1).cast("int"))
    line = F.concat(F.date_format("ts", "MM-dd HH:mm:ss.SSS"), F.lit("  1234  5678 "), letter, F.lit(" "), F.col("event_type"),
                    F.when(e % 2 == 0, F.lit(" ")).otherwise(F.lit("")), F.lit(": "), _message())
    value = F.when(e % 19 == 0, F.lit("--------- beginning of main")).otherwise(line)
    return events(spark, sf_dir).select("event_id", value.alias("value"))


TRACE_EVENTS = ["click", "error", "purchase", "signup", "view", "slow", "cheap"]


def trace_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event counts per user and day as text cells, some of them empty or no numbers."""
    kinds = {name: F.col("event_type") == name for name in TRACE_EVENTS[:5]}
    kinds |= {"slow": F.col("value") > 100, "cheap": F.col("value") < 10}
    by = [F.col("user_id"), F.dayofmonth("ts").alias("day")]
    counts = events(spark, sf_dir).groupBy(*by).agg(*[F.count_if(c).alias(n) for n, c in kinds.items()])
    cells = {name: F.concat(F.col(name).cast("string"), F.lit(".0")) for name in TRACE_EVENTS}
    cells["click"] = F.when(F.col("user_id") % 5 == 0, F.lit("n/a")).otherwise(cells["click"])
    return counts.select(F.concat_ws("-", "user_id", "day").alias("TaskID"), (F.col("user_id") % 2 == 0).alias("failed"),
                         *[cells[n].alias(n) for n in TRACE_EVENTS])


# ---- The same views as SQL -------------------------------------------------

_SQL_MESSAGE = """concat(CASE event_type WHEN 'error' THEN 'Authentication failed for invalid user' WHEN 'purchase' THEN 'Connection timeout'
  WHEN 'signup' THEN 'session opened for' WHEN 'view' THEN 'debug trace by' ELSE 'Accepted request by' END,
  ' user=u', user_id, ' from 10.0.', user_id % 256, '.', event_id % 256)"""

SQL_EVENTS = f"ev AS (SELECT *, {_SQL_MESSAGE} AS message FROM events)"

SQL_RAW = f"""{SQL_EVENTS}, raw_logs AS (SELECT *, concat_ws(' ', timestamp, level, component, message) AS raw FROM (
 SELECT event_id, value, CASE WHEN event_id % 101 = 0 THEN 'not-a-time'
   WHEN event_id % 13 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN event_id % 7 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
   ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS timestamp,
  CASE WHEN event_id % 97 = 0 THEN '' ELSE CASE user_id % 7 WHEN 0 THEN 'linux' WHEN 1 THEN 'ssh' WHEN 2 THEN 'hadoop'
   WHEN 3 THEN 'spark' WHEN 4 THEN 'supercomputer' WHEN 5 THEN 'hdfs' ELSE 'android' END END AS source,
  concat('host-', user_id) AS host,
  CASE WHEN event_type = 'error' AND value > 150 THEN 'fatal' WHEN event_type = 'error' THEN 'ERROR'
   WHEN event_type = 'purchase' THEN 'WARNING' WHEN event_type = 'view' THEN 'debug' ELSE 'INFO' END AS level,
  event_type AS component, message FROM ev))"""


def sql_iso_local(ts: str) -> str:
    return (f"concat(strftime({ts}, '%Y-%m-%dT%H:%M:%S'), CASE WHEN strftime({ts}, '%f') = '000000' THEN '' "
            f"ELSE concat('.', strftime({ts}, '%f')) END)")


SQL_ENRICHED = f"""{SQL_RAW}, parsed AS (SELECT *, CASE WHEN timestamp <> 'not-a-time' THEN CAST(replace(timestamp, 'Z', '') AS TIMESTAMP) END AS p
  FROM raw_logs WHERE source <> ''),
timed AS (SELECT * EXCLUDE (timestamp, level, p), coalesce(p, TIMESTAMP '{BATCH_TIME}') AS event_time, p IS NULL AS timestamp_fallback,
  CASE WHEN upper(level) = 'WARNING' THEN 'WARN' ELSE upper(level) END AS level FROM parsed),
enriched AS (SELECT *, concat({sql_iso_local('event_time')}, '+00:00') AS timestamp,
  CAST(year(event_time) AS INTEGER) AS year, CAST(month(event_time) AS INTEGER) AS month, CAST(day(event_time) AS INTEGER) AS day,
  CAST(hour(event_time) AS INTEGER) AS hour, level IN ('ERROR', 'FATAL') AS is_anomaly_candidate, '{BATCH_ISO}' AS processed_at FROM timed)"""

SQL_WINDOWS = f"""{SQL_ENRICHED}, wins AS (SELECT * FROM (SELECT *, value / 50 AS score, first_value(event_id) OVER w AS first_id,
  count(*) OVER w AS window_rows, bool_or(is_anomaly_candidate) OVER w AS label FROM enriched
  WINDOW w AS (PARTITION BY source, host ORDER BY event_time, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) WHERE window_rows = 10)"""

SQL_ANOMALIES = f"""{SQL_WINDOWS}, anomalies AS (SELECT event_id AS arrival, timestamp AS detected_at, source, host,
  round(score, 6) AS anomaly_score, CAST({THRESHOLD} AS DOUBLE) AS threshold, round(score / CAST({THRESHOLD} AS DOUBLE), 3) AS severity_ratio,
  message, 'lstm_v1_20240201' AS model_version FROM wins WHERE score > {THRESHOLD})"""


SQL_RULE_HITS = f"""WITH {SQL_ENRICHED}, rw AS (SELECT *, count(*) OVER w AS window_rows, CAST(count(*) FILTER (WHERE level = 'ERROR') OVER w AS DOUBLE) / 10 AS share,
  list(message) OVER w AS messages FROM enriched WINDOW w AS (PARTITION BY source, host ORDER BY event_time, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT source, host, round(share, 6) AS anomaly_score, round(share / CAST({RULE_THRESHOLD} AS DOUBLE), 3) AS severity_ratio, array_to_string(messages, '|') AS messages
FROM rw WHERE window_rows = 10 AND share > {RULE_THRESHOLD}"""


def sql_two_digits(x: str) -> str:
    return f"CAST(CAST(round(CAST({x} AS DECIMAL(18, 6)), 2) AS DECIMAL(18, 2)) AS VARCHAR)"


SQL_BOARD = f"""{SQL_ANOMALIES}, board AS (SELECT arrival, concat(detected_at, '_', arrival) AS id,
  replace(substr(detected_at, 1, 19), 'T', ' ') AS timestamp, source, host, substr(message, 1, 240) AS message,
  anomaly_score AS score, severity_ratio AS ratio, threshold, {sql_two_digits('anomaly_score')} AS score_text,
  concat({sql_two_digits('severity_ratio')}, 'x') AS ratio_text, model_version AS model,
  CASE WHEN severity_ratio > 2.0 THEN 'ANOMALIE' ELSE 'NORMAL' END AS status FROM anomalies)"""

SQL_POINTS = """points AS (SELECT event_id, ts, user_id % 4 AS resource, value AS gauge, CAST(event_id % 500 AS DOUBLE) AS counter FROM events)"""
