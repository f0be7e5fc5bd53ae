"""Queries that go through files and streams: what they write is derived from the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import times
from ..operators import board as bd, metrics as mt
from ..schemas import ANOMALY_SCHEMA, ENRICHED_FIELDS, ENTRY_FIELDS, FEEDBACK_SCHEMA, RAW_SCHEMA
from ..session import scratch_folder
from ..sinks import lake as lake_sink, topics as sink
from ..sources import files, formats, lake, tail, topics
from ..streaming import board as sb, etl, late, scoring, series, windows as sw
from . import board_queries, ingest_queries, views as v  # noqa: F401
from .catalog import ORACLES, query

DRAIN = {"availableNow": True}
_PARAMS = {"reference_year": v.REFERENCE_YEAR, "batch_time": v.BATCH_ISO}


def _without_id(name: str, *hidden: str) -> str:
    shown = [c for c in ENTRY_FIELDS if c not in hidden]
    return f"SELECT {', '.join(shown)} FROM ({ORACLES[name]})"


def _as_file(lines: DataFrame, path: str) -> None:
    lines.select("value").write.text(path)


@query(_without_id("parse_linux"))
def scan_linux(spark, sf):
    folder = scratch_folder(spark)
    _as_file(v.syslog_lines(spark, sf), f"{folder}/Linux.log")
    return files.scan_linux(spark, folder, **_PARAMS)


@query(_without_id("parse_ssh"))
def scan_ssh(spark, sf):
    folder = scratch_folder(spark)
    _as_file(v.syslog_lines(spark, sf, "sshd"), f"{folder}/SSH.log")
    return files.scan_ssh(spark, folder, **_PARAMS)


def _by_host(lines: DataFrame, work: str, target: Callable[[str], str]) -> None:
    """One file per host, named as the layouts want it: hosts are folders of Spark's writer first."""
    spark = lines.sparkSession
    lines.select("host", "value").repartition("host").write.partitionBy("host").text(work)
    for path in files.list_paths(spark, f"{work}/host=*/part-*"):
        files.move_path(spark, path, target(path.rsplit("host=", 1)[1].split("/")[0]))


def _spark_app_files(spark, sf, folder: str) -> None:
    _by_host(v.java_lines(spark, sf), f"{folder}/work-spark", lambda host: f"{folder}/spark/{host}")


def _hadoop_files(spark, sf, folder: str) -> None:
    _by_host(v.java_lines(spark, sf), f"{folder}/work-hadoop", lambda host: f"{folder}/hadoop/rack/{host}/{host}-node.log")


def _hdfs_files(spark, sf, folder: str) -> None:
    rows = v.trace_rows(spark, sf)
    for name, failed in (("normal", False), ("failure", True)):
        part = rows.where(F.col("failed") == failed).drop("failed")
        part.write.option("header", "true").csv(f"{folder}/HDFS TraceBench/preprocessed/{name}_trace.csv")


@query(_without_id("parse_spark_app"))
def scan_spark_app(spark, sf):
    folder = scratch_folder(spark)
    _spark_app_files(spark, sf, folder)
    return files.scan_spark_app(spark, folder)


@query(_without_id("parse_hadoop"))
def scan_hadoop(spark, sf):
    """A tree of folders whose last one names the host."""
    folder = scratch_folder(spark)
    _hadoop_files(spark, sf, folder)
    return files.scan_hadoop(spark, folder)


@query(_without_id("parse_bgl"))
def scan_bgl(spark, sf):
    folder = scratch_folder(spark)
    _as_file(v.bgl_lines(spark, sf), f"{folder}/supercomputer/BGL.log")
    return files.scan_bgl(spark, folder)


@query(_without_id("parse_android"))
def scan_android(spark, sf):
    folder = scratch_folder(spark)
    _as_file(v.android_lines(spark, sf), f"{folder}/Android/Android.log")
    return files.scan_android(spark, folder, **_PARAMS)


@query(ORACLES["hdfs_event_summary"])
def scan_hdfs_trace(spark, sf):
    folder = scratch_folder(spark)
    _hdfs_files(spark, sf, folder)
    return files.scan_hdfs_trace(spark, folder, **_PARAMS)


_ALL = ["parse_linux", "parse_ssh", "parse_hadoop", "parse_spark_app", "parse_bgl", "parse_android", "hdfs_event_summary"]


@query(" UNION ALL ".join(_without_id(name) for name in _ALL))
def read_all_sources(spark, sf):
    """The registry over a folder that holds all seven sources, with an unknown name among the wanted ones."""
    folder = scratch_folder(spark)
    _as_file(v.syslog_lines(spark, sf), f"{folder}/Linux.log")
    _as_file(v.syslog_lines(spark, sf, "sshd"), f"{folder}/SSH.log")
    _as_file(v.bgl_lines(spark, sf), f"{folder}/supercomputer/BGL.log")
    _as_file(v.android_lines(spark, sf), f"{folder}/Android/Android.log")
    _spark_app_files(spark, sf, folder)
    _hadoop_files(spark, sf, folder)
    _hdfs_files(spark, sf, folder)
    return files.read_all_sources(spark, folder, [*files.SCANS, "unknown"], **_PARAMS)


_FIELDS = ", ".join(ENRICHED_FIELDS)


@query(f"WITH {v.SQL_ENRICHED} SELECT {_FIELDS} FROM enriched WHERE source = 'ssh' AND month = 1 AND day >= 10")
def scan_lake(spark, sf):
    """A pruned read of the partitioned lake."""
    folder = scratch_folder(spark)
    lake_sink.write_lake(v.enriched(spark, sf), folder)
    return lake.scan_lake(spark, folder).where("source = 'ssh' AND month = 1 AND day >= 10")


@query(f"WITH {v.SQL_ENRICHED} SELECT {_FIELDS} FROM enriched")
def mixed_lake(spark, sf):
    """Half from a batch load, half from stream batches; compacted while a batch of the same days lands, once stopped halfway,
    once more over what the first one left; batches replayed before and after; read as one."""
    folder, rows = scratch_folder(spark), v.enriched(spark, sf)

    def batch(n):
        lake_sink.write_lake(rows.where(f"event_id % 8 = {1 + 2 * n}"), folder, n)

    lake_sink.write_lake(rows.where("event_id % 2 = 0"), folder)
    for n in (0, 1, 1):
        batch(n)
    lake_sink.prepare_compaction(spark, folder, "2024-01-20")  # stops here
    batch(2)
    made = lake_sink.prepare_compaction(spark, folder, "2024-01-20")
    batch(3)
    lake_sink.commit_compaction(spark, folder, made)
    batch(2)
    lake_sink.compact(spark, folder, "2024-01-25")
    lake_sink.sweep(spark, folder)
    return lake.scan_lake(spark, folder)


@query(f"""WITH {v.SQL_BOARD} SELECT '{v.BATCH_ISO}' AS timestamp, CASE WHEN arrival % 3 <> 0 THEN 'positive' ELSE 'negative' END AS feedback, id AS log_id,
  source, host, message, score_text AS score_ia, ratio_text AS ratio, status AS statut FROM board WHERE arrival % 10 = 0""")
def feedback_append(spark, sf):
    folder, votes = scratch_folder(spark), v.feedback(v.board(spark, sf))
    for vote in ("positive", "negative"):
        sink.append_feedback(votes.where(F.col("feedback") == vote), folder)
    return spark.read.schema(FEEDBACK_SCHEMA).json(folder)


# ---- Streams ---------------------------------------------------------------

def _event_stream(spark, sf) -> DataFrame:
    """The events table as a stream, one file per micro-batch."""
    path = f"{sf}/events.parquet"
    # A pattern, since a stream takes a single file only by pattern.
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(f"{path}*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


#: Rows of a file of a feed, about, the fewest files, and the most micro-batches they make: a larger feed has larger ones.
FEED_ROWS, FEED_FILES, FEED_BATCHES = 12_500, 4, 4
#: Rows of a feed are out of order by up to this, and streams wait so long for them.
DISORDER = "2 hours"


def _feed(messages: DataFrame, position: str, folder: str) -> int:
    """Messages as files of a topic folder, in ranges of ``position``; files of later ranges are younger. No task sees more than a range.

    Gives the files of a micro-batch: what a micro-batch costs whatever its size is paid a bounded number of times.
    """
    spark = messages.sparkSession
    parts = max(FEED_FILES, -(-messages.count() // FEED_ROWS))
    messages.repartitionByRange(parts, position).sortWithinPartitions(position).select("key", "value").write.mode("append").json(folder)
    written = files.list_paths(spark, f"{folder}/part-*")
    files.date_files(spark, written)
    return max(1, -(-len(written) // FEED_BATCHES))


def _shaken(at: Column, *by: str) -> Column:
    """A time in microseconds, moved by up to half of ``DISORDER`` either way."""
    hour = 3_600_000_000
    return F.unix_micros(at) + F.pmod(F.xxhash64(*by), F.lit(2 * hour)) - hour


def _processed_feed(spark, sf, folder: str) -> DataFrame:
    """Processed messages out of order in several files, and a last one long after them, so that the watermark passes all; as a stream.

    The last message is one row of a key of its own: it ends no window.
    """
    rows = v.enriched(spark, sf)
    messages = sink.as_message(rows.withColumn("_at", _shaken(F.col("event_time"), "event_id")), F.col("event_id").cast("string"), ENRICHED_FIELDS, "_at")
    most = _feed(messages, "_at", f"{folder}/in")
    last = rows.limit(1).withColumns({"timestamp": F.lit("2100-01-01T00:00:00+00:00"), "source": F.lit("~"), "host": F.lit("~")})
    sink.as_message(last, F.lit("-1"), ENRICHED_FIELDS).write.mode("append").json(f"{folder}/in")
    fed = topics.stream_folder(spark, f"{folder}/in", most).withColumn("position", F.col("key").cast("bigint"))
    return scoring.processed_rows(fed)


@query(f"WITH {v.SQL_WINDOWS} SELECT source, host, event_id AS last_id, label, message AS last_message FROM wins")
def stream_windows(spark, sf):
    """Windows out of keyed stream state, from rows out of order over several micro-batches; the same rows as in batch."""
    folder = scratch_folder(spark)
    found = _drained(sw.stream_windows(_processed_feed(spark, sf, folder), "position", lateness=DISORDER), folder)
    return found.select("source", "host", F.col("position").alias("last_id"), "label", F.element_at("sequence", -1)["message"].alias("last_message"))


@query(f"WITH {v.SQL_ENRICHED} SELECT {_FIELDS} FROM enriched")
def stream_etl(spark, sf):
    """Raw messages through the ETL stream; what the lake then holds."""
    folder = scratch_folder(spark)
    targets = etl.EtlTargets(*[f"{folder}/{n}" for n in ("lake", "processed", "anomalies", "quarantine", "counters")])
    messages = sink.raw_messages(v.raw_logs_of(_event_stream(spark, sf)))
    etl.run_etl(messages, targets, f"{folder}/checkpoint", DRAIN, lambda: v.BATCH_TIME).awaitTermination()
    return lake.scan_lake(spark, targets.lake)


def _drained(stream: DataFrame, folder: str) -> DataFrame:
    writer = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
    with sw.state_partitions(stream.sparkSession):
        query = writer.trigger(**DRAIN).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


@query(f"WITH {v.SQL_RAW} SELECT {', '.join(ENTRY_FIELDS)} FROM raw_logs")
def stream_raw(spark, sf):
    """The raw topic as a folder of several files, read in several micro-batches."""
    folder, rows = scratch_folder(spark), v.raw_logs(spark, sf)
    most = _feed(sink.as_message(rows, "source", ENTRY_FIELDS, "raw"), "raw", f"{folder}/in")
    read = topics.decode(topics.stream_folder(spark, f"{folder}/in", most), RAW_SCHEMA)
    return _drained(read.select(*ENTRY_FIELDS), folder)


@query(f"WITH {v.SQL_ANOMALIES} SELECT arrival, detected_at, source, host, anomaly_score, threshold, severity_ratio, model_version FROM anomalies")
def stream_anomalies(spark, sf):
    """The anomaly topic as a folder of several files; the place of a message is its key here."""
    folder, rows = scratch_folder(spark), v.ml_anomalies(spark, sf)
    most = _feed(sink.as_message(rows, F.col("arrival").cast("string"), sink.ANOMALY_FIELDS, "arrival"), "arrival", f"{folder}/in")
    read = sb.anomaly_rows(topics.stream_folder(spark, f"{folder}/in", most), F.col("key").cast("bigint"))
    number = {c: F.col(c).cast("double").alias(c) for c in ("anomaly_score", "threshold", "severity_ratio")}
    return _drained(read, folder).select("arrival", "detected_at", "source", "host", *number.values(), "model_version")


@query(v.SQL_RULE_HITS)
def stream_scoring(spark, sf):
    """Processed messages through stateful windows and a scorer, over several micro-batches; the same hits as in batch."""
    folder = scratch_folder(spark)
    fed = _processed_feed(spark, sf, folder)
    inputs, model = v.rule_scorer(spark, sf)
    with sw.state_partitions(spark):
        sent = scoring.run_scoring(fed, "position", inputs, model, v.RULE_THRESHOLD, v.BATCH_ISO, f"{folder}/sent",
                                   f"{folder}/checkpoint", DRAIN, lateness=DISORDER, idle_minutes=None)
    sent.awaitTermination()
    sent = topics.read_folder(spark, f"{folder}/sent").select("key", F.from_json("value", ANOMALY_SCHEMA).alias("m"))
    return sent.select(F.col("key").alias("source"), "m.host", "m.anomaly_score", "m.severity_ratio",
                       F.array_join("m.sequence.message", "|").alias("messages"))


@query(f"""WITH {v.SQL_RAW}, m AS (SELECT * FROM raw_logs)
SELECT CAST(sum(CASE WHEN event_id % 83 = 0 OR event_id % 79 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS quarantined,
  count(*) AS received, CAST(count(*) FILTER (WHERE NOT (event_id % 83 = 0 OR event_id % 79 = 0) AND (event_id % 89 = 0 OR source = '')) AS BIGINT) AS rejected,
  CAST(count(*) FILTER (WHERE NOT (event_id % 83 = 0 OR event_id % 79 = 0) AND NOT (event_id % 89 = 0 OR source = '')) AS BIGINT) AS records FROM m""")
def etl_counters(spark, sf):
    """What the ETL stream received, quarantined, rejected and kept, summed over its batches."""
    folder = scratch_folder(spark)
    messages = v.json_messages(spark, sf).select(F.col("event_id").cast("string").alias("key"), "value", F.col("event_id").alias("_at"))
    most = _feed(messages, "_at", f"{folder}/in")
    targets = etl.EtlTargets(*[f"{folder}/{n}" for n in ("lake", "processed", "anomalies", "quarantine", "counters")])
    etl.run_etl(topics.stream_folder(spark, f"{folder}/in", most), targets, f"{folder}/checkpoint", DRAIN, lambda: v.BATCH_TIME).awaitTermination()
    counted = spark.read.schema("quarantined long, received long, rejected long, records long").json(f"{targets.counters}/counts")
    return counted.agg(*[F.sum(c).alias(c) for c in ("quarantined", "received", "rejected", "records")])


def _anomaly_stream(spark, sf) -> DataFrame:
    """One anomaly message per event, to drive the board streams."""
    rows = v.raw_logs_of(_event_stream(spark, sf), keep=["ts"]).where(F.col("source") != "")
    record = F.struct(F.col("timestamp"), F.col("level"), F.col("message"))
    return rows.select(
        F.col("event_id").alias("arrival"), times.iso_utc(F.col("ts")).alias("detected_at"), "source", "host",
        (F.col("value") / 50).alias("anomaly_score"), F.lit(1.0).alias("threshold"), (F.col("value") / 50).alias("severity_ratio"),
        F.array(record).alias("sequence"), F.lit("m").alias("model_version"))


@query(f"WITH {v.SQL_RAW} SELECT DISTINCT strftime(ts, '%Y-%m-%dT%H:%M:%S') AS second, source, host, value / 50 AS anomaly_score FROM raw_logs JOIN events USING (event_id, value) WHERE source <> ''")
def stream_dedup(spark, sf):
    """Every message arrives twice; one of each is kept."""
    folder = scratch_folder(spark)
    once = sb.dedup_stream(_anomaly_stream(spark, sf).unionByName(_anomaly_stream(spark, sf)))
    (once.writeStream.format("parquet").option("path", f"{folder}/once").option("checkpointLocation", f"{folder}/checkpoint")
     .trigger(**DRAIN).start().awaitTermination())
    return spark.read.schema(once.schema).parquet(f"{folder}/once").select(
        F.substring("detected_at", 1, 19).alias("second"), "source", "host", "anomaly_score")


@query(f"""WITH {v.SQL_RAW}, a AS (SELECT event_id AS arrival, source, host, message, value / 50 AS score FROM raw_logs WHERE source <> '')
SELECT arrival, source, host, message, score, CASE WHEN score > 2.0 THEN 'ANOMALIE' ELSE 'NORMAL' END AS status, (SELECT count(*) FROM a) AS received
FROM a ORDER BY arrival DESC LIMIT {bd.MAX_ROWS}""")
def stream_board(spark, sf):
    """The newest rows a board stream keeps, with the count of all it received."""
    folder = scratch_folder(spark)
    sb.run_board(bd.board_rows(_anomaly_stream(spark, sf)), f"{folder}/board", f"{folder}/checkpoint", DRAIN).awaitTermination()
    return sb.read_board(spark, f"{folder}/board").select("arrival", "source", "host", "message", "score", "status", "received")


@query(f"WITH {v.SQL_ENRICHED} SELECT {_FIELDS} FROM enriched")
def stream_etl_restarted(spark, sf):
    """The ETL stream stopped after two micro-batches, gone on with, and its batches run once more after the loss of a checkpoint."""
    folder = scratch_folder(spark)
    targets = etl.EtlTargets(*[f"{folder}/{n}" for n in ("lake", "processed", "anomalies", "quarantine", "counters")])
    rows = v.raw_logs(spark, sf)
    in_batch = _feed(sink.as_message(rows, "source", ENTRY_FIELDS, "raw"), "raw", f"{folder}/in")

    def run(checkpoint: str, most: int | None = None) -> None:
        query = etl.run_etl(topics.stream_folder(spark, f"{folder}/in", in_batch), targets, f"{folder}/{checkpoint}",
                            DRAIN if most is None else {"processingTime": "0 seconds"}, lambda: v.BATCH_TIME)
        while most is not None and query.isActive and (query.lastProgress is None or query.lastProgress.batchId + 1 < most):
            query.awaitTermination(1)
        query.stop() if most is not None else query.awaitTermination()

    run("checkpoint", 2)
    run("checkpoint")
    run("another")
    return lake.scan_lake(spark, targets.lake)


@query(_without_id("parse_linux"))
def stream_log_files(spark, sf):
    """Files of a log folder as a stream of lines, stopped within a file and gone on with, then parsed."""
    folder = scratch_folder(spark)
    _as_file(v.syslog_lines(spark, sf), f"{folder}/in")

    def start(most: int):
        lines = tail.stream_log_folder(spark, f"{folder}/in", f"{folder}/progress.json", 1, most, 0)
        return (lines.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
                .trigger(processingTime="0 seconds").start())

    query = start(700)
    while query.isActive and not any(p.numInputRows for p in query.recentProgress):
        query.awaitTermination(1)
    query.stop()
    query = start(topics.MAX_ROWS)
    query.processAllAvailable()
    query.stop()
    lines = spark.read.schema(tail.SCHEMA).parquet(f"{folder}/out").withColumnRenamed("file", "file_name")
    return formats.parse_linux(lines, v.REFERENCE_YEAR).select(*ENTRY_FIELDS)


# ---- Infrastructure series as streams --------------------------------------

def _points_stream(spark, sf, folder: str, value: str) -> DataFrame:
    """Points out of order in several files, and a last one of a series of its own long after them; as a stream."""
    points = v.infra_points(spark, sf).select("event_id", "ts", F.col("resource").cast("long").alias("resource"), F.col(value).cast("double").alias("value"))
    record = F.struct("event_id", F.unix_micros("ts").alias("micros"), "resource", "value")
    most = _feed(points.select(F.lit("").alias("key"), F.to_json(record).alias("value"), _shaken(F.col("ts"), "event_id").alias("_at")), "_at", f"{folder}/in")
    last = points.limit(1).withColumns({"ts": F.lit("2100-01-01").cast("timestamp"), "resource": F.lit(-1).cast("long"), "value": F.lit(0.0)})
    last.select(F.lit("").alias("key"), F.to_json(record).alias("value")).write.mode("append").json(f"{folder}/in")
    told = F.from_json("value", "event_id long, micros long, resource long, value double").alias("p")
    fed = topics.stream_folder(spark, f"{folder}/in", most).select(told).select("p.*")
    return fed.withColumn("ts", F.timestamp_micros("micros"))


@query(ORACLES["align_mean"])
def stream_align_mean(spark, sf):
    folder = scratch_folder(spark)
    found = _drained(series.stream_mean(_points_stream(spark, sf, folder, "gauge"), ["resource"], "event_id", lateness=DISORDER), folder)
    return found.where("resource >= 0").withColumn("value", F.round("value", 10))


@query(ORACLES["align_rate"])
def stream_align_rate(spark, sf):
    folder = scratch_folder(spark)
    found = _drained(series.stream_rate(_points_stream(spark, sf, folder, "counter"), ["resource"], "event_id", lateness=DISORDER), folder)
    return found.where("resource >= 0").withColumn("value", F.round("value", 6))


@query(ORACLES["align_delta"])
def stream_align_delta(spark, sf):
    folder = scratch_folder(spark)
    found = _drained(series.stream_delta(_points_stream(spark, sf, folder, "counter"), ["resource"], "event_id", lateness=DISORDER), folder)
    return found.where("resource >= 0")


@query(ORACLES["sustained_alert"])
def stream_sustained_alert(spark, sf):
    """Alerts that closed: the stretches of the batch query."""
    folder = scratch_folder(spark)
    alerts = series.stream_alert(_points_stream(spark, sf, folder, "gauge"), ["resource"], "event_id", series.MEAN, 45.0, mt.MEAN_SECONDS, 2, DISORDER)
    closed = _drained(alerts, folder).where("event = 'close' AND resource >= 0").drop("event")
    return closed.withColumn("peak", F.round("peak", 10))


@query(ORACLES["restart_alert"])
def stream_restart_alert(spark, sf):
    """Restart alerts that closed."""
    folder = scratch_folder(spark)
    alerts = series.stream_alert(_points_stream(spark, sf, folder, "counter"), ["resource"], "event_id", series.DELTA, mt.RESTART_LIMIT, mt.DELTA_SECONDS, 1, DISORDER)
    return _drained(alerts, folder).where("event = 'close' AND resource >= 0").drop("event")
