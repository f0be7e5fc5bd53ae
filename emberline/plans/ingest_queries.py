"""Parsing, validation, enrichment, lake and message queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import levels, text, times
from ..operators import enrich as en, mixing, prefix
from ..schemas import ENRICHED_FIELDS, ENTRY_FIELDS, RAW_SCHEMA
from ..sinks import lake, topics as sink
from ..sources import formats, topics
from . import views as v
from .catalog import query

FIELDS = ", ".join(ENTRY_FIELDS)
LINES = "event_id % 17 <> 0 AND event_id % 19 <> 0"
SYSLOG_RAW = "concat(strftime(ts, '%b'), ' ', lpad(CAST(day(ts) AS VARCHAR), 2, ' '), ' ', strftime(ts, '%H:%M:%S'), ' host-', user_id, ' {p}[', event_id, ']: ', message)"
LINUX_LEVEL = """CASE WHEN contains(lower({m}), 'error') OR contains(lower({m}), 'fail') THEN 'ERROR' WHEN contains(lower({m}), 'critical') THEN 'FATAL'
  WHEN contains(lower({m}), 'warn') THEN 'WARN' WHEN contains(lower({m}), 'debug') THEN 'DEBUG' ELSE 'INFO' END"""
SSH_LEVEL = """CASE WHEN contains(lower({m}), 'invalid user') OR contains(lower({m}), 'failed password') THEN 'WARN'
  WHEN contains(lower({m}), 'break-in attempt') OR contains(lower({m}), 'error') THEN 'ERROR' WHEN contains(lower({m}), 'fatal') THEN 'FATAL' ELSE 'INFO' END"""


@query(f"""WITH {v.SQL_EVENTS} SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, 'linux' AS source, concat('host-', user_id) AS host,
  {LINUX_LEVEL.format(m='message')} AS level, 'kernel' AS component, message, {SYSLOG_RAW.format(p='kernel')} AS raw FROM ev WHERE {LINES}""")
def parse_linux(spark, sf):
    return formats.parse_linux(v.syslog_lines(spark, sf), v.REFERENCE_YEAR)


@query(f"""WITH {v.SQL_EVENTS} SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, 'ssh' AS source, concat('host-', user_id) AS host,
  {SSH_LEVEL.format(m='message')} AS level, concat('sshd[', event_id, ']') AS component, message, {SYSLOG_RAW.format(p='sshd')} AS raw FROM ev WHERE {LINES}""")
def parse_ssh(spark, sf):
    return formats.parse_ssh(v.syslog_lines(spark, sf, "sshd"), v.REFERENCE_YEAR)


JAVA_SQL = f"""WITH {v.SQL_EVENTS}, j AS (SELECT *, list_extract(['INFO', 'WARN', 'ERROR', 'FATAL', 'DEBUG'], CAST(event_id % 5 + 1 AS BIGINT)) AS level,
  substr(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), 1, 23) AS t FROM ev)
SELECT event_id, replace(t, ' ', 'T') AS timestamp, '{{s}}' AS source, concat('app-', user_id % 9) AS host, level, concat('org.x.', event_type) AS component,
  message, concat(replace(t, '.', ','), ' ', level, ' [main] org.x.', event_type, ': ', message) AS raw FROM j WHERE event_id % 19 <> 0"""


@query(JAVA_SQL.format(s="hadoop"))
def parse_hadoop(spark, sf):
    return formats.parse_hadoop(v.java_lines(spark, sf))


@query(JAVA_SQL.format(s="spark"))
def parse_spark_app(spark, sf):
    return formats.parse_spark_app(v.java_lines(spark, sf))


@query(f"""WITH {v.SQL_EVENTS}, b AS (SELECT *, list_extract(['INFO', 'WARN', 'WARN', 'ERROR', 'FATAL', 'ERROR'], CAST(event_id % 6 + 1 AS BIGINT)) AS level,
  list_extract(['info', 'WARN', 'Warning', 'ERROR', 'FATAL', 'severe'], CAST(event_id % 6 + 1 AS BIGINT)) AS spelled, concat('R', user_id % 64) AS node FROM ev)
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, 'supercomputer' AS source, node AS host, level, 'RAS_KERNEL' AS component, message,
  concat('- 1117838570 2005.06.03 ', node, ' ', strftime(ts, '%Y-%m-%d-%H.%M.%S.%f'), ' ', node, ' RAS KERNEL ', spelled, ' ', message) AS raw
FROM b WHERE event_id % 11 <> 0""")
def parse_bgl(spark, sf):
    return formats.parse_bgl(v.bgl_lines(spark, sf))


@query("SELECT count(*) AS entries, count(*) FILTER (WHERE event_id % 11 = 0) AS alerts FROM events")
def parse_bgl_with_alerts(spark, sf):
    rows = formats.parse_bgl(v.bgl_lines(spark, sf), include_alerts=True)
    return rows.agg(F.count("*").alias("entries"), F.count_if(~F.col("raw").startswith("-")).alias("alerts"))


ANDROID_MILLIS = "CAST(strftime(ts, '%Y-%m-%dT%H:%M:%S.') || substr(strftime(ts, '%f'), 1, 3) AS TIMESTAMP)"


@query(f"""WITH {v.SQL_EVENTS}, a AS (SELECT *, {ANDROID_MILLIS} AS t FROM ev)
SELECT event_id, {v.sql_iso_local('t')} AS timestamp, 'android' AS source, 'android-device' AS host,
  list_extract(['DEBUG', 'DEBUG', 'INFO', 'WARN', 'ERROR', 'FATAL'], CAST(event_id % 6 + 1 AS BIGINT)) AS level, event_type AS component, message,
  concat(substr(strftime(ts, '%m-%d %H:%M:%S.%f'), 1, 18), '  1234  5678 ', substr('VDIWEF', CAST(event_id % 6 + 1 AS BIGINT), 1), ' ', event_type,
   CASE WHEN event_id % 2 = 0 THEN ' ' ELSE '' END, ': ', message) AS raw
FROM a WHERE event_id % 19 <> 0""")
def parse_android(spark, sf):
    return formats.parse_android(v.android_lines(spark, sf), v.REFERENCE_YEAR)


_CELLS = ", ".join(f"CASE WHEN {'user_id % 5 <> 0 AND ' if n == 'click' else ''}{n} > 0 THEN concat('{n}=', {n}) END" for n in v.TRACE_EVENTS)
_RAW = ", ".join(("CASE WHEN user_id % 5 = 0 THEN 'n/a' ELSE concat(click, '.0') END" if n == "click" else f"concat({n}, '.0')") for n in v.TRACE_EVENTS)


@query(f"""WITH c AS (SELECT user_id, day(ts) AS d, {', '.join(f"count(*) FILTER (WHERE event_type = '{n}') AS {n}" for n in v.TRACE_EVENTS[:5])},
  count(*) FILTER (WHERE value > 100) AS slow, count(*) FILTER (WHERE value < 10) AS cheap FROM events GROUP BY ALL),
m AS (SELECT *, ([x for x in [{_CELLS}] if x IS NOT NULL])[1:5] AS shown FROM c)
SELECT '{v.BATCH_ISO}' AS timestamp, 'hdfs' AS source, 'hdfs-cluster' AS host, CASE WHEN user_id % 2 = 0 THEN 'ERROR' ELSE 'INFO' END AS level,
  concat('task:', user_id, '-', d) AS component, CASE WHEN len(shown) = 0 THEN 'empty trace' ELSE array_to_string(shown, '; ') END AS message,
  concat_ws(',', concat(user_id, '-', d), {_RAW}) AS raw FROM m""")
def hdfs_event_summary(spark, sf):
    rows = v.trace_rows(spark, sf)
    return formats.parse_hdfs_trace(rows, "TaskID", v.TRACE_EVENTS, v.BATCH_ISO, F.col("failed")).drop("failed")


_KEYWORDS = ["", "Error", "FATAL", "Critical", "warn", "WARNING", "Disconnect", "Failed password", "break-in attempt", "Debug", "ok"]
_KEYWORD_SQL = f"WITH {v.SQL_EVENTS}, k AS (SELECT event_id, concat(list_extract({_KEYWORDS}, CAST(event_id % {len(_KEYWORDS)} + 1 AS BIGINT)), ' ', value) AS m FROM ev)"


def _keyword_messages(spark, sf):
    words = F.array(*[F.lit(k) for k in _KEYWORDS])
    lead = F.element_at(words, (F.col("event_id") % len(_KEYWORDS) + 1).cast("int"))
    return v.events(spark, sf).select("event_id", F.concat(lead, F.lit(" "), F.col("value")).alias("message"))


@query(f"{_KEYWORD_SQL} SELECT event_id, {LINUX_LEVEL.format(m='m')} AS level FROM k")
def infer_level_linux(spark, sf):
    return _keyword_messages(spark, sf).select("event_id", levels.linux_level(F.col("message")).alias("level"))


@query(f"{_KEYWORD_SQL} SELECT event_id, {SSH_LEVEL.format(m='m')} AS level FROM k")
def infer_level_ssh(spark, sf):
    return _keyword_messages(spark, sf).select("event_id", levels.ssh_level(F.col("message")).alias("level"))


@query("""SELECT event_id, CASE upper(substr(event_type, 1, 1)) WHEN 'V' THEN 'DEBUG' WHEN 'D' THEN 'DEBUG' WHEN 'I' THEN 'INFO' WHEN 'W' THEN 'WARN'
  WHEN 'E' THEN 'ERROR' WHEN 'F' THEN 'FATAL' ELSE 'INFO' END AS level FROM events""")
def map_level_android(spark, sf):
    letter = F.upper(F.substring("event_type", 1, 1))
    return v.events(spark, sf).select("event_id", levels.android_level(letter).alias("level"))


@query("""SELECT event_id, list_extract(['INFO', 'WARN', 'WARN', 'ERROR', 'UNKNOWN'], CAST(event_id % 5 + 1 AS BIGINT)) AS level FROM events""")
def normalise_level_bgl(spark, sf):
    names = F.array(*[F.lit(x) for x in ("info", "Warning", "WARN", "severe", "unknown")])
    return v.events(spark, sf).select(
        "event_id", levels.bgl_level(F.element_at(names, (F.col("event_id") % 5 + 1).cast("int"))).alias("level"))


@query(f"WITH {v.SQL_RAW} SELECT event_id, CASE WHEN upper(level) = 'WARNING' THEN 'WARN' ELSE upper(level) END AS level FROM raw_logs")
def normalise_level(spark, sf):
    return v.raw_logs(spark, sf).select("event_id", levels.normalised_level(F.col("level")).alias("level"))


@query("""SELECT event_id, CASE WHEN event_id % 23 = 0 THEN concat('Foo ', day(ts), ' ', strftime(ts, '%H:%M:%S'))
  ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS iso FROM events""")
def syslog_timestamp(spark, sf):
    bad = F.col("event_id") % 23 == 0
    stamp = F.concat(F.when(bad, F.lit("Foo ")).otherwise(F.date_format("ts", "MMM  ")), F.dayofmonth("ts"), F.lit(" "),
                     F.date_format("ts", "HH:mm:ss"))
    return v.events(spark, sf).select("event_id", times.syslog_time(stamp, v.REFERENCE_YEAR).alias("iso"))


@query(f"""SELECT event_id, CASE WHEN event_id % 23 = 0 THEN concat('13', strftime(ts, '-%d %H:%M:%S.%f')) WHEN event_id % 2 = 0
  THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE {v.sql_iso_local('ts')} END AS iso FROM events""")
def android_timestamp(spark, sf):
    e = F.col("event_id")
    stamp = (F.when(e % 23 == 0, F.concat(F.lit("13"), F.date_format("ts", "-dd HH:mm:ss.SSSSSS")))
             .when(e % 2 == 0, F.date_format("ts", "MM-dd HH:mm:ss.'000'")).otherwise(F.date_format("ts", "MM-dd HH:mm:ss.SSSSSS")))
    return v.events(spark, sf).select("event_id", times.android_time(stamp, v.REFERENCE_YEAR).alias("iso"))


@query("SELECT event_id, substr(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), 1, 23) AS iso FROM events")
def hadoop_timestamp(spark, sf):
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS")
    return v.events(spark, sf).select("event_id", times.comma_time(stamp).alias("iso"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS iso FROM events")
def bgl_timestamp(spark, sf):
    stamp = F.date_format("ts", "yyyy-MM-dd-HH.mm.ss.SSSSSS")
    return v.events(spark, sf).select("event_id", times.bgl_time(stamp).alias("iso"))


@query(f"""WITH s AS (SELECT event_id, event_id % 6 AS k, CASE WHEN event_id % 6 IN (0, 1, 4) THEN date_trunc('second', ts) ELSE ts END AS t FROM events)
SELECT event_id, strftime(CASE WHEN k >= 4 THEN TIMESTAMP '{v.BATCH_TIME}' ELSE t END, '%Y-%m-%dT%H:%M:%S.%f') AS event_time, k >= 4 AS timestamp_fallback FROM s""")
def parse_iso_timestamp(spark, sf):
    k = F.col("event_id") % 6
    micros, seconds = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), times.iso_seconds(F.col("ts"))
    stamp = (F.when(k == 0, seconds).when(k == 1, F.concat(seconds, F.lit("Z"))).when(k == 2, micros)
             .when(k == 3, F.concat(micros, F.lit("Z"))).when(k == 4, F.concat(seconds, F.lit("+02:00")))
             .otherwise(F.date_format("ts", "yyyy-MM-dd")))
    rows = v.events(spark, sf).select("event_id", stamp.alias("timestamp"))
    return en.add_event_time(rows, v.BATCH_TIME).select(
        "event_id", F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("event_time"), "timestamp_fallback")


@query(f"""WITH s AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN date_trunc('second', ts) ELSE ts END AS t FROM events)
SELECT event_id, concat({v.sql_iso_local('t')}, '+00:00') AS iso FROM s""")
def render_iso_timestamp(spark, sf):
    ts = F.when(F.col("event_id") % 3 == 0, F.date_trunc("second", F.col("ts"))).otherwise(F.col("ts"))
    return v.events(spark, sf).select("event_id", times.iso_utc(ts).alias("iso"))


@query(f"WITH {v.SQL_ENRICHED} SELECT event_id, year, month, day, hour FROM enriched")
def partition_columns(spark, sf):
    return v.enriched(spark, sf).select("event_id", "year", "month", "day", "hour")


@query(f"WITH {v.SQL_ENRICHED} SELECT event_id, is_anomaly_candidate FROM enriched")
def flag_candidates(spark, sf):
    return v.enriched(spark, sf).select("event_id", "is_anomaly_candidate")


@query(f"WITH {v.SQL_ENRICHED} SELECT event_id, {', '.join(ENRICHED_FIELDS)}, timestamp_fallback FROM enriched")
def enrich_logs(spark, sf):
    return v.enriched(spark, sf).select("event_id", *ENRICHED_FIELDS, "timestamp_fallback")


@query(f"WITH {v.SQL_ENRICHED} SELECT event_id, source, host, level, message FROM enriched WHERE is_anomaly_candidate")
def rule_anomalies(spark, sf):
    return en.rule_anomalies(v.enriched(spark, sf)).select("event_id", "source", "host", "level", "message")


@query(f"""WITH {v.SQL_RAW} SELECT event_id, {', '.join(ENTRY_FIELDS[:-1])}, CASE WHEN event_id % 89 <> 0 THEN raw END AS raw FROM raw_logs
WHERE event_id % 83 <> 0 AND event_id % 79 <> 0""")
def decode_json(spark, sf):
    return topics.decode(v.json_messages(spark, sf), RAW_SCHEMA).drop("_keys")


@query("""SELECT event_id, CASE WHEN event_id % 83 = 0 THEN '{bad' ELSE '[1]' END AS value,
  CASE WHEN event_id % 83 = 0 THEN 'malformed' ELSE 'not an object' END AS reason FROM events WHERE event_id % 83 = 0 OR event_id % 79 = 0""")
def quarantine_json(spark, sf):
    return topics.quarantine(v.json_messages(spark, sf))


_DECODED = f"WITH {v.SQL_RAW}, decoded AS (SELECT * FROM raw_logs WHERE event_id % 83 <> 0 AND event_id % 79 <> 0)"


@query(f"{_DECODED} SELECT event_id, source, host FROM decoded WHERE source <> '' AND event_id % 89 <> 0")
def validate_records(spark, sf):
    return en.validate(topics.decode(v.json_messages(spark, sf), RAW_SCHEMA), "_keys").select("event_id", "source", "host")


@query(f"{_DECODED} SELECT event_id, source, host FROM decoded WHERE source = '' OR event_id % 89 = 0")
def rejected_records(spark, sf):
    return en.rejected(topics.decode(v.json_messages(spark, sf), RAW_SCHEMA), "_keys").select("event_id", "source", "host")


@query("SELECT event_id, 'java.lang.Exception: boom' AS line FROM events WHERE event_id % 17 <> 0 AND event_id % 19 = 0")
def unparsed_lines(spark, sf):
    return formats.unparsed(v.syslog_lines(spark, sf), formats.LINUX_PATTERN).select("event_id", "line")


@query(f"""SELECT 'linux' AS source, count(*) AS n FROM events WHERE {LINES} UNION ALL SELECT 'ssh', count(*) FROM events WHERE {LINES}
UNION ALL SELECT 'hadoop', count(*) FROM events WHERE event_id % 19 <> 0 UNION ALL SELECT 'spark', count(*) FROM events WHERE event_id % 19 <> 0
UNION ALL SELECT 'supercomputer', count(*) FROM events WHERE event_id % 11 <> 0 UNION ALL SELECT 'android', count(*) FROM events WHERE event_id % 19 <> 0
UNION ALL SELECT 'hdfs', count(*) FROM (SELECT DISTINCT user_id, day(ts) FROM events)""")
def union_sources(spark, sf):
    trace = formats.parse_hdfs_trace(v.trace_rows(spark, sf), "TaskID", v.TRACE_EVENTS, v.BATCH_ISO, F.col("failed"))
    frames = [
        formats.parse_linux(v.syslog_lines(spark, sf), v.REFERENCE_YEAR), formats.parse_ssh(v.syslog_lines(spark, sf, "sshd"), v.REFERENCE_YEAR),
        formats.parse_hadoop(v.java_lines(spark, sf)), formats.parse_spark_app(v.java_lines(spark, sf)),
        formats.parse_bgl(v.bgl_lines(spark, sf)), formats.parse_android(v.android_lines(spark, sf), v.REFERENCE_YEAR), trace,
    ]
    merged = mixing.union_sources([f.select(*ENTRY_FIELDS) for f in frames])
    return merged.groupBy("source").agg(F.count("*").alias("n"))


# ---- Lake and messages -----------------------------------------------------

@query(f"""WITH {v.SQL_ENRICHED} SELECT source, year, lpad(CAST(month AS VARCHAR), 2, '0') AS month, lpad(CAST(day AS VARCHAR), 2, '0') AS day,
  count(*) AS n FROM enriched GROUP BY ALL""")
def lake_partitions(spark, sf):
    return lake.partition_tuples(v.enriched(spark, sf))


@query(f"""WITH {v.SQL_ENRICHED}, p AS (SELECT source, year, month, day, count(*) AS n FROM enriched GROUP BY ALL),
a AS (SELECT *, DATE '2024-04-10' - make_date(year, month, day) AS age FROM p)
SELECT source, year, lpad(CAST(month AS VARCHAR), 2, '0') AS month, lpad(CAST(day AS VARCHAR), 2, '0') AS day, n, CAST(age AS INTEGER) AS age_days FROM a WHERE age > 90""")
def aged_partitions(spark, sf):
    return lake.aged_partitions(v.enriched(spark, sf), "2024-04-10", 90).withColumns({
        "month": F.lpad(F.col("month").cast("string"), 2, "0"), "day": F.lpad(F.col("day").cast("string"), 2, "0")})


def _json_sql(fields: list[str]) -> str:
    return "CAST(json_object(" + ", ".join(f"'{f}', {f}" for f in fields) + ") AS VARCHAR)"


@query(f"WITH {v.SQL_RAW} SELECT source AS key, {_json_sql(ENTRY_FIELDS)} AS value FROM raw_logs")
def raw_messages(spark, sf):
    return sink.raw_messages(v.raw_logs(spark, sf))


@query(f"WITH {v.SQL_ENRICHED} SELECT source AS key, {_json_sql(ENRICHED_FIELDS)} AS value FROM enriched")
def processed_messages(spark, sf):
    return sink.processed_messages(v.enriched(spark, sf))


@query(f"""WITH {v.SQL_ENRICHED}, r AS (SELECT *, '{v.BATCH_ISO}' AS anomaly_published_at FROM enriched WHERE is_anomaly_candidate)
SELECT level AS key, {_json_sql([*ENRICHED_FIELDS, 'anomaly_published_at'])} AS value FROM r""")
def rule_anomaly_messages(spark, sf):
    return sink.rule_anomaly_messages(v.enriched(spark, sf), v.BATCH_ISO)


# ---- Counters and order ----------------------------------------------------

@query(f"""WITH {v.SQL_ENRICHED}, t AS (SELECT count(*) AS total FROM events)
SELECT count(*) AS records, count(*) FILTER (WHERE is_anomaly_candidate) AS anomalies,
  round(100.0 * count(*) FILTER (WHERE is_anomaly_candidate) / count(*), 6) AS anomaly_pct, any_value(total) - count(*) AS dropped FROM enriched, t""")
def batch_counters(spark, sf):
    counters = en.batch_counters(v.enriched(spark, sf)).withColumn("anomaly_pct", F.round("anomaly_pct", 6))
    received = v.events(spark, sf).agg(F.count("*"))
    return counters.withColumn("dropped", received.scalar() - F.col("records"))


@query(f"""WITH {v.SQL_ENRICHED}, f AS (SELECT event_id // 500 AS batch_id, count(*) AS records, count(*) FILTER (WHERE is_anomaly_candidate) AS anomalies,
  count(DISTINCT (source, year, month, day)) AS files FROM enriched GROUP BY ALL)
SELECT CAST(batch_id AS BIGINT) AS batch_id, records, anomalies, files, CAST(sum(records) OVER w AS BIGINT) AS total_records,
  CAST(sum(anomalies) OVER w AS BIGINT) AS total_anomalies, CAST(sum(files) OVER w AS BIGINT) AS total_files FROM f WINDOW w AS (ORDER BY batch_id)""")
def running_totals(spark, sf):
    batch = F.expr("event_id div 500")
    per_batch = v.enriched(spark, sf).withColumn("batch_id", batch).groupBy("batch_id").agg(
        F.count("*").alias("records"), F.count_if(F.col("is_anomaly_candidate")).alias("anomalies"),
        F.count_distinct("source", "year", "month", "day").alias("files"))
    totals = {f"total_{c}": F.col(c) for c in ("records", "anomalies", "files")}
    return prefix.running_sums(per_batch, "batch_id", totals, chunk=10_000)


@query(f"""WITH {v.SQL_ENRICHED} SELECT source, count(*) AS records, count(*) FILTER (WHERE is_anomaly_candidate) AS anomalies,
  round(avg(CASE WHEN is_anomaly_candidate THEN 1.0 ELSE 0.0 END), 9) AS anomaly_rate FROM enriched GROUP BY source""")
def anomaly_rate_by_source(spark, sf):
    return en.anomaly_rate(v.enriched(spark, sf), "source").withColumn("anomaly_rate", F.round("anomaly_rate", 9))


@query(f"""WITH {v.SQL_ENRICHED} SELECT source, level, count(*) AS records, count(*) FILTER (WHERE is_anomaly_candidate) AS anomalies,
  round(avg(CASE WHEN is_anomaly_candidate THEN 1.0 ELSE 0.0 END), 9) AS anomaly_rate FROM enriched GROUP BY ROLLUP (source, level)""")
def anomaly_rate_totals(spark, sf):
    return en.anomaly_rate(v.enriched(spark, sf), "source", "level", totals=True).withColumn("anomaly_rate", F.round("anomaly_rate", 9))


_PLACE = "CASE source " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(v.SOURCE_ORDER)) + f" ELSE {len(v.SOURCE_ORDER)} END, source"
_MIXED = f"""WITH {v.SQL_RAW}, t AS (SELECT event_id, source, row_number() OVER (PARTITION BY source ORDER BY event_id) AS turn FROM raw_logs),
mixed AS (SELECT *, row_number() OVER (ORDER BY turn, {_PLACE}) - 1 AS slot FROM t)"""


def _mixed(spark, sf):
    rows = v.raw_logs(spark, sf).select("event_id", "source")
    return mixing.round_robin(rows, v.SOURCE_ORDER, "event_id").select("event_id", "source", "turn", "slot")


@query(f"{_MIXED} SELECT event_id, source, turn, slot FROM mixed")
def round_robin(spark, sf):
    return _mixed(spark, sf)


@query(f"{_MIXED} SELECT event_id, source, turn, slot FROM mixed WHERE slot >= 700")
def resume_offset(spark, sf):
    return mixing.resume(_mixed(spark, sf), 700)


@query("SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents)")
def tokenize(spark, sf):
    toks = text.tokens(F.col("text"))
    docs = v.table(spark, sf, "documents").select("doc_id", toks.alias("t"))
    return docs.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))
