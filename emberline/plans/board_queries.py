"""Board, alert, incident, feedback and infrastructure queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import display
from ..operators import board as bd, metrics as mt
from ..session import materialised, scratch_folder
from . import views as v
from .catalog import ORACLES, query

_B = f"WITH {v.SQL_BOARD}"
_SHOWN = "arrival, id, timestamp, source, host, message, score, ratio, threshold, score_text, ratio_text, model, status"


@query(f"{_B} SELECT {_SHOWN} FROM board")
def board_rows(spark, sf):
    return v.board(spark, sf)


@query(f"{_B} SELECT arrival, ratio, CASE WHEN ratio > 1.3 THEN 'ANOMALIE' ELSE 'NORMAL' END AS status FROM board")
def classify_status(spark, sf):
    return v.board(spark, sf).select("arrival", "ratio", display.status(F.col("ratio"), 1.3).alias("status"))


@query(f"""{_B} SELECT arrival, CASE WHEN ip = '' THEN 'non détectée' ELSE ip END AS ip, CASE WHEN usr = '' THEN 'non détecté' ELSE usr END AS "user" FROM
(SELECT arrival, CASE WHEN arrival % 4 = 0 THEN '' ELSE regexp_extract(message, '10[.]0[.][0-9]+[.][0-9]+') END AS ip, regexp_extract(message, 'user=(u[0-9]+)', 1) AS usr FROM board)""")
def security_context(spark, sf):
    rows = v.board(spark, sf)
    hidden = F.when(F.col("arrival") % 4 == 0, F.regexp_replace("message", r"from .*", "from localhost")).otherwise(F.col("message"))
    return bd.security_context(rows.withColumn("message", hidden)).select("arrival", "ip", "user")


_ADVICE = f"""CASE WHEN contains(lower(message), 'authentication') OR contains(lower(message), 'ssh') OR contains(lower(message), 'kerberos') THEN '{display.ADVICE_ACCESS.replace("'", "''")}'
  WHEN contains(lower(message), 'timeout') OR contains(lower(message), 'connection') THEN '{display.ADVICE_NETWORK}'
  WHEN contains(lower(message), 'error') OR contains(lower(message), 'failed') THEN '{display.ADVICE_SERVICE.replace("'", "''")}' ELSE '{display.ADVICE_DEFAULT.replace("'", "''")}' END"""


@query(f"{_B} SELECT arrival, {_ADVICE} AS recommendation FROM board")
def recommendation(spark, sf):
    return v.board(spark, sf).select("arrival", display.recommendation(F.col("message")).alias("recommendation"))


def _template(text: str, *args: str) -> str:
    pieces = text.replace("'", "''").split("%s")
    out = [f"'{pieces[0]}'"]
    for arg, piece in zip(args, pieces[1:]):
        out += [arg, f"'{piece}'"]
    return f"concat({', '.join(out)})"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query(f"""{_B} SELECT arrival, CASE WHEN status = 'ANOMALIE' THEN {_template(display.ANOMALY_ANALYSIS, 'ratio_text', "'2.0'", 'source', 'host')}
  ELSE {_template(display.NORMAL_ANALYSIS, 'ratio_text')} END AS analysis,
  CASE WHEN status = 'ANOMALIE' THEN {_quoted(display.ANOMALY_ACTION)} ELSE {_quoted(display.NORMAL_ACTION)} END AS action FROM board""")
def explain_rows(spark, sf):
    return bd.explain_rows(v.board(spark, sf)).select("arrival", "analysis", "action")


@query(f"""{_B} SELECT arrival, CASE WHEN status = 'ANOMALIE' THEN {_template(display.COMPACT_ANOMALY_ANALYSIS, v.sql_two_digits('ratio'), "'2.0'", 'source', 'host')}
  ELSE {_template(display.COMPACT_NORMAL_ANALYSIS, v.sql_two_digits('ratio'))} END AS analysis,
  CASE WHEN status = 'ANOMALIE' THEN {_quoted(display.COMPACT_ANOMALY_ACTION)} ELSE {_quoted(display.COMPACT_NORMAL_ACTION)} END AS action FROM board""")
def explain_rows_compact(spark, sf):
    return bd.explain_rows(v.board(spark, sf), compact=True).select("arrival", "analysis", "action")


_FIRST = "inc AS (SELECT * FROM board WHERE status = 'ANOMALIE' QUALIFY row_number() OVER (PARTITION BY timestamp, host, message ORDER BY arrival) = 1)"
_MAIL = ("concat('Bonjour,', chr(10), chr(10), 'Un incident a été détecté par Emberline.', chr(10), chr(10), "
         + ", ".join(f"'{label}', {column}, chr(10)" for label, column in display.MAIL_LINES)
         + ", chr(10), 'Log détecté :', chr(10), message, chr(10), chr(10), 'Parsing automatique :', chr(10), 'IP détectée          : ', "
         "regexp_extract(message, '10[.]0[.][0-9]+[.][0-9]+'), chr(10), 'Utilisateur détecté : ', regexp_extract(message, 'user=(u[0-9]+)', 1), "
         f"chr(10), chr(10), 'Recommandation :', chr(10), {_ADVICE}, chr(10), chr(10), 'Emberline', chr(10))")


@query(f"{_B}, {_FIRST} SELECT arrival, id, concat('[Emberline] Incident détecté - ', source, ' / ', host) AS subject, {_MAIL} AS body FROM inc")
def alert_outbox(spark, sf):
    return bd.alert_outbox(v.board(spark, sf))


@query(f"{_B} SELECT {_SHOWN} FROM board WHERE contains(lower(concat_ws(' ', timestamp, source, host, message, status)), 'timeout') AND source = 'ssh' AND ratio <= 2.0 ORDER BY arrival DESC LIMIT 200")
def search_board(spark, sf):
    return bd.search_board(v.board(spark, sf), "  TimeOut ", "ssh", "normal")


@query(f"""{_B} SELECT {_SHOWN} FROM board WHERE (regexp_matches(lower(message), 'u[0-9]*7 |session') OR regexp_matches(lower(source), 'u[0-9]*7 |session')
  OR regexp_matches(lower(host), 'u[0-9]*7 |session')) AND status = 'NORMAL' ORDER BY arrival DESC LIMIT 100""")
def search_board_regex(spark, sf):
    return bd.search_board_regex(v.board(spark, sf), "U[0-9]*7 |session", None, "NORMAL", 100)


@query(f"{_B} SELECT {_SHOWN} FROM board WHERE ratio > 2.0")
def critical_alerts(spark, sf):
    return bd.critical_alerts(v.board(spark, sf))


@query(f"{_B} SELECT {_SHOWN} FROM board WHERE status = 'ANOMALIE' ORDER BY arrival DESC LIMIT 10")
def latest_alerts(spark, sf):
    return bd.latest_alerts(v.board(spark, sf))


@query(f"{_B} SELECT {_SHOWN} FROM board ORDER BY ratio DESC, arrival LIMIT 22 OFFSET 44")
def page_board(spark, sf):
    return bd.page_board(v.board(spark, sf), "ratio", 2, descending=True)


@query(f"{_B} SELECT {_SHOWN}, CAST(row_number() OVER (ORDER BY arrival DESC) AS INTEGER) AS rank FROM board ORDER BY arrival DESC LIMIT 2000")
def newest_n(spark, sf):
    return bd.newest_n(v.board(spark, sf))


def _kpis(sources: str, frm: str = "board") -> str:
    return f"""SELECT count(*) AS total, count(*) FILTER (WHERE status = 'ANOMALIE') AS anomalies, round(avg(score), 6) AS mean_score, {sources} AS sources,
  round(CAST(count(*) FILTER (WHERE status = 'ANOMALIE') AS DOUBLE) / count(*) * 100, 1) AS anomaly_pct FROM {frm}"""


def _rounded(kpis):
    return kpis.withColumn("mean_score", F.round("mean_score", 6))


@query(f"{_B} {_kpis('''count(DISTINCT source) FILTER (WHERE status = 'ANOMALIE')''')}")
def board_kpis(spark, sf):
    return _rounded(bd.board_kpis(v.board(spark, sf)))


@query(f"{_B} {_kpis('count(DISTINCT source)')}")
def board_kpis_all_sources(spark, sf):
    return _rounded(bd.board_kpis(v.board(spark, sf), all_sources=True))


_CAPPED = f"(SELECT * FROM board ORDER BY arrival DESC LIMIT {bd.MAX_ROWS})"


@query(f"{_B}, k AS ({_kpis('''count(DISTINCT source) FILTER (WHERE status = 'ANOMALIE')''', _CAPPED)}) SELECT *, (SELECT count(*) FROM board) AS received FROM k")
def board_kpis_newest(spark, sf):
    """The KPIs of the rows the board keeps, beside the count of all messages received."""
    rows = v.board(spark, sf)
    return _rounded(bd.board_kpis(bd.newest_n(rows))).withColumn("received", rows.agg(F.count("*")).scalar())


@query(f"{_B} SELECT status, count(*) AS n FROM board GROUP BY status")
def status_distribution(spark, sf):
    return bd.status_distribution(v.board(spark, sf))


@query(f"{_B} SELECT source, count(*) AS n FROM board WHERE status = 'ANOMALIE' GROUP BY source ORDER BY n DESC, source LIMIT 8")
def top_sources(spark, sf):
    return bd.top_sources(v.board(spark, sf))


_RATE = "(SELECT avg(CASE WHEN status = 'ANOMALIE' THEN 1.0 ELSE 0.0 END) FROM board)"


@query(f"""{_B}, r AS (SELECT least(100.0, round({_RATE} * 70 + (SELECT avg(ratio) FROM (SELECT ratio FROM board ORDER BY arrival DESC LIMIT 200)) * 12, 1)) AS risk)
SELECT risk, CASE WHEN risk < 35 THEN 'green' WHEN risk < 70 THEN 'orange' ELSE 'red' END AS colour FROM r""")
def risk_score(spark, sf):
    return bd.risk_score(v.board(spark, sf))


@query(f"""{_B}, r AS (SELECT least(100, CAST(trunc({_RATE} * 60 + (SELECT avg(ratio) FROM board) * 20) AS BIGINT)) AS risk)
SELECT risk, CASE WHEN risk > 70 THEN 'red' WHEN risk > 40 THEN 'orange' ELSE 'green' END AS colour FROM r""")
def risk_score_all(spark, sf):
    return bd.risk_score_all(v.board(spark, sf))


@query(f"""{_B}, n AS (SELECT * FROM board ORDER BY arrival DESC LIMIT 80), a AS (SELECT count(*) AS analysed, count(*) FILTER (WHERE status = 'ANOMALIE') AS anomalies FROM n),
t AS (SELECT source FROM n WHERE status = 'ANOMALIE' GROUP BY source ORDER BY count(*) DESC, source LIMIT 1)
SELECT analysed, anomalies, coalesce((SELECT source FROM t), 'aucune source critique') AS top_source,
  CASE WHEN anomalies > 20 THEN 'ÉLEVÉ' WHEN anomalies > 5 THEN 'MOYEN' ELSE 'FAIBLE' END AS risk FROM a""")
def briefing(spark, sf):
    return bd.briefing(v.board(spark, sf))


@query(f"""{_B}, c AS (SELECT * FROM board WHERE ratio > 2.0) SELECT count(*) AS critical, coalesce(right(arg_max(timestamp, arrival), 8), '—') AS last_time,
  coalesce((SELECT source FROM c GROUP BY source ORDER BY count(*) DESC, source LIMIT 1), '—') AS top_source FROM c""")
def alert_strip(spark, sf):
    return bd.alert_strip(v.board(spark, sf))


@query(f"{_B} SELECT DISTINCT source FROM board WHERE source <> ''")
def source_options(spark, sf):
    return bd.source_options(v.board(spark, sf))


def _timeline(n: int, columns: str) -> str:
    return f"""{_B}, n AS (SELECT * FROM board ORDER BY arrival DESC LIMIT {n}), x AS (SELECT CAST(row_number() OVER (ORDER BY arrival) AS INTEGER) AS x,
  CAST(status = 'NORMAL' AS INTEGER) AS normal, CAST(status = 'ANOMALIE' AS INTEGER) AS anomaly, score FROM n) SELECT {columns} FROM x"""


@query(_timeline(60, "x, normal, anomaly"))
def status_timeline(spark, sf):
    return bd.timeline(v.board(spark, sf)).select("x", "normal", "anomaly")


@query(_timeline(50, "x, score"))
def score_timeline(spark, sf):
    return bd.timeline(v.board(spark, sf), bd.COMPACT_TIMELINE_ROWS).select("x", "score")


_PAYLOAD = "detected_at, source, host, anomaly_score, threshold, severity_ratio, model_version"


@query(f"""WITH {v.SQL_ANOMALIES} SELECT arrival, {_PAYLOAD} FROM anomalies
QUALIFY row_number() OVER (PARTITION BY substr(detected_at, 1, 19), source, host, anomaly_score ORDER BY arrival) = 1""")
def dedup_anomalies(spark, sf):
    """Every third message arrives again, later."""
    sent = v.ml_anomalies(spark, sf)
    again = sent.where(F.col("arrival") % 3 == 0).withColumn("arrival", F.col("arrival") + 100_000_000_000)
    return bd.dedup_anomalies(sent.unionByName(again)).select("arrival", *_PAYLOAD.split(", "))


@query(f"""{_B}, {_FIRST} SELECT {_SHOWN} FROM inc WHERE (timestamp, host, message) NOT IN (SELECT (timestamp, host, message) FROM board WHERE status = 'ANOMALIE' AND arrival % 2 = 0)""")
def new_incidents(spark, sf):
    rows = v.board(spark, sf)
    return bd.new_incidents(rows, rows.where(F.col("arrival") % 2 == 0)).select(*_SHOWN.split(", "))


@query(ORACLES["new_incidents"])
def new_incidents_filtered(spark, sf):
    """The same out of stored filters by day: history is scanned for possible hits alone.

    Filters and incidents are of a stored board, as they are of a lake; its windows are made once and not for each reading.
    """
    rows, folder = materialised(v.board(spark, sf, spread=True)), f"{scratch_folder(spark)}/filters"
    history = rows.where(F.col("arrival") % 2 == 0)
    bd.incident_filters(history.withColumn("day", F.to_date("timestamp")), "day").write.partitionBy("day").parquet(folder)
    return bd.new_incidents_filtered(rows, history, spark.read.parquet(folder)).select(*_SHOWN.split(", "))


@query(f"""{_B}, f AS (SELECT id, arrival % 3 <> 0 AS positive FROM board WHERE arrival % 10 = 0)
SELECT source, count(*) AS votes, count(*) FILTER (WHERE positive) AS positive, round(count(*) FILTER (WHERE positive) / count(*), 9) AS positive_rate
FROM board JOIN f USING (id) GROUP BY source""")
def feedback_by_source(spark, sf):
    rows = v.board(spark, sf)
    return bd.feedback_by_source(rows, v.feedback(rows)).withColumn("positive_rate", F.round("positive_rate", 9))


@query(f"WITH {v.SQL_BOARD} SELECT timestamp, source, host, message, score_text, ratio_text, status, model, id FROM board")
def display_projection(spark, sf):
    """The columns a board shows, with the model."""
    return bd.display_columns(v.board(spark, sf), with_model=True)


# ---- Infrastructure series -------------------------------------------------

_P = f"WITH {v.SQL_POINTS}"
_SERIES = ["resource"]


def _period(seconds: int) -> str:
    return f"CAST(floor(epoch(ts) / {seconds}) * {seconds} AS BIGINT)"


_STEPS = f"{_P}, steps AS (SELECT resource, ts, greatest(coalesce(counter - lag(counter) OVER (PARTITION BY resource ORDER BY ts, event_id), 0), 0) AS d FROM points)"


@query(f"{_P} SELECT resource, {_period(mt.MEAN_SECONDS)} AS period, round(avg(gauge), 10) AS value FROM points GROUP BY ALL")
def align_mean(spark, sf):
    points = v.infra_points(spark, sf).withColumn("value", F.col("gauge"))
    return mt.align_mean(points, _SERIES).withColumn("value", F.round("value", 10))


def _counter(spark, sf):
    return v.infra_points(spark, sf).withColumn("value", F.col("counter"))


@query(f"{_STEPS} SELECT resource, {_period(60)} AS period, round(sum(d) / 60, 6) AS value FROM steps GROUP BY ALL")
def align_rate(spark, sf):
    return mt.align_rate(_counter(spark, sf), _SERIES, ["ts", "event_id"]).withColumn("value", F.round("value", 6))


@query(f"{_STEPS} SELECT resource, {_period(300)} AS period, sum(d) AS value FROM steps GROUP BY ALL")
def align_delta(spark, sf):
    return mt.align_delta(_counter(spark, sf), _SERIES, ["ts", "event_id"])


@query(f"""{_P}, a AS (SELECT resource, {_period(mt.MEAN_SECONDS)} AS period, avg(gauge) AS value FROM points GROUP BY ALL),
o AS (SELECT *, period / {mt.MEAN_SECONDS} - row_number() OVER (PARTITION BY resource ORDER BY period) AS run FROM a WHERE value > 45)
SELECT resource, min(period) AS first_period, max(period) AS last_period, count(*) AS periods, round(max(value), 10) AS peak FROM o GROUP BY resource, run HAVING count(*) >= 2""")
def sustained_alert(spark, sf):
    points = v.infra_points(spark, sf).withColumn("value", F.col("gauge"))
    found = mt.sustained_alert(mt.align_mean(points, _SERIES), _SERIES, 45.0, mt.MEAN_SECONDS, 2)
    return found.withColumn("peak", F.round("peak", 10))


_RUNS = """o AS (SELECT *, period / {seconds} - row_number() OVER (PARTITION BY resource ORDER BY period) AS run FROM a WHERE value > {limit})
SELECT resource, min(period) AS first_period, max(period) AS last_period, count(*) AS periods, {peak} AS peak FROM o GROUP BY resource, run HAVING count(*) >= {least}"""


@query(f"""{_P}, a AS (SELECT resource, {_period(mt.MEAN_SECONDS)} AS period, avg(gauge * 200000000) AS value FROM points GROUP BY ALL),
{_RUNS.format(seconds=mt.MEAN_SECONDS, limit=mt.DISK_LIMIT_BYTES, peak="round(max(value), 2)", least=2)}""")
def disk_pressure(spark, sf):
    """Mean bytes per minute above the disk limit for two minutes."""
    points = v.infra_points(spark, sf).withColumn("value", F.col("gauge") * 200_000_000)
    return mt.disk_pressure(points, _SERIES).withColumn("peak", F.round("peak", 2))


@query(f"""{_STEPS}, a AS (SELECT resource, {_period(300)} AS period, sum(d) AS value FROM steps GROUP BY ALL),
{_RUNS.format(seconds=300, limit=mt.RESTART_LIMIT, peak="max(value)", least=1)}""")
def restart_alert(spark, sf):
    return mt.restart_alert(_counter(spark, sf), _SERIES, ["ts", "event_id"])
