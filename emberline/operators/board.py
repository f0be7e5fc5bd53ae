"""Monitoring board: what an operator sees of the anomaly messages.

``arrival`` orders messages as received (offset or running number).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import display
from ..functions.display import ANOMALY, DEFAULT_ALERT_RATIO, NORMAL
from .seen import key_filters, unseen

# --- Fixed values: sizes of the board's views. ---
MAX_ROWS = 2000
TIMELINE_ROWS = 60
COMPACT_TIMELINE_ROWS = 50
TOP_SOURCES = 8
LATEST_ALERTS = 10
RISK_ROWS = 200
BRIEFING_ROWS = 80
PAGE_ROWS = 22
ALERT_PAGE_ROWS = 30
DEFAULT_LIMIT = 200
NO_SOURCE = "aucune source critique"
RISK_HIGH, RISK_MEDIUM, RISK_LOW = "ÉLEVÉ", "MOYEN", "FAIBLE"
# --- End of fixed values. ---


def message_text(width: int = display.MESSAGE_WIDTH, otherwise: Column | None = None) -> Column:
    """Message of the last record, or ``otherwise`` where there is no sequence."""
    last = F.try_element_at("sequence", F.lit(-1))["message"]
    spare = F.lit(None).cast("string") if otherwise is None else otherwise
    shown = F.when(F.coalesce(F.size("sequence"), F.lit(0)) > 0, last).otherwise(spare)
    return F.substring(F.coalesce(shown, F.lit("")), 1, width)


def board_rows(anomalies: DataFrame, alert_ratio: float = DEFAULT_ALERT_RATIO, compact: bool = False) -> DataFrame:
    """Display rows of anomaly messages.

    ``compact``: shorter messages, messages without sequence dropped, threshold
    default 0. Numbers stay beside their display text.
    """
    width = display.COMPACT_MESSAGE_WIDTH if compact else display.MESSAGE_WIDTH
    rows = anomalies.where(F.size("sequence") > 0) if compact else anomalies
    spare = F.col("message") if "message" in rows.columns and not compact else None
    score = display.safe_float(F.col("anomaly_score"))
    ratio = display.safe_float(F.col("severity_ratio"))
    limit = display.safe_float(F.col("threshold"), 0.0 if compact else alert_ratio)
    return rows.select(
        F.concat_ws("_", "detected_at", "arrival").alias("id"),
        "arrival",
        display.clock(F.col("detected_at")).alias("timestamp"),
        F.coalesce("source", F.lit("unknown")).alias("source"),
        F.coalesce("host", F.lit("unknown")).alias("host"),
        message_text(width, spare).alias("message"),
        score.alias("score"), ratio.alias("ratio"), limit.alias("threshold"),
        F.format_string("%.2f", score).alias("score_text"),
        F.format_string("%.2fx", ratio).alias("ratio_text"),
        F.coalesce("model_version", F.lit("lstm_v1")).alias("model"),
        display.status(ratio, alert_ratio).alias("status"),
    )


def dedup_anomalies(anomalies: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Earliest of the messages that share second, source, host and score.

    An aggregate, not a ranking: copies collapse before the shuffle.
    """
    second = F.substring("detected_at", 1, 19)
    rest = [c for c in anomalies.columns if c != arrival]
    first = anomalies.groupBy(second.alias("_s"), F.col("source").alias("_a"), F.col("host").alias("_b"),
                              F.col("anomaly_score").alias("_c")).agg(F.min_by(F.struct(arrival, *rest), arrival).alias("_row"))
    return first.select("_row.*").select(*anomalies.columns)


def newest_n(board: DataFrame, n: int = MAX_ROWS) -> DataFrame:
    """The newest ``n`` rows with ``rank`` 1 for the newest (a top-k, then a rank over k rows)."""
    top = board.orderBy(F.desc("arrival")).limit(n)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("arrival"))))


def search_board(board: DataFrame, search: str = "", source: str | None = None, level: str = "all",
                 limit: int = DEFAULT_LIMIT, alert_ratio: float = DEFAULT_ALERT_RATIO) -> DataFrame:
    """Newest matches of a case-blind substring over the shown text, a source and a severity."""
    out = board
    wanted = (search or "").lower().strip()
    if wanted:
        hay = F.lower(F.concat_ws(" ", "timestamp", "source", "host", "message", "status"))
        out = out.where(hay.contains(wanted))
    if source:
        out = out.where(F.col("source") == source)
    if level == "high":
        out = out.where(F.col("ratio") > alert_ratio)
    if level == "normal":
        out = out.where(F.col("ratio") <= alert_ratio)
    return out.orderBy(F.desc("arrival")).limit(limit)


def search_board_regex(board: DataFrame, pattern: str = "", source: str | None = None, status: str | None = None,
                       limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Newest matches of a pattern in message, source or host."""
    out = board
    if pattern:
        p = pattern.lower()
        out = out.where(F.lower("message").rlike(p) | F.lower("source").rlike(p) | F.lower("host").rlike(p))
    if source:
        out = out.where(F.col("source") == source)
    if status:
        out = out.where(F.col("status") == status)
    return out.orderBy(F.desc("arrival")).limit(limit)


def critical_alerts(board: DataFrame, alert_ratio: float = DEFAULT_ALERT_RATIO) -> DataFrame:
    return board.where(F.col("ratio") > alert_ratio)


def latest_alerts(board: DataFrame, n: int = LATEST_ALERTS) -> DataFrame:
    return board.where(F.col("status") == ANOMALY).orderBy(F.desc("arrival")).limit(n)


def page_board(board: DataFrame, sort: str, page: int, size: int = PAGE_ROWS, descending: bool = False) -> DataFrame:
    key = F.desc(sort) if descending else F.asc(sort)
    return board.orderBy(key, "arrival").offset(page * size).limit(size)


def is_anomaly() -> Column:
    return F.col("status") == ANOMALY


def _pct(share: Column) -> Column:
    return F.round(F.coalesce(share, F.lit(0.0)) * 100, 1)


def board_kpis(board: DataFrame, all_sources: bool = False) -> DataFrame:
    """Totals, mean score, sources (of anomalies, or of all rows) and anomaly percentage."""
    hit = is_anomaly()
    named = F.nullif(F.col("source"), F.lit(""))
    sources = F.col("source") if all_sources else F.when(hit, named)
    return board.agg(
        F.count("*").alias("total"), F.count_if(hit).alias("anomalies"),
        F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean_score"), F.count_distinct(sources).alias("sources"),
        _pct(F.avg(hit.cast("double"))).alias("anomaly_pct"))


def status_distribution(board: DataFrame) -> DataFrame:
    return board.groupBy("status").agg(F.count("*").alias("n"))


def top_sources(board: DataFrame, n: int = TOP_SOURCES) -> DataFrame:
    return (
        board.where(is_anomaly()).groupBy("source").agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "source").limit(n)
    )


def _colour(value: Column, low: float, high: float, strict: bool) -> Column:
    if strict:
        return F.when(value > high, F.lit("red")).when(value > low, F.lit("orange")).otherwise(F.lit("green"))
    return F.when(value < low, F.lit("green")).when(value < high, F.lit("orange")).otherwise(F.lit("red"))


def risk_score(board: DataFrame, recent: int = RISK_ROWS) -> DataFrame:
    """70 x anomaly rate plus 12 x mean ratio of the newest rows, at most 100."""
    rate = board.agg(F.coalesce(F.avg(is_anomaly().cast("double")), F.lit(0.0)).alias("rate"))
    newest = board.orderBy(F.desc("arrival")).limit(recent)
    ratio = newest.agg(F.coalesce(F.avg("ratio"), F.lit(0.0)))
    value = F.least(F.lit(100.0), F.round(F.col("rate") * 70 + F.col("mean_ratio") * 12, 1))
    return rate.withColumn("mean_ratio", ratio.scalar()).select(value.alias("risk")).withColumn(
        "colour", _colour(F.col("risk"), 35, 70, strict=False))


def risk_score_all(board: DataFrame) -> DataFrame:
    """60 x anomaly rate plus 20 x mean ratio of all rows, cut to a whole number, at most 100."""
    rate = F.coalesce(F.avg(is_anomaly().cast("double")), F.lit(0.0))
    ratio = F.coalesce(F.avg("ratio"), F.lit(0.0))
    value = F.least(F.lit(100).cast("bigint"), (rate * 60 + ratio * 20).cast("bigint"))
    return board.agg(value.alias("risk")).withColumn("colour", _colour(F.col("risk"), 40, 70, strict=True))


def briefing(board: DataFrame, recent: int = BRIEFING_ROWS) -> DataFrame:
    """Anomalies, most touched source and overall risk of the newest rows."""
    newest = board.orderBy(F.desc("arrival")).limit(recent)
    by_source = newest.groupBy("source").agg(F.count("*").alias("n"), F.count_if(is_anomaly()).alias("hits"))
    top = F.min_by("source", F.when(F.col("hits") > 0, F.struct((-F.col("hits")).alias("h"), F.col("source").alias("s"))))
    out = by_source.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("analysed"), F.coalesce(F.sum("hits"), F.lit(0)).alias("anomalies"),
        F.coalesce(top, F.lit(NO_SOURCE)).alias("top_source"))
    risk = F.when(F.col("anomalies") > 20, F.lit(RISK_HIGH)).when(F.col("anomalies") > 5, F.lit(RISK_MEDIUM))
    return out.withColumn("risk", risk.otherwise(F.lit(RISK_LOW)))


def alert_strip(board: DataFrame, alert_ratio: float = DEFAULT_ALERT_RATIO) -> DataFrame:
    """Critical rows: how many, time of day of the last, most touched source."""
    by_source = critical_alerts(board, alert_ratio).groupBy("source").agg(
        F.count("*").alias("n"), F.max(F.struct("arrival", "timestamp")).alias("last"))
    top = F.min_by("source", F.struct((-F.col("n")).alias("c"), F.col("source").alias("s")))
    return by_source.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("critical"),
        F.coalesce(F.right(F.max("last")["timestamp"], F.lit(8)), F.lit("—")).alias("last_time"),
        F.coalesce(top, F.lit("—")).alias("top_source"))


def source_options(board: DataFrame) -> DataFrame:
    return board.where(F.col("source") != "").select("source").distinct().orderBy("source")


def timeline(board: DataFrame, n: int = TIMELINE_ROWS) -> DataFrame:
    """The newest rows, oldest first, numbered from 1, with 0/1 series and the score."""
    top = board.orderBy(F.desc("arrival")).limit(n)
    return top.select(
        F.row_number().over(W.orderBy("arrival")).alias("x"),
        (F.col("status") == NORMAL).cast("int").alias("normal"),
        (F.col("status") == ANOMALY).cast("int").alias("anomaly"),
        "score",
    )


def explain_rows(board: DataFrame, alert_ratio: float = DEFAULT_ALERT_RATIO, compact: bool = False) -> DataFrame:
    """Adds the explanation and advice shown for a selected row."""
    ratio = F.format_string("%.2f", "ratio") if compact else F.col("ratio_text")
    return board.withColumns({
        "analysis": display.analysis(F.col("status"), ratio, F.col("source"), F.col("host"), alert_ratio, compact),
        "action": display.action(F.col("status"), compact),
    })


def security_context(board: DataFrame) -> DataFrame:
    return board.withColumns({"ip": display.first_ip(F.col("message")), "user": display.first_user(F.col("message"))})


def alert_outbox(board: DataFrame, product: str = "Emberline", signature: str | None = None) -> DataFrame:
    """Subject and body of one mail per incident, for a mailer to send."""
    rows = security_context(first_incidents(board))
    lines = [F.lit(f"Bonjour,\n\nUn incident a été détecté par {product}.\n\n")]
    for label, column in display.MAIL_LINES:
        lines += [F.lit(label), F.coalesce(F.col(column), F.lit("—")), F.lit("\n")]
    lines += [
        F.lit("\nLog détecté :\n"), F.coalesce("message", F.lit("—")), F.lit("\n\nParsing automatique :\n"),
        F.lit("IP détectée          : "), F.col("ip"), F.lit("\nUtilisateur détecté : "), F.col("user"),
        F.lit("\n\nRecommandation :\n"), display.recommendation(F.col("message")),
        F.lit(f"\n\n{signature or product}\n"),
    ]
    subject = F.concat(F.lit(f"[{product}] Incident détecté - "), F.col("source"), F.lit(" / "), F.col("host"))
    return rows.select("id", "arrival", subject.alias("subject"), F.concat(*lines).alias("body"))


INCIDENT_KEY = ["timestamp", "host", "message"]


def first_incidents(board: DataFrame) -> DataFrame:
    """One row, the first to arrive, per incident among the anomalies."""
    rest = [c for c in board.columns if c != "arrival"]
    keyed = board.where(is_anomaly()).groupBy(*[F.col(c).alias(f"_{c}") for c in INCIDENT_KEY])
    return keyed.agg(F.min_by(F.struct("arrival", *rest), "arrival").alias("_row")).select("_row.*").select(*board.columns)


def new_incidents(board: DataFrame, history: DataFrame) -> DataFrame:
    """Incidents no earlier row had; both sides hold an incident once before they meet."""
    known = history.where(is_anomaly()).select(*INCIDENT_KEY).distinct()
    return first_incidents(board).join(known, INCIDENT_KEY, "left_anti")


def incident_filters(history: DataFrame, *by: str) -> DataFrame:
    """Stored filters of the incidents of a board's history, by day for example."""
    return key_filters(history.where(is_anomaly()), INCIDENT_KEY, *by)


def new_incidents_filtered(board: DataFrame, history: DataFrame, filters: DataFrame) -> DataFrame:
    """The same, where filters of the history are stored: history is scanned for possible hits alone, and not shuffled."""
    return unseen(first_incidents(board), history.where(is_anomaly()), filters, INCIDENT_KEY)


def feedback_records(board: DataFrame, feedback: Column, at: Column) -> DataFrame:
    return board.select(
        at.alias("timestamp"), feedback.alias("feedback"), F.col("id").alias("log_id"), "source", "host", "message",
        F.col("score_text").alias("score_ia"), F.col("ratio_text").alias("ratio"), F.col("status").alias("statut"))


def feedback_by_source(board: DataFrame, feedback: DataFrame) -> DataFrame:
    """Votes per source. Votes are summed per row first, so a much-voted row joins once."""
    votes = feedback.groupBy(F.col("log_id").alias("id")).agg(
        F.count_if(F.col("feedback") == "positive").alias("_p"), F.count("*").alias("_n"))
    return (
        board.select("id", "source").join(votes, "id").groupBy("source")
        .agg(F.sum("_n").alias("votes"), F.sum("_p").alias("positive"), (F.sum("_p") / F.sum("_n")).alias("positive_rate"))
    )


DISPLAY_COLUMNS = ["timestamp", "source", "host", "message", "score_text", "ratio_text", "status"]


def display_columns(board: DataFrame, with_model: bool = False) -> DataFrame:
    return board.select(*DISPLAY_COLUMNS, *(["model"] if with_model else []), "id")
