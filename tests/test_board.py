"""Board rows and incident handling on hand-made messages."""

import json

from pyspark.sql import functions as F

from emberline.operators import board as bd
from emberline.schemas import ANOMALY_SCHEMA
from emberline.streaming import board as sb

SCHEMA = "arrival bigint, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ANOMALY_SCHEMA.fields)


def anomalies(spark, *rows):
    base = dict(detected_at="2024-01-01T10:20:30.123456+00:00", source="ssh", host="h", anomaly_score=1.5, threshold=1.0,
                severity_ratio=1.5, sequence=[("t", "ERROR", "first"), ("t", "ERROR", "last user=bob.x from 1.2.3.4")], model_version="m")
    data = [tuple({**base, "arrival": i, **r}[c] for c in ["arrival", *ANOMALY_SCHEMA.names]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA)


def only(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_board_row(spark):
    r = only(bd.board_rows(anomalies(spark, {"severity_ratio": 2.5})))
    assert (r["timestamp"], r["message"], r["status"]) == ("2024-01-01 10:20:30", "last user=bob.x from 1.2.3.4", "ANOMALIE")
    assert (r["score_text"], r["ratio_text"], r["id"]) == ("1.50", "2.50x", "2024-01-01T10:20:30.123456+00:00_0")


def test_defaults_and_widths(spark):
    df = anomalies(spark, {"source": None, "host": None, "model_version": None, "anomaly_score": None, "severity_ratio": None,
                           "threshold": None, "sequence": [("t", "E", "x" * 300)], "detected_at": None})
    r = only(bd.board_rows(df))
    assert (r["source"], r["host"], r["model"], r["timestamp"]) == ("unknown", "unknown", "lstm_v1", "")
    assert (r["score"], r["ratio"], r["threshold"], len(r["message"])) == (0.0, 0.0, 2.0, 240)
    assert len(only(bd.board_rows(df, compact=True))["message"]) == 180
    empty = anomalies(spark, {"sequence": []})
    assert only(bd.board_rows(empty))["message"] == "" and bd.board_rows(empty, compact=True).count() == 0


def test_status_is_strict(spark):
    rows = bd.board_rows(anomalies(spark, {"severity_ratio": 2.0}, {"severity_ratio": 2.001})).orderBy("arrival").collect()
    assert [r["status"] for r in rows] == ["NORMAL", "ANOMALIE"]
    assert bd.board_rows(anomalies(spark, {"severity_ratio": 1.4}), alert_ratio=1.3).first()["status"] == "ANOMALIE"


def test_security_context_and_advice(spark):
    rows = bd.board_rows(anomalies(spark, {}, {"sequence": [("t", "E", "no address 1.2.3 userx=1")]})).orderBy("arrival")
    got = bd.security_context(rows).orderBy("arrival").collect()
    assert (got[0]["ip"], got[0]["user"]) == ("1.2.3.4", "bob.x")
    assert (got[1]["ip"], got[1]["user"]) == ("non détectée", "non détecté")


def test_empty_board(spark):
    board = bd.board_rows(anomalies(spark))
    kpis = only(bd.board_kpis(board))
    assert (kpis["total"], kpis["anomalies"], kpis["mean_score"], kpis["anomaly_pct"]) == (0, 0, 0.0, 0.0)
    assert only(bd.risk_score(board))["risk"] == 0.0 and only(bd.risk_score_all(board))["risk"] == 0
    brief = only(bd.briefing(board))
    assert (brief["analysed"], brief["top_source"], brief["risk"]) == (0, "aucune source critique", "FAIBLE")
    strip = only(bd.alert_strip(board))
    assert (strip["critical"], strip["last_time"], strip["top_source"]) == (0, "—", "—")
    assert bd.timeline(board).count() == 0


def test_briefing_levels_and_top_source(spark):
    rows = [{"severity_ratio": 3.0 if i % 2 else 1.0, "source": "b" if i % 4 == 1 else "a" if i % 2 else "c"} for i in range(100)]
    brief = only(bd.briefing(bd.board_rows(anomalies(spark, *rows))))
    assert (brief["analysed"], brief["anomalies"], brief["risk"], brief["top_source"]) == (80, 40, "ÉLEVÉ", "a")


def test_dedup_keeps_the_earliest(spark):
    df = anomalies(spark, {}, {}, {"detected_at": "2024-01-01T10:20:30.9+00:00"}, {"host": None}, {"host": None}, {"anomaly_score": 1.6})
    assert sorted(r["arrival"] for r in bd.dedup_anomalies(df).collect()) == [0, 3, 5]


def test_incidents(spark):
    board = bd.board_rows(anomalies(spark, *[{"severity_ratio": 3.0, "host": h} for h in "aabbc"], {"host": "d"}))
    assert sorted(r["arrival"] for r in bd.first_incidents(board).collect()) == [0, 2, 4]
    new = bd.new_incidents(board, board.where(F.col("host") == "b"))
    assert sorted(r["arrival"] for r in new.collect()) == [0, 4]
    mail = bd.alert_outbox(board, "Watch").orderBy("arrival").first()
    assert mail["subject"] == "[Watch] Incident détecté - ssh / a" and "Utilisateur détecté : bob.x\n" in mail["body"]


def test_search(spark):
    board = bd.board_rows(anomalies(spark, {"host": "Web1"}, {"severity_ratio": 3.0}, {"source": "linux"}))
    ids = lambda df: [r["arrival"] for r in df.collect()]
    assert ids(bd.search_board(board, "WEB1")) == [0] and ids(bd.search_board(board, " anomalie ")) == [1]
    assert ids(bd.search_board(board, "web.")) == [] and ids(bd.search_board_regex(board, "web.")) == [0]
    assert ids(bd.search_board(board, level="normal", limit=1)) == [2] and ids(bd.search_board(board, source="ssh", level="high")) == [1]
    assert ids(bd.search_board_regex(board, status="ANOMALIE")) == [1]
    assert bd.display_columns(board, True).columns == [*bd.DISPLAY_COLUMNS, "model", "id"]


def test_votes_count_once_per_row(spark):
    board = bd.board_rows(anomalies(spark, {}, {"source": "linux"}))
    votes = bd.feedback_records(board, F.lit("positive"), F.lit("t"))
    votes = votes.unionByName(votes).unionByName(votes.withColumn("feedback", F.lit("negative")))
    got = {r["source"]: (r["votes"], r["positive"]) for r in bd.feedback_by_source(board, votes).collect()}
    assert got == {"ssh": (3, 2), "linux": (3, 2)}


def test_messages_are_read_leniently(spark):
    texts = [
        {"detected_at": "2024-01-01T00:00:00", "anomaly_score": "1.5", "severity_ratio": 3, "threshold": "abc", "message": "spare"},
        {"sequence": [{"message": "one"}, {"message": "two"}], "message": "spare", "severity_ratio": None},
        {"sequence": [{"level": "x"}], "message": "spare"}, "{broken", "[]",
    ]
    rows = [(i, t if isinstance(t, str) else json.dumps(t)) for i, t in enumerate(texts)]
    board = bd.board_rows(sb.anomaly_rows(spark.createDataFrame(rows, "offset bigint, value string"), F.col("offset"))).orderBy("arrival").collect()
    assert [r["message"] for r in board] == ["spare", "two", ""]
    assert (board[0]["score"], board[0]["ratio"], board[0]["threshold"], board[0]["status"]) == (1.5, 3.0, 2.0, "ANOMALIE")
    assert (board[1]["score"], board[1]["ratio"], board[1]["host"], board[1]["status"]) == (0.0, 0.0, "unknown", "NORMAL")


def test_equal_offsets_of_two_partitions_stay_apart(spark):
    """Ids and order come from time, partition and offset, so one vote counts once."""
    value = json.dumps({"detected_at": "2024-01-01T00:00:00", "source": "ssh", "host": "h", "anomaly_score": 3, "severity_ratio": 3, "message": "m"})
    rows = [("k", value, p, 5, "2024-01-01 00:00:01") for p in (0, 1)]
    messages = spark.createDataFrame(rows, "key string, value string, partition int, offset bigint, at string").withColumn("timestamp", F.col("at").cast("timestamp"))
    board = bd.board_rows(sb.anomaly_rows(messages))
    ids = sorted(r["id"] for r in board.collect())
    assert len(set(ids)) == 2 and ids == [r["id"] for r in board.orderBy("arrival").collect()]
    votes = bd.feedback_by_source(board, spark.createDataFrame([(ids[0], "positive")], "log_id string, feedback string"))
    assert votes.first()["votes"] == 1
