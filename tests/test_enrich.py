"""ETL transform, messages, lake and counters."""

import json
import os

import pytest
from pyspark.sql import Observation, functions as F

from emberline.operators import enrich as en, mixing
from emberline.schemas import ENRICHED_FIELDS, ENTRY_FIELDS, FEEDBACK_SCHEMA, RAW_SCHEMA
from emberline.sinks import lake as lake_sink, topics as sink
from emberline.sources import lake, topics

NOW = "2024-02-01 00:00:00"
BASE = {
    "timestamp": "2015-10-17T15:37:56.547", "source": "hadoop", "host": "node-01", "level": "INFO",
    "component": "org.apache.hadoop.App", "message": "All systems nominal", "raw": "raw text",
}


def messages(spark, *records):
    rows = [(r if isinstance(r, str) else json.dumps(r),) for r in records]
    return spark.createDataFrame(rows, "value string") if rows else spark.createDataFrame([], "value string")


def transform(spark, *records):
    return en.enrich(topics.decode(messages(spark, *records), RAW_SCHEMA), NOW, keys="_keys")


def only(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_partition_values(spark):
    r = only(transform(spark, BASE))
    assert (r["year"], r["month"], r["day"], r["hour"]) == (2015, 10, 17, 15)
    assert r["timestamp"] == "2015-10-17T15:37:56.547000+00:00" and not r["timestamp_fallback"]
    assert set(ENRICHED_FIELDS) <= set(r.asDict()) and r["processed_at"] == "2024-02-01T00:00:00+00:00"


@pytest.mark.parametrize("level,want,flag", [
    ("INFO", "INFO", False), ("ERROR", "ERROR", True), ("fatal", "FATAL", True), ("WARNING", "WARN", False), ("odd", "ODD", False), (None, None, False)])
def test_levels(spark, level, want, flag):
    r = only(transform(spark, {**BASE, "level": level}))
    assert (r["level"], r["is_anomaly_candidate"]) == (want, flag)


def test_invalid_records(spark):
    without = {k: x for k, x in BASE.items() if k != "raw"}
    bad = [{"source": "linux", "message": "incomplete"}, {**BASE, "source": ""}, {**BASE, "source": None}, without]
    assert transform(spark, *bad).count() == 0
    decoded = topics.decode(messages(spark, *bad, BASE), RAW_SCHEMA)
    assert en.rejected(decoded, "_keys").count() == 4 and en.validate(decoded, "_keys").count() == 1
    assert transform(spark, {**BASE, "raw": None, "host": None}).count() == 1


def test_empty_batch_keeps_the_schema(spark):
    df = transform(spark)
    assert df.count() == 0 and set(ENRICHED_FIELDS) <= set(df.columns)


def test_fallback_times(spark):
    for stamp in ("2015-10-17T15:37:56+02:00", "2015-10-17", "x", None):
        r = only(transform(spark, {**BASE, "timestamp": stamp}))
        assert r["timestamp_fallback"] and r["timestamp"] == "2024-02-01T00:00:00+00:00"


def test_quarantine(spark):
    df = messages(spark, "{bad", "[1]", "7", "", BASE, '{"a": {"b": [1, 2}}')
    reasons = {r["value"]: r["reason"] for r in topics.quarantine(df).collect()}
    assert reasons == {"{bad": "malformed", "[1]": "not an object", "7": "not an object", "": "malformed", '{"a": {"b": [1, 2}}': "malformed"}
    assert topics.decode(df, RAW_SCHEMA).count() == 1


def test_messages(spark):
    df = transform(spark, BASE, {**BASE, "level": "ERROR"})
    assert {r["key"] for r in sink.processed_messages(df).collect()} == {"hadoop"}
    r = only(sink.rule_anomaly_messages(df, "now"))
    body = json.loads(r["value"])
    assert r["key"] == "ERROR" and body["anomaly_published_at"] == "now" and list(body)[:13] == ENRICHED_FIELDS


def test_counters(spark):
    r = only(en.batch_counters(transform(spark, BASE, {**BASE, "level": "ERROR"}, {**BASE, "level": "FATAL"}, BASE)))
    assert (r["records"], r["anomalies"], r["anomaly_pct"]) == (4, 2, 50.0)
    assert only(en.batch_counters(transform(spark)))["anomaly_pct"] is None


def test_lake_round_trip_and_pruning(spark, tmp_path):
    days = [{**BASE, "timestamp": f"2015-0{m}-0{d}T01:00:00", "source": s} for m in (1, 2) for d in (1, 2, 3) for s in ("linux", "ssh")]
    df = transform(spark, *days, *days)
    root = str(tmp_path / "lake")
    lake_sink.write_lake(df, root)
    lake_sink.write_lake(df.where("source = 'ssh'"), root)
    assert os.path.isdir(f"{root}/source=ssh/year=2015/month=02/day=03")
    back = lake.scan_lake(spark, root)
    assert back.count() == 36 and back.schema["month"].dataType.simpleString() == "int"
    assert back.select(ENRICHED_FIELDS).where("source = 'linux'").exceptAll(df.select(ENRICHED_FIELDS)).count() == 0
    pruned = back.where("source = 'ssh' and year = 2015 and month = 2").select("message")
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in plan and "ReadSchema: struct<message:string>" in plan
    files = {r[0] for r in pruned.select(F.input_file_name()).distinct().collect()}
    assert pruned.count() == 12 and all("source=ssh" in f and "month=02" in f for f in files)
    with pytest.raises(Exception):
        lake.scan_lake(spark, str(tmp_path / "none")).count()


def test_batch_folder_is_overwritten_on_replay(spark, tmp_path):
    df, root = transform(spark, BASE, {**BASE, "source": "ssh"}), str(tmp_path / "lake")
    for batch in (0, 1, 1):
        lake_sink.write_lake(df, root, batch)
    assert lake.scan_lake(spark, root).count() == 4


def test_round_robin_order_and_resume(spark):
    rows = [("a", 1, "a1"), ("a", 5, "a2"), ("a", 9, "a3"), ("b", 2, "b1"), ("c", 3, "c1"), ("c", 4, "c2"), ("zz", 6, "z1"), ("yy", 7, "y1"), (None, 8, "n1")]
    df = spark.createDataFrame(rows, "source string, pos bigint, name string")
    mixed = mixing.round_robin(df, ["a", "b", "c"], "pos", chunk=2)
    assert [r["name"] for r in mixed.orderBy("slot").collect()] == ["a1", "b1", "c1", "n1", "y1", "z1", "a2", "c2", "a3"]
    assert sorted(r["slot"] for r in mixed.collect()) == list(range(9))
    assert [r["name"] for r in mixing.resume(mixed, 5, 3).orderBy("slot").collect()] == ["z1", "a2", "c2"]


def test_feedback_appends(spark, tmp_path):
    row = spark.createDataFrame([("t", "positive", "1", "s", "h", "é", "0.1", "1.0x", None)], FEEDBACK_SCHEMA)
    for _ in range(2):
        sink.append_feedback(row, str(tmp_path / "fb"))
    assert spark.read.schema(FEEDBACK_SCHEMA).json(str(tmp_path / "fb")).where("message = 'é' and statut is null").count() == 2


def test_message_folder_round_trip(spark, tmp_path):
    sent = sink.raw_messages(spark.createDataFrame([tuple(BASE[c] for c in ENTRY_FIELDS)], RAW_SCHEMA))
    sink.write_messages(sent, str(tmp_path / "t"))
    assert topics.read_folder(spark, str(tmp_path / "t")).exceptAll(sent).count() == 0


def test_observed_counters_need_no_second_pass(spark):
    seen = Observation("etl")
    en.observe_counters(transform(spark, BASE, {**BASE, "level": "ERROR"}), seen).collect()
    assert seen.get == {"records": 2, "anomalies": 1}
