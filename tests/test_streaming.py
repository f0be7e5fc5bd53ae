"""Streams over folders: same results as batch, restarts lose and repeat nothing."""

import json
import os
import random
from datetime import datetime, timedelta, timezone
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import Window as W, functions as F

from emberline.operators import board as bd, metrics, windows as wd
from emberline.plans import io_queries, training, views as v
from emberline.schemas import ANOMALY_SCHEMA, ENRICHED_SCHEMA
from emberline.sinks import topics as sink
from emberline.sources import lake, topics
from emberline.streaming import board as sb, etl, late, scoring as ss, series, windows as sw

DRAIN = {"availableNow": True}


def write_parts(df, path, parts, order):
    """Files named in time order, one per part."""
    rows = df.orderBy(order).collect()
    size = -(-len(rows) // parts)
    os.makedirs(path, exist_ok=True)
    for i in range(parts):
        with open(f"{path}/part-{i:03d}.json", "w") as f:
            for r in rows[i * size: (i + 1) * size]:
                f.write(json.dumps({"key": r["key"], "value": r["value"]}) + "\n")
        at = 1_700_000_000 + i
        os.utime(f"{path}/part-{i:03d}.json", (at, at))


@pytest.fixture(scope="module")
def enriched_rows(spark, sf):
    return v.enriched(spark, sf).orderBy("event_time", "event_id").cache()


def drop_files(spark, parts, folder, first=0):
    """Each frame as one file, in order of arrival."""
    for i, part in enumerate(parts, first):
        part.coalesce(1).write.parquet(f"{folder}-{i}")
        name = next(n for n in os.listdir(f"{folder}-{i}") if n.endswith(".parquet"))
        os.makedirs(folder, exist_ok=True)
        os.replace(f"{folder}-{i}/{name}", f"{folder}/p{i}.parquet")
        os.utime(f"{folder}/p{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))


def drained(spark, schema, build, tmp_path, out="out"):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = build(stream)
    query = (found.writeStream.format("parquet").option("path", str(tmp_path / out))
             .option("checkpointLocation", str(tmp_path / f"cp-{out}")).trigger(**DRAIN).start())
    query.awaitTermination()
    return spark.read.schema(found.schema).parquet(str(tmp_path / out)), query


COLUMNS = ["event_id", "event_time", "timestamp", "source", "host", "level", "message", "hour", "is_anomaly_candidate"]


def far(rows, **values):
    """One row long after all others."""
    return rows.limit(1).withColumns({"event_time": F.lit("2100-01-01").cast("timestamp"), "source": F.lit("~"), **values})


def test_stream_windows_equal_batch_out_of_order_and_restarted(spark, enriched_rows, tmp_path):
    """Rows up to two hours out of order over four micro-batches, a restart after two of them."""
    rows = enriched_rows.select(*COLUMNS).withColumn(
        "_at", F.unix_seconds("event_time") + F.pmod(F.xxhash64("event_id"), F.lit(7200)) - 3600).withColumn("_part", F.ntile(4).over(W.orderBy("_at"))).cache()
    parts = [rows.where(F.col("_part") == i).select(*COLUMNS).orderBy(F.desc("event_id")) for i in range(1, 5)]
    schema = parts[0].schema
    build = lambda stream: sw.stream_windows(stream, "event_id", lateness="2 hours")
    drop_files(spark, parts[:2], str(tmp_path / "in"))
    first, query = drained(spark, schema, build, tmp_path)
    early = first.count()
    drop_files(spark, [*parts[2:], far(rows).select(*COLUMNS)], str(tmp_path / "in"), 2)
    got, query = drained(spark, schema, build, tmp_path)
    drained(spark, schema, build, tmp_path)  # a restart with nothing new adds nothing
    batch = wd.sliding_windows(enriched_rows, v.ORDER, record=["event_id", "message"], row_id="event_id")
    want = {(r["source"], r["host"], r["event_id"], r["label"], tuple(x["message"] for x in r["sequence"])) for r in batch.collect()}
    rows_got = [(r["source"], r["host"], r["position"], r["label"], tuple(x["message"] for x in r["sequence"])) for r in got.collect()]
    assert 0 < early < len(rows_got) == len(set(rows_got)) and set(rows_got) == want and len(want) > 500


def test_silent_keys_are_forgotten_by_event_time(spark, enriched_rows, tmp_path):
    start = datetime(2024, 1, 1)
    one = enriched_rows.select(*COLUMNS).limit(1)

    def rows(minutes):
        frame = spark.createDataFrame([(i, start + timedelta(minutes=i)) for i in minutes], "event_id bigint, event_time timestamp")
        return frame.crossJoin(one.drop("event_id", "event_time", "source")).withColumn("source", F.lit("ssh")).select(*COLUMNS)

    drop_files(spark, [rows(range(0, 6)), far(one, event_time=F.lit("2024-01-01 05:00:00").cast("timestamp")).select(*COLUMNS),
                       rows(range(300, 306)), far(one).select(*COLUMNS)], str(tmp_path / "in"))
    for idle, want in ((None, 12 - 3), (60, 2 * (6 - 3))):
        build = lambda stream: sw.stream_windows(stream, "event_id", 4, "1 minute", idle)  # noqa: B023, E731
        got, _ = drained(spark, one.schema, build, tmp_path, f"out-{idle}")
        assert got.where("source = 'ssh'").count() == want


def test_late_rows_are_found_again(spark, enriched_rows, tmp_path):
    """What the stream drops and what it keeps is what it received; the side table takes each batch once."""
    start = datetime(2024, 1, 1)
    parts = [[0, 10, 20], [21, 5, 30], [9, 31, 12, 60], [61, 29, 100], [7]]
    frames = [spark.createDataFrame([(m, start + timedelta(minutes=m), "h") for m in part], "id bigint, event_time timestamp, host string") for part in parts]
    build = lambda stream: stream.withWatermark("event_time", "10 minutes").dropDuplicatesWithinWatermark(["id"])
    read = lambda files: spark.read.schema(frames[0].schema).parquet(*files).withColumn("file", F.col("_metadata.file_path"))
    side = str(tmp_path / "late")
    drop_files(spark, frames[:3], str(tmp_path / "in"))
    _, query = drained(spark, frames[0].schema, build, tmp_path)
    dropped = sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)
    assert late.append_late(spark, str(tmp_path / "cp-out"), read, "event_time", side) >= 3
    drop_files(spark, frames[3:], str(tmp_path / "in"), 3)
    kept, query = drained(spark, frames[0].schema, build, tmp_path)
    dropped += sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)
    assert late.append_late(spark, str(tmp_path / "cp-out"), read, "event_time", side) >= 2
    assert late.append_late(spark, str(tmp_path / "cp-out"), read, "event_time", side) == 0
    found = sorted(r["id"] for r in spark.read.parquet(side).collect())
    assert sorted([*found, *[r["id"] for r in kept.collect()]]) == sorted(m for part in parts for m in part)
    assert len(found) == dropped >= 2


def points_of(spark, seed, n=400):
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    rows = [(rng.choice("ab"), i, start + timedelta(seconds=rng.randrange(7_200), microseconds=rng.randrange(3) * 333_333), float(i % 50)) for i in range(n)]
    rows += [("a", n + i, start + timedelta(seconds=600), float(i)) for i in range(5)]  # equal times
    return spark.createDataFrame(rows, "resource string, place bigint, ts timestamp, value double")


@pytest.mark.parametrize("kind,batch", [
    (series.MEAN, lambda p: metrics.align_mean(p, ["resource"], 60)), (series.DELTA, lambda p: metrics.align_delta(p, ["resource"], ["ts", "place"], 300)),
    (series.RATE, lambda p: metrics.align_rate(p, ["resource"], ["ts", "place"], 60))])
def test_series_equal_batch_out_of_order_and_restarted(spark, tmp_path, kind, batch):
    points = points_of(spark, 5).withColumn("_part", F.ntile(4).over(W.orderBy(F.unix_seconds("ts") + F.pmod(F.xxhash64("place"), F.lit(600))))).cache()
    last = spark.createDataFrame([("~", 0, datetime(2100, 1, 1), 0.0)], "resource string, place bigint, ts timestamp, value double")
    parts = [*[points.where(F.col("_part") == i).drop("_part") for i in range(1, 5)], last]
    build = {series.MEAN: lambda s: series.stream_mean(s, ["resource"], "place", 60, "10 minutes"),
             series.DELTA: lambda s: series.stream_delta(s, ["resource"], "place", 300, "10 minutes"),
             series.RATE: lambda s: series.stream_rate(s, ["resource"], "place", 60, "10 minutes")}[kind]
    drop_files(spark, parts[:2], str(tmp_path / "in"))
    drained(spark, last.schema, build, tmp_path)
    drop_files(spark, parts[2:], str(tmp_path / "in"), 2)
    got, _ = drained(spark, last.schema, build, tmp_path)
    told = sorted((r["resource"], r["period"], round(r["value"], 9)) for r in got.where("resource <> '~'").collect())
    assert told == sorted((r["resource"], r["period"], round(r["value"], 9)) for r in batch(points.drop("_part")).collect()) and len(told) > 30


def test_alerts_open_and_close(spark, tmp_path):
    start = datetime(2024, 1, 1)
    high = [3, 4, 5, 8, 10, 11]
    minutes = [(m, 9.0 if m in high else 1.0) for m in range(12)]
    frame = lambda some: spark.createDataFrame([("n", m, start + timedelta(minutes=m), x) for m, x in some], "resource string, place bigint, ts timestamp, value double")
    build = lambda s: series.stream_alert(s, ["resource"], "place", series.MEAN, 5.0, 60, 2, "1 minute")
    drop_files(spark, [frame(minutes[:5]), frame(minutes[5:9]), frame(minutes[9:])], str(tmp_path / "in"))
    got, _ = drained(spark, frame(minutes).schema, build, tmp_path)
    zero = int(start.replace(tzinfo=timezone.utc).timestamp())
    told = lambda df: sorted((r["event"], (r["first_period"] - zero) // 60, (r["last_period"] - zero) // 60, r["periods"], r["peak"]) for r in df.collect())
    assert told(got) == [("close", 3, 5, 3, 9.0), ("open", 3, 4, 2, 9.0)]  # the last minutes still wait
    drop_files(spark, [frame([(20, 1.0)]), frame([(30, 1.0)])], str(tmp_path / "in"), 3)
    got, _ = drained(spark, frame(minutes).schema, build, tmp_path)
    assert told(got) == [("close", 3, 5, 3, 9.0), ("close", 10, 11, 2, 9.0), ("open", 3, 4, 2, 9.0), ("open", 10, 11, 2, 9.0)]


def test_counting_takes_no_jobs(spark, sf, tmp_path):
    messages = sink.raw_messages(v.raw_logs(spark, sf).where("event_id < 100")).cache()
    messages.count()
    targets = etl.EtlTargets(*[str(tmp_path / n) for n in ("lake", "processed", "anomalies", "quarantine", "counters")])
    spark.sparkContext.setJobGroup("counted", "")
    try:
        etl.process_batch(messages, 0, targets, lambda: v.BATCH_TIME)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("counted")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 6  # four writes, the lake's in stages
    told = json.loads((tmp_path / "counters/counts/batch_id=0/counts.json").read_text())
    stored = lake.scan_lake(spark, targets.lake)
    assert told["received"] == 100 and told["records"] == stored.count() == 100 - told["rejected"] - told["quarantined"]
    assert told["files"] == stored.select("source", "year", "month", "day").distinct().count()
    assert told["anomalies"] == stored.where("is_anomaly_candidate").count()


def test_etl_stream_fans_out_and_replays_once(spark, sf, tmp_path):
    few = "event_id < 200"
    raw = sink.raw_messages(v.raw_logs(spark, sf).where(few)).withColumn("n", F.get_json_object("value", "$.message"))
    bad = spark.createDataFrame([("x", "{bad", "0"), ("x", "[1]", "0"), ("x", '{"source":"linux","message":"m"}', "0")], "key string, value string, n string")
    write_parts(raw.unionByName(bad), str(tmp_path / "raw"), 3, "n")
    targets = etl.EtlTargets(*[str(tmp_path / n) for n in ("lake", "processed", "anomalies", "quarantine", "counters")])
    clock = lambda: v.BATCH_TIME

    def drain(checkpoint):
        stream = topics.stream_folder(spark, str(tmp_path / "raw"), files_per_batch=1)
        etl.run_etl(stream, targets, str(tmp_path / checkpoint), DRAIN, clock).awaitTermination()

    drain("cp")
    want = v.enriched(spark, sf).where(few)
    stored = lake.scan_lake(spark, targets.lake)
    columns = [c for c in ENRICHED_SCHEMA.names if c != "processed_at"]
    assert stored.count() == want.count()
    assert stored.select(columns).exceptAll(want.select(columns)).count() == 0
    drain("other")  # the same batches once more, as after a lost checkpoint
    assert lake.scan_lake(spark, targets.lake).count() == want.count()
    assert spark.read.json(targets.processed).count() == want.count()
    assert spark.read.json(targets.anomalies).count() == want.where("is_anomaly_candidate").count()
    assert spark.read.json(targets.quarantine).count() == 2
    counts = spark.read.json(f"{targets.counters}/counts")
    totals = counts.agg(F.sum("records"), F.sum("received")).first()
    assert tuple(totals) == (want.count(), raw.count() + 3) and counts.count() == 3
    assert os.path.isdir(f"{targets.lake}/source=ssh/year=2024/month=01")


def test_batch_stamp_is_kept_for_replays(spark, tmp_path):
    times = iter(["2024-01-01 00:00:00", "2024-01-02 00:00:00"])
    first = etl.batch_stamp(spark, str(tmp_path), 5, lambda: next(times))
    assert first == etl.batch_stamp(spark, str(tmp_path), 5, lambda: next(times)) == "2024-01-01 00:00:00"


def test_scoring_stream_equals_batch_scores(spark, enriched_rows, tmp_path):
    fitted = training.fit(enriched_rows, v.ORDER, v.BATCH_ISO)
    threshold = fitted.threshold
    messages = sink.processed_messages(enriched_rows).withColumn("n", F.get_json_object("value", "$.timestamp"))
    last = enriched_rows.limit(1).withColumns({"timestamp": F.lit("2100-01-01T00:00:00+00:00"), "source": F.lit("~")})
    messages = messages.unionByName(sink.processed_messages(last).withColumn("n", F.lit("2100")))
    write_parts(messages, str(tmp_path / "in"), 3, "n")
    stream = ss.processed_rows(topics.stream_folder(spark, str(tmp_path / "in"), 1))
    # The fixture's clock is unique except for the fallback rows, which the message tells apart.
    stream = stream.withColumn("offset", F.regexp_extract("message", r"\.(\d+)$", 1).cast("bigint"))
    ss.run_scoring(stream, "offset", fitted.inputs, fitted.model, threshold, v.BATCH_ISO, str(tmp_path / "out"),
                   str(tmp_path / "cp"), DRAIN, idle_minutes=None).awaitTermination()
    got = topics.decode(topics.read_folder(spark, str(tmp_path / "out")), ANOMALY_SCHEMA)
    clear = got.where(F.element_at("sequence", -1)["timestamp"] < "2024-01-31")
    shown = {(r["source"], r["host"], r["sequence"][-1]["timestamp"]): r["anomaly_score"] for r in clear.collect()}
    want = fitted.scored.where((F.col("score") > threshold) & (F.col("event_time") < "2024-01-31")).join(
        enriched_rows.select("event_id", "timestamp"), "event_id").collect()
    assert {(r["source"], r["host"], r["timestamp"]) for r in want} == set(shown)
    for r in want:
        assert abs(shown[r["source"], r["host"], r["timestamp"]] - r["score"]) < 1e-5
    first = got.first()
    assert len(first["sequence"]) == 10 and first["model_version"] == "lstm_v1_20240201"


def anomaly_file(path, name, rows, at):
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/{name}.json", "w") as f:
        for i, (when, host, score, ratio) in rows:
            f.write(json.dumps({"arrival": i, "detected_at": when, "source": "ssh", "host": host, "anomaly_score": score, "threshold": 1.0,
                                "severity_ratio": ratio, "sequence": [{"timestamp": when, "level": "ERROR", "message": "m"}], "model_version": "x"}) + "\n")
    os.utime(f"{path}/{name}.json", (at, at))


def anomaly_stream(spark, path):
    return spark.readStream.schema("arrival bigint, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ANOMALY_SCHEMA.fields)).option(
        "maxFilesPerTrigger", 1).json(path)


def test_dedup_and_incident_streams(spark, tmp_path):
    at = "2024-01-01T00:00:%02d+00:00"
    rows = [(i, (at % (i % 5), "h", 1.5, 3.0)) for i in range(20)]
    anomaly_file(str(tmp_path / "in"), "a", rows[:10], 1_700_000_000)
    anomaly_file(str(tmp_path / "in"), "b", rows[10:], 1_700_000_001)
    for name, build in (("dedup", lambda s: sb.dedup_stream(s)), ("incident", lambda s: sb.incident_stream(bd.board_rows(s)))):
        query = (build(anomaly_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName(name)
                 .option("checkpointLocation", str(tmp_path / f"cp_{name}")).trigger(**DRAIN).start())
        query.awaitTermination()
        assert spark.table(name).count() == 5


def test_board_stream_keeps_newest_and_counts_all(spark, tmp_path):
    at = "2024-01-01T00:%02d:00+00:00"
    for k in range(3):
        anomaly_file(str(tmp_path / "in"), f"f{k}", [(k * 10 + i, (at % (k * 10 + i), "h", 1.0, 1.0)) for i in range(10)], 1_700_000_000 + k)
    table = str(tmp_path / "board")
    stream = bd.board_rows(anomaly_stream(spark, str(tmp_path / "in")))
    sb.run_board(stream, table, str(tmp_path / "cp"), DRAIN, n=12).awaitTermination()
    got = sb.read_board(spark, table)
    assert sorted(r["arrival"] for r in got.collect()) == list(range(18, 30))
    assert got.first()["received"] == 30
    replay = bd.board_rows(spark.read.schema(anomaly_stream(spark, str(tmp_path / "in")).schema).json(str(tmp_path / "in/f2.json")))
    sb.update_board(replay, 2, table, n=12)
    assert sb.read_board(spark, table).first()["received"] == 30


def test_windowed_counts(spark, tmp_path):
    at = "2024-01-01T00:%02d:30+00:00"
    anomaly_file(str(tmp_path / "in"), "a", [(i, (at % (i % 3), "h", 2.0, 1.0)) for i in range(9)], 1_700_000_000)
    query = (sb.windowed_counts(anomaly_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("counts")
             .outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(**DRAIN).start())
    query.awaitTermination()
    assert {r["n"] for r in spark.table("counts").collect()} == {3} and spark.table("counts").count() == 3


def test_kafka_options():
    raw = topics.raw_topic_options("broker:9092", "logs-raw", "etl")
    assert raw["startingOffsets"] == "earliest" and raw["minOffsetsPerTrigger"] == "500" and raw["maxTriggerDelay"] == "30s"
    assert topics.processed_topic_options("b", "t", "g")["startingOffsets"] == "latest"
    assert "kafka.group.id" not in topics.board_topic_options("b", "t")


def test_a_larger_feed_makes_larger_micro_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(io_queries, "FEED_ROWS", 10)
    rows = spark.range(1000).select(F.lit("").alias("key"), F.col("id").cast("string").alias("value"), "id")
    most = io_queries._feed(rows, "id", str(tmp_path / "in"))
    query = (topics.stream_folder(spark, str(tmp_path / "in"), most).writeStream.format("parquet").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(**DRAIN).start())
    query.awaitTermination()
    took = [p.numInputRows for p in query.recentProgress if p.numInputRows]
    assert sum(took) == 1000 and 3 <= len(took) <= io_queries.FEED_BATCHES
    assert sorted(int(r["value"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(1000))


def test_streams_keep_few_state_partitions(spark, tmp_path):
    key = "spark.sql.shuffle.partitions"
    configured = spark.conf.get(key)
    spark.conf.set(key, "40")
    try:
        drop_files(spark, [points_of(spark, 1)], str(tmp_path / "in"))
        stream = spark.readStream.schema(points_of(spark, 1).schema).parquet(str(tmp_path / "in"))
        io_queries._drained(series.stream_mean(stream, ["resource"], "place"), str(tmp_path))
        assert spark.conf.get(key) == "40"
    finally:
        spark.conf.set(key, configured)
    kept = [d for d in os.listdir(tmp_path / "checkpoint/state/0") if d.isdigit()]
    assert 0 < len(kept) <= max(8, spark.sparkContext.defaultParallelism) < 40


class Held:
    """A state variable and a handle of timers in memory."""

    def __init__(self):
        self.rows, self.states = [], {}

    def getListState(self, name, schema):
        return self.states.setdefault(name, Held())

    getValueState = getListState

    def listTimers(self):
        return iter([])

    def registerTimer(self, at):
        self.timer = at

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows = rows

    def clear(self):
        self.rows = []


def test_waiting_points_are_packed():
    """The state takes a row a chunk, not one a point."""
    n, handle = series.CHUNK + 1_000, Held()
    aligned = series.Aligned(["resource"], series.MEAN, 60, None, 1)
    aligned.init(handle)
    rows = pd.DataFrame({"micros": [59_000_000 - i for i in range(n)], "place": range(n), "value": [float(i % 7) for i in range(n)]})
    timers = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    assert list(aligned.handleInputRows(("a",), iter([rows[:50_000], rows[50_000:]]), timers(0))) == []
    assert len(handle.states["waiting"].rows) == 2 and handle.timer == 60_000
    told, = aligned.handleExpiredTimer(("a",), timers(60_000), None)
    assert told.values.tolist() == [["a", 0, sum(rows["value"]) / n]] and handle.states["waiting"].rows == []
