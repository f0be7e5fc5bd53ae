"""Growing log files as a stream: nothing lost or repeated over stops, and batches of the size asked for."""

import time

from emberline.sources import tail


def run(spark, tmp_path, until, **params):
    """Runs the stream until the sink holds so many rows; returns sizes of its batches."""
    stream = tail.stream_log_folder(spark, str(tmp_path / "in"), str(tmp_path / "progress.json"), **params)
    query = (stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
             .trigger(processingTime="100 milliseconds").start())
    ends = time.time() + 60
    while time.time() < ends and query.isActive and sum(p.numInputRows for p in query.recentProgress) < until:
        time.sleep(0.1)
    if query.exception():
        raise query.exception()
    query.processAllAvailable() if params.get("max_delay_seconds", 30) < 1 else None
    sizes = [p.numInputRows for p in query.recentProgress if p.numInputRows]
    query.stop()
    return sizes


def test_stop_and_go_on_inside_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = {name: [f"{name} line {i} {'é' * (i % 5)}" for i in range(230)] for name in ("a.log", "b.log")}
    text = {name: ("\n".join(x) + "\n").encode() for name, x in lines.items()}
    (tmp_path / "in" / "a.log").write_bytes(text["a.log"][:3_001])  # ends within a line
    (tmp_path / "in" / "b.log").write_bytes(text["b.log"])
    whole = text["a.log"][:3_001].count(b"\n") + 230
    sizes = run(spark, tmp_path, 100, min_rows=1, max_rows=50, max_delay_seconds=0)
    assert max(sizes) <= 50
    (tmp_path / "in" / "a.log").write_bytes(text["a.log"])
    sizes = run(spark, tmp_path, 460 - whole, min_rows=1, max_rows=50, max_delay_seconds=0)
    run(spark, tmp_path, 0, min_rows=1, max_rows=1_000, max_delay_seconds=0)
    got = [(r["file"], r["position"], r["value"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    want, place = [], {}
    for name, own in lines.items():
        at = 0
        for line in own:
            want.append((name, at, line))
            at += len(line.encode()) + 1
    assert sorted(got) == sorted(want)


def test_few_rows_wait_for_more_or_for_the_time(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("one\ntwo\n")
    reader = tail.TailReader({"path": str(tmp_path / "in"), "progress": str(tmp_path / "p"), "minRows": "3", "maxRows": "4", "maxDelaySeconds": "0.4"})
    assert reader.latestOffset() == {}
    with open(tmp_path / "in" / "a.log", "a") as f:
        f.write("three\n")
    assert reader.latestOffset() == {"a.log": 14}
    reader.partitions({}, {"a.log": 14})
    assert reader.latestOffset() == {"a.log": 14}
    with open(tmp_path / "in" / "a.log", "a") as f:
        f.write("four\nfi")
    assert reader.latestOffset() == {"a.log": 14}
    time.sleep(0.5)
    assert reader.latestOffset() == {"a.log": 19}
    again = tail.TailReader({"path": str(tmp_path / "in"), "progress": str(tmp_path / "p"), "minRows": "1"})
    assert again.latestOffset() == {"a.log": 19}
    (tmp_path / "in" / "b.log").write_text("x\n" * 9)
    assert again.latestOffset() == {"a.log": 19, "b.log": 18}
    assert reader.latestOffset() == {"a.log": 19, "b.log": 6}
    reader.most = 1 << 20
    long = "y" * (3 * tail.CHUNK // 2)
    (tmp_path / "in" / "c.log").write_text(f"{long}\n\nz\n")
    rows = [tuple(r.values()) for b in reader.read(tail.Range("c.log", 0, len(long) + 4)) for r in b.to_pylist()]
    assert rows == [("c.log", 0, long), ("c.log", len(long) + 1, ""), ("c.log", len(long) + 2, "z")]
