"""Windows: split keys give the same rows as whole ones, and as brute force."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from emberline.operators import metrics, prefix, windows as wd

ORDER = ["event_time", "event_id"]


def make(spark, sizes, seed=1, same_time=()):
    rng = random.Random(seed)
    rows, start = [], datetime(2024, 1, 1)
    for (source, host), n in sizes.items():
        for i in range(n):
            at = start if host in same_time else start + timedelta(seconds=rng.randrange(n))
            rows.append((source, host, at, len(rows), rng.random() < 0.1))
    rng.shuffle(rows)
    return rows, spark.createDataFrame(
        rows, "source string, host string, event_time timestamp, event_id bigint, is_anomaly_candidate boolean").repartition(5)


def brute(rows, size):
    groups = defaultdict(list)
    for r in rows:
        groups[r[0], r[1]].append(r)
    out = set()
    for key, group in groups.items():
        group.sort(key=lambda r: (r[2], r[3]))
        for i in range(size - 1, len(group)):
            part = group[i - size + 1: i + 1]
            out.add((*key, part[0][3], part[-1][3], any(r[4] for r in part)))
    return out


def found(df, **params):
    got = wd.sliding_windows(df, ORDER, row_id="event_id", **params)
    rows = [tuple(r) for r in got.select("source", "host", "first_id", "last_id", "label").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("size", [2, 3, 10])
@pytest.mark.parametrize("hot_rows,block_rows", [(None, 1), (50, 300), (50, 25), (5, 3), (0, 1), (0, 150)])
def test_split_keys_equal_brute_force(spark, size, hot_rows, block_rows):
    rows, df = make(spark, {("ssh", "hot"): 900, ("ssh", "b"): 9, ("linux", "hot"): 120, ("linux", None): 60, ("x", "y"): 1},
                    same_time=("y",))
    assert found(df, size=size, hot_rows=hot_rows, block_rows=block_rows) == brute(rows, size)


def test_equal_times_split_by_tie_break(spark):
    rows, df = make(spark, {("ssh", "burst"): 600, ("ssh", "b"): 30}, same_time=("burst",))
    assert found(df, hot_rows=100, block_rows=40) == brute(rows, 10)


def test_hot_key_spreads_over_blocks(spark):
    _, df = make(spark, {("ssh", "hot"): 4000, ("ssh", "b"): 40})
    sizes = wd.blocked(df, ["source", "host"], ORDER, 10, 500, 250).where("host = 'hot'").groupBy("_block").count()
    rows = [r["count"] for r in sizes.collect()]
    assert len(rows) >= 12 and max(rows) < 1000


def test_rows_of_equal_order_do_not_depend_on_the_cut(spark):
    """An order that is not unique: whole and cut keys give the same windows, and equal rows stay several."""
    rng = random.Random(8)
    at = datetime(2024, 1, 1)
    rows = [("s", "h", at + timedelta(seconds=rng.randrange(40)), rng.randrange(3), rng.random() < 0.1) for _ in range(500)]
    df = spark.createDataFrame(rows, "source string, host string, event_time timestamp, event_id bigint, is_anomaly_candidate boolean")

    def windows(**params):
        got = wd.sliding_windows(df.repartition(6), ["event_time"], record=["event_id", "is_anomaly_candidate"], size=4, **params)
        return sorted(map(str, got.collect()))

    whole = windows(hot_rows=None)
    assert len(whole) == 497 and windows(hot_rows=10, block_rows=20) == whole and windows(hot_rows=10, block_rows=2) == whole


def test_plan_reads_once_and_shuffles_once(spark, sf):
    from emberline.plans import views as v

    rows = v.enriched(spark, sf)
    for params in ({"hot_rows": 20, "block_rows": 30}, {}):
        df = wd.sliding_windows(rows, v.ORDER, row_id="event_id", **params)
        plan = df._jdf.queryExecution().executedPlan().toString()
        plan = plan.split("== Initial Plan ==")[0]
        assert plan.count("FileScan parquet") == 1 and plan.count("Exchange hashpartitioning") == 1
        assert "InArrow" not in plan and "REPARTITION_BY_NUM" not in plan


def test_records_in_order(spark):
    rows, df = make(spark, {("ssh", "a"): 40})
    got = wd.sliding_windows(df, ORDER, record=["event_id"], size=4, hot_rows=10, block_rows=8).collect()
    ids = [r[3] for r in sorted(rows, key=lambda r: (r[2], r[3]))]
    assert sorted([x["event_id"] for x in r["sequence"]] for r in got) == sorted(ids[i - 3: i + 1] for i in range(3, 40))


def test_short_keys_give_nothing_and_keys_are_apart(spark):
    rows = [("s", "A", datetime(2024, 1, 1), 0, False), ("s", "B", datetime(2024, 1, 2), 1, False), ("s", "A", datetime(2024, 1, 3), 2, True)]
    df = spark.createDataFrame(rows, "source string, host string, event_time timestamp, event_id bigint, is_anomaly_candidate boolean")
    assert found(df, size=2) == {("s", "A", 0, 2, True)}
    assert found(df, size=3) == set()
    assert wd.active_keys(df).first()[0] == 2


def test_full_windows_carry_over_batches(spark):
    rows, df = make(spark, {("ssh", "a"): 300, ("ssh", "b"): 150, ("linux", None): 80})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        def run(batches):
            import pyarrow as pa
            for table, ends in wd.full_windows(batches, ["source", "host"], 10):
                ids = table.column("event_id").to_pylist()
                out = [(ids[e - 9], ids[e]) for e in ends]
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])

        blocks = wd.sorted_blocks(df, ORDER, hot_rows=100, block_rows=33)
        got = {(r.a, r.b) for r in blocks.mapInArrow(run, "a bigint, b bigint").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(w[2], w[3]) for w in brute(rows, 10)}


def test_running_sums_over_chunks(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab") if rng.random() < 0.9 else None, i, rng.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, pos bigint, x bigint").repartition(6)
    got = prefix.running_sums(df, "pos", {"total": F.col("x"), "rank": F.lit(1)}, ["k"], chunk=16).collect()
    want = {}
    sums = defaultdict(lambda: [0, 0])
    for k, pos, x in rows:
        sums[k][0] += x
        sums[k][1] += 1
        want[pos] = tuple(sums[k])
    assert {r["pos"]: (r["total"], r["rank"]) for r in got} == want


def test_counter_increase_over_split_series(spark):
    start = datetime(2024, 1, 1)
    rows = [("a", start + timedelta(seconds=i), i, float(i % 100)) for i in range(1000)]
    df = spark.createDataFrame(rows, "resource string, ts timestamp, event_id bigint, value double").repartition(4)
    got = metrics.align_delta(df, ["resource"], ["ts", "event_id"], 300, hot_rows=100).collect()
    want = defaultdict(float)
    for i in range(1000):
        want[1704067200 + i // 300 * 300] += 1.0 if i % 100 else 0.0
    assert {r["period"]: r["value"] for r in got} == dict(want)


def test_sustained_alert_needs_adjacent_periods(spark):
    aligned = spark.createDataFrame(
        [("n", p * 60, v) for p, v in [(0, 9.0), (1, 9.0), (2, 1.0), (3, 9.0), (5, 9.0), (6, 9.0), (7, 9.0)]],
        "resource string, period bigint, value double")
    got = metrics.sustained_alert(aligned, ["resource"], 5.0, 60, 2).orderBy("first_period").collect()
    assert [(r["first_period"], r["last_period"], r["periods"]) for r in got] == [(0, 60, 2), (300, 420, 3)]
