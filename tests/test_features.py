"""Features, percentile and reports against plain numpy."""

import math
import os
import re
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark import cloudpickle
from pyspark.sql import functions as F

from emberline.functions import text
from emberline.operators import evaluate as ev, features as ft
from emberline.operators.quantiles import exact_percentile
from emberline.plans import views as v
from emberline.session import dealt

SAMPLE = "Invalid user webmaster from 173.234.31.186"


def vocabulary(spark, messages, **params):
    df = spark.createDataFrame(list(enumerate(messages)), "i int, message string")
    return ft.build_vocabulary(df, **params)


def test_tokens(spark):
    df = spark.createDataFrame([(SAMPLE,), ("",), (None,), ("É-à_9",)], "m string")
    got = [r[0] for r in df.select(text.tokens(F.col("m"))).collect()]
    assert got == [["invalid", "user", "webmaster", "from", "173", "234", "31", "186"], [], [], ["9"]]


def test_vocabulary_ranks(spark):
    got = {r["token"]: r["idx"] for r in vocabulary(spark, ["hello world", "hello kafka", "world is big"]).collect()}
    assert (got["hello"], got["world"]) == (1, 2)
    seen = {r["token"]: r["idx"] for r in vocabulary(spark, ["z a z", "a b", "c"], order_by="i").collect()}
    assert seen == {"z": 1, "a": 2, "b": 3, "c": 4}
    assert vocabulary(spark, [f"w{i}" for i in range(50)], size=7).count() == 7


def test_embedding_table():
    table = ft.embedding_table(100, 32)
    assert table.shape == (101, 32) and table.dtype == np.float32 and (table[0] == 0).all()
    assert abs(table[1:].std() - 0.1) < 0.01


def slow_vector(record, vocab, table):
    src = [1.0 if record["source"] == s else 0.0 for s in ft.SOURCES]
    lvl = [1.0 if record["level"] == x else 0.0 for x in ft.LEVELS]
    angle = 2 * math.pi * record["hour"] / 24
    words = re.findall("[a-z0-9]+", (record["message"] or "").lower())
    emb = np.mean([table[vocab.get(w, 0)] for w in words], axis=0) if words else np.zeros(table.shape[1])
    return np.array([*src, *lvl, math.sin(angle), math.cos(angle), *emb])


def test_log_vectors_equal_plain_python(spark):
    records = [
        {"source": "ssh", "level": "WARN", "hour": 14, "message": SAMPLE}, {"source": "nope", "level": "ERROR", "hour": 23, "message": "unknown words only"},
        {"source": "android", "level": "ODD", "hour": 0, "message": None}, {"source": None, "level": None, "hour": 5, "message": "user user x"},
    ]
    encoder = ft.collect_encoder(vocabulary(spark, [SAMPLE, "user from user"]))
    df = spark.createDataFrame([(i, *r.values()) for i, r in enumerate(records)], "i int, source string, level string, hour int, message string")
    got = {r["i"]: np.array(r["vector"]) for r in ft.log_vectors(df, encoder).collect()}
    vocab = {t: i + 1 for i, t in enumerate(encoder.tokens)}
    for i, r in enumerate(records):
        assert got[i].shape == (77,)
        np.testing.assert_allclose(got[i], slow_vector(r, vocab, encoder.table), atol=1e-6)
    assert got[1][:6].sum() == 0 and got[1][6 + 3] == 1 and got[1][6:11].sum() == 1
    assert np.linalg.norm(got[1][11:13] - got[2][11:13]) < 0.3


def test_embedding_of_sliced_batches():
    encoder = ft.Encoder(["a", "b"], np.array([[0, 0], [1, 0], [0, 1]], np.float32))
    whole = pa.array([["a"], ["b", "a", "x", "x"], [], None, ["b"]], pa.list_(pa.string()))
    np.testing.assert_allclose(encoder.embed(whole), [[1, 0], [0.25, 0.25], [0, 0], [0, 0], [0, 1]])
    np.testing.assert_allclose(encoder.embed(whole.slice(1, 2)), [[0.25, 0.25], [0, 0]])
    np.testing.assert_allclose(encoder.embed(pa.chunked_array([whole.slice(3), whole.slice(0, 1)])), [[0, 0], [0, 1], [1, 0]])


def test_embedding_of_texts_longer_than_a_gather_step():
    encoder = ft.Encoder(["a", "b"], np.array([[0, 0], [1, 0], [0, 1]], np.float32))
    lists = [["a"] * 20_000 + ["b"] * 5_000, [], ["b"], ["x"] * 9_000 + ["a"] * 1_000]
    np.testing.assert_allclose(encoder.embed(pa.array(lists, pa.list_(pa.string()))), [[0.8, 0.2], [0, 0], [0, 1], [0.1, 0]], rtol=1e-6)


def stored_vectors(spark, rows, encoder):
    return np.array([r["vector"] for r in ft.log_vectors(rows.where(~F.col("is_anomaly_candidate")), encoder).collect()], dtype=np.float64)


def test_log_scaler_equals_numpy_over_stored_vectors(spark, sf):
    rows = v.enriched(spark, sf)
    encoder = ft.collect_encoder(ft.build_vocabulary(rows))
    scaler, x = ft.collect_scaler(ft.fit_log_scaler(rows, encoder)), stored_vectors(spark, rows, encoder)
    want = x.std(axis=0)
    want[want == 0] = 1
    np.testing.assert_allclose(scaler.mean, x.mean(axis=0), atol=1e-9)
    np.testing.assert_allclose(scaler.scale, want, rtol=1e-6)
    fast = {r["event_id"]: r["vector"] for r in ft.scaled_log_vectors(rows, encoder, scaler).collect()}
    for r in ft.log_vectors(rows, encoder).limit(50).collect():
        np.testing.assert_allclose(fast[r["event_id"]], scaler.apply(np.array(r["vector"])), rtol=1e-6)


def test_moments_by_day_merge_and_subtract(spark, sf):
    rows = v.enriched(spark, sf)
    encoder = ft.collect_encoder(ft.build_vocabulary(rows))
    days = ft.log_moments(rows, encoder, by_day=True).cache()
    told = lambda df: {r["dim"]: (r["n"], r["mean"], r["m2"]) for r in df.collect()}
    whole, full = told(ft.merge_moments(days)), told(ft.merge_moments(ft.log_moments(rows, encoder)))
    some = F.col("date") < "2024-01-12"
    without = told(ft.subtract_moments(ft.merge_moments(days), ft.merge_moments(days.where(some))))
    rest = told(ft.merge_moments(days.where(~some)))
    assert len(whole) == 77 and len(without) == 77
    for d in range(77):
        np.testing.assert_allclose(whole[d], full[d], rtol=1e-9, atol=1e-9)
        np.testing.assert_allclose(without[d], rest[d], rtol=1e-6, atol=1e-6)
    per_day = ft.merge_moments(days, "date").where("dim = 0").agg(F.sum("n")).first()[0]
    assert per_day == whole[0][0]


def test_sketches_keep_their_bound_over_merges(spark):
    rng = np.random.default_rng(7)
    scores = np.concatenate([rng.exponential(1, 60_000), np.full(20_000, 0.25)])
    df = spark.createDataFrame([(float(x), i % 13) for i, x in enumerate(scores)], "score double, part int")
    sketches = ev.score_sketches(df, "part")
    for q in (1, 50, 95, 99.9):
        r = ev.sketch_percentile(sketches, q).first()
        assert r["n"] == len(scores)
        assert (scores < r["threshold"]).mean() - ev.SKETCH_ERROR <= q / 100 <= (scores <= r["threshold"]).mean() + ev.SKETCH_ERROR
    for r in ev.sketch_sweep(sketches, [0.1, 0.25, 3.0]).collect():
        assert abs(r["above"] - (scores > r["threshold"]).sum()) <= ev.SKETCH_ERROR * len(scores) + 1


def test_shared_objects_need_no_installed_package(tmp_path, spark):
    """A task process that has never seen the package unpacks and uses them."""
    encoder = ft.Encoder(["a"], ft.embedding_table(1, 4))
    (tmp_path / "x").write_bytes(cloudpickle.dumps(encoder))
    code = "import pickle, pyarrow as pa; e = pickle.load(open('x', 'rb')); print(e.embed(pa.array([['a'], []])).shape)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    assert done.stdout.strip() == "(2, 4)", done.stderr


def test_percentile_rule(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, 10.0)], "score double")
    r = ev.fit_threshold(df).first()
    assert abs(r["threshold"] - 8.95) < 1e-12 and r["n_samples"] == 4


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.floats(-1e300, 1e300) | st.sampled_from([0.0, -0.0, 0.5, 1.0, -1.0, 2.0, 5e-324, -5e-324, 1 - 2**-53, 1 + 2**-52, -1 - 2**-52]), min_size=1, max_size=60),
       st.sampled_from([0, 5, 50, 95, 100]))
def test_percentile_equals_numpy(spark, values, q):
    df = spark.createDataFrame([(float(x),) for x in values] + [(None,)], "v double")
    got = exact_percentile(df, "v", q).first()
    assert got["n_samples"] == len(values)
    want = float(np.percentile(np.array(values), q))
    assert got["threshold"] == pytest.approx(want, rel=1e-9, abs=1e-300)


@pytest.mark.parametrize("value", [float("nan"), float("inf"), float("-inf")])
def test_percentile_refuses_what_has_no_place(spark, value):
    with pytest.raises(Exception, match="column v holds"):
        exact_percentile(spark.createDataFrame([(1.0,), (value,)], "v double"), "v", 50).collect()


def test_percentile_of_nothing(spark):
    assert exact_percentile(spark.createDataFrame([], "v double"), "v", 95).first()["threshold"] is None


def test_published_confusion_matrix(spark):
    counts = {(0, 0): 470545, (0, 1): 110787, (1, 0): 34728, (1, 1): 29422}
    parts = [spark.range(n).select(F.lit(bool(t)).alias("label"), F.lit(bool(p)).alias("predicted")) for (t, p), n in counts.items()]
    df = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    got = {r["class"]: r for r in ev.classification_report(df).collect()}
    rounded = {c: tuple(round(got[c][k], 2) for k in ("precision", "recall", "f1")) for c in got}
    assert rounded["Anomalie"] == (0.21, 0.46, 0.29) and rounded["Normal"] == (0.93, 0.81, 0.87)
    assert rounded["accuracy"][0] == 0.77 and got["Anomalie"]["support"] == 64150 and got["weighted avg"]["support"] == 645482


def test_report_without_hits(spark):
    df = spark.createDataFrame([(True, False), (False, False)], "label boolean, predicted boolean")
    got = {r["class"]: r for r in ev.classification_report(df).collect()}
    assert (got["Anomalie"]["precision"], got["Anomalie"]["f1"]) == (0.0, 0.0)


def test_histogram_equals_numpy(spark):
    rng = np.random.default_rng(1)
    scores, labels = rng.exponential(1, 800), rng.random(800) < 0.3
    df = spark.createDataFrame([(float(s), bool(x)) for s, x in zip(scores, labels)], "score double, label boolean")
    got = ev.score_histogram(df, 0.8).collect()
    edges = np.linspace(0, min(scores.max(), 2.4), 80)
    for label in (False, True):
        want, _ = np.histogram(scores[labels == label], bins=edges, density=True)
        dense = np.zeros(79)
        for r in got:
            if r["label"] == label:
                dense[r["bin"]] = r["density"]
        np.testing.assert_allclose(dense, want, rtol=1e-9)


def test_value_columns_round_as_spark_does(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([
        rng.standard_normal(4000), rng.integers(-400_000, 400_000, 3000) / 32, rng.standard_normal(500) * 1e-5, rng.standard_normal(500) * 1e12,
        [0.0, -0.0, -1e-9, 1e-30, 0.03125, -0.03125, 3e38, math.inf, -math.inf, math.nan]]).astype(np.float32)
    lists = [[float(x), 0.5] for x in values] + [[None, 1.0], None]
    rows = spark.createDataFrame(list(enumerate(lists)), "i long, w array<float>").repartition(3)
    got = ft.value_columns(rows, "w", "v", 1, ["i"], digits=4)
    assert got.schema.simpleString() == "struct<i:bigint,v0:double>"
    want = rows.select("i", (F.round(F.col("w")[0].cast("double"), 4) + F.lit(0.0)).alias("v0"))
    assert got.count() == len(lists) and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert {str(r["v0"]) for r in got.where("i in (4000, 8001)").collect()}.isdisjoint({"-0.0"})
    plain = ft.value_columns(rows, "w", "e", 2, ["i"]).where("i < 8000").select("e0", "e1").first()
    assert plain["e0"] in values and plain["e1"] == 0.5


def test_dealt_rows_of_one_row_group_are_many_tasks(spark, tmp_path):
    spark.range(0, 200, 1, 1).write.parquet(str(tmp_path / "one"))
    rows = dealt(spark.read.parquet(str(tmp_path / "one")), "id")
    used = rows.select(F.spark_partition_id().alias("p"), "id").groupBy("p").count().collect()
    assert len(used) > spark.sparkContext.defaultParallelism and sum(r["count"] for r in used) == 200


def test_vector_queries_work_in_many_tasks(spark, sf):
    """The table of events is one row group, so one task; the vectors are made by all."""
    assert v.events(spark, sf).select(F.spark_partition_id()).distinct().count() == 1
    made = v.dealt_enriched(spark, sf)
    assert made.select(F.spark_partition_id()).distinct().count() > spark.sparkContext.defaultParallelism
    assert made.exceptAll(v.enriched(spark, sf)).count() == 0 and made.count() == v.enriched(spark, sf).count()


def test_lookup_counts_shuffle_texts_and_not_words(spark):
    texts = [(1, "b a b zz"), (2, "a"), (1, "b c"), (None, "a a"), (None, "a"), (3, None), (4, "")]
    df = spark.createDataFrame(texts, "d long, m string").repartition(3)
    vocabulary = ft.build_vocabulary(df, "m", size=2)
    found = ft.lookup_counts(df, "d", "m", vocabulary)
    got = {(r["d"], r["token"]): (r["idx"], r["n"]) for r in found.collect()}
    assert found.count() == len(got)
    assert got == {(1, "a"): (1, 1), (1, "b"): (2, 3), (1, "zz"): (0, 1), (1, "c"): (0, 1), (2, "a"): (1, 1), (None, "a"): (1, 3)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(d" in plan and "hashpartitioning(d#" in plan and ", token#" not in "".join(
        line for line in plan.splitlines() if "Exchange hashpartitioning(d" in line)
