"""Window models: numerics, training and artefacts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.operators import features as ft, lstm, pca, scoring
from emberline.plans import training, views as v
from emberline.operators.windows import window_labels
from emberline.sinks import artefacts
from emberline.sinks.lake import write_lake
from emberline.sources.lake import POSITION, scan_lake, with_event_time

TINY = lstm.Shape(5, 4, 3)


def test_full_size_network_has_the_known_number_of_weights():
    assert lstm.Shape().count() == 250_414


def slow_network(p, x):
    """One window, step by step, one unit at a time."""
    def sig(z):
        return 1 / (1 + np.exp(-z))

    def run(name, steps):
        wx, wh, b = p[f"{name}.x"], p[f"{name}.h"], p[f"{name}.b1"] + p[f"{name}.b2"]
        size = wh.shape[1]
        h, c, out = [0.0] * size, [0.0] * size, []
        for s in steps:
            z = [sum(wx[r][k] * s[k] for k in range(len(s))) + sum(wh[r][k] * h[k] for k in range(size)) + b[r] for r in range(4 * size)]
            c = [sig(z[size + u]) * c[u] + sig(z[u]) * np.tanh(z[2 * size + u]) for u in range(size)]
            h = [sig(z[3 * size + u]) * np.tanh(c[u]) for u in range(size)]
            out.append(list(h))
        return out

    def both(layer, steps):
        return run(f"enc{layer}f", steps), run(f"enc{layer}b", steps[::-1])

    f, b = both(0, [list(s) for s in x])
    f, b = both(1, [a + z for a, z in zip(f, b[::-1])])
    latent = p["code.w"] @ np.array(f[-1] + b[-1]) + p["code.b"]
    opened = p["open.w"] @ latent + p["open.b"]
    states = np.array(run("dec1f", run("dec0f", [list(opened)] * len(x))))
    logits = states @ p["weigh.w"][0] + p["weigh.b"][0]
    weights = np.exp(logits) / np.exp(logits).sum()
    return (states * weights[:, None]) @ p["out.w"].T + p["out.b"]


def test_network_equals_scalar_version():
    flat = TINY.start(1) * 2
    x = np.random.default_rng(0).standard_normal((3, 6, 5))
    out, _ = lstm.run_network(TINY.unpack(flat), x)
    for i in range(3):
        np.testing.assert_allclose(out[i], slow_network(TINY.unpack(flat), x[i]), atol=1e-10)


@pytest.mark.parametrize("dropout", [0.0, 0.5])
def test_gradient_equals_finite_differences(dropout):
    flat = TINY.start(2) * 2
    x = np.random.default_rng(3).standard_normal((4, 5, 5))
    rng = lambda: np.random.default_rng(9)
    _, gradient = lstm.loss_and_gradient(TINY, flat, x, rng(), dropout)
    for i in np.random.default_rng(4).choice(len(flat), 150, replace=False):
        step = np.zeros_like(flat)
        step[i] = 1e-5
        up, _ = lstm.loss_and_gradient(TINY, flat + step, x, rng(), dropout)
        down, _ = lstm.loss_and_gradient(TINY, flat - step, x, rng(), dropout)
        assert abs((up - down) / 2e-5 - gradient[i]) < 1e-7


def test_scores_do_not_depend_on_batching():
    model = lstm.LstmModel(lstm.Shape(), lstm.Shape().start(0))
    x = np.random.default_rng(0).standard_normal((30, 10, 77)).astype(np.float32)
    np.testing.assert_allclose(model.errors(x), np.concatenate([model.errors(x[i: i + 7]) for i in range(0, 30, 7)]), rtol=1e-5)


@pytest.fixture(scope="module")
def rows(spark, sf):
    return v.enriched(spark, sf).cache()


@pytest.fixture(scope="module")
def inputs(rows):
    return training.prepare_inputs(rows)


def all_windows(rows, inputs):
    """Vectors and windows by brute force on the driver (small fixture)."""
    vectors = {r["event_id"]: inputs.scaler.apply(np.array([r["vector"]]))[0] for r in ft.log_vectors(rows, inputs.encoder).collect()}
    groups = {}
    for r in rows.orderBy("event_time", "event_id").collect():
        groups.setdefault((r["source"], r["host"]), []).append(r)
    out = {}
    for group in groups.values():
        for i in range(9, len(group)):
            part = group[i - 9: i + 1]
            out[part[-1]["event_id"]] = (np.stack([vectors[r["event_id"]] for r in part]), any(r["is_anomaly_candidate"] for r in part))
    return out


@pytest.mark.parametrize("hot_rows", [None, 30])
def test_pca_equals_numpy(spark, rows, inputs, hot_rows):
    model = pca.fit_pca(rows, inputs, v.ORDER, hot_rows=hot_rows)
    scored = {r["event_id"]: r for r in scoring.score_windows(rows, inputs, model, v.ORDER, hot_rows).collect()}
    want = all_windows(rows, inputs)
    assert set(scored) == set(want)
    train = np.stack([w.ravel() for i, (w, bad) in want.items() if not bad and not scored[i]["in_validation"]]).astype(np.float64)
    mean = train.mean(axis=0)
    _, _, vt = np.linalg.svd(train - mean, full_matrices=False)
    basis = vt[: pca.LATENT].T
    for i, (w, bad) in want.items():
        x = w.ravel() - mean
        error = ((x - basis @ (basis.T @ x)) ** 2).mean()
        assert scored[i]["label"] == bad and scored[i]["score"] == pytest.approx(error, rel=1e-3, abs=1e-6)


def test_split_is_disjoint_repeatable_and_near_its_share(spark):
    ids = spark.range(20000)
    df = ids.select(F.col("id").cast("string").alias("a"), "id", scoring.in_validation(ids, ["id"]).alias("val"))
    share = df.agg(F.avg(F.col("val").cast("double"))).first()[0]
    assert abs(share - 0.2) < 0.02
    assert df.where("val").select("id").exceptAll(df.repartition(13).where("val").select("id")).count() == 0
    other = ids.select("id", scoring.in_validation(ids, ["id"], seed=7).alias("val"))
    assert df.where("val").select("id").exceptAll(other.where("val").select("id")).count() > 0


def test_lstm_training_lowers_the_loss_and_repeats(spark, rows, inputs):
    shape = lstm.Shape(77, 12, 6)
    model, history = lstm.fit_lstm(rows, inputs, v.ORDER, shape, epochs=6, rate=5e-3)
    assert history.validation[-1] < history.validation[0] and history.train[-1] < history.train[0]
    again, second = lstm.fit_lstm(rows, inputs, v.ORDER, shape, epochs=2, rate=5e-3)
    assert second.validation == pytest.approx(history.validation[:2], rel=1e-6)
    scored = scoring.score_windows(rows, inputs, model, v.ORDER)
    for r in scored.limit(5).collect():
        window = all_windows(rows, inputs)[r["event_id"]][0]
        assert r["score"] == pytest.approx(float(model.errors(window[None])[0]), rel=1e-4)


def test_rate_halves_and_training_stops(spark, rows, inputs, monkeypatch):
    monkeypatch.setattr(lstm, "_epoch", lambda source, i, shape, state, rate, seed: (state, 1.0))
    monkeypatch.setattr(lstm, "mean_error", lambda *a: 1.0)
    _, history = lstm.fit_lstm(rows, inputs, v.ORDER, lstm.Shape(77, 2, 2), epochs=50)
    assert len(history.train) == 1 + lstm.STOP_AFTER
    assert history.rates == [1e-3] * 5 + [5e-4] * 3


@pytest.mark.parametrize("kind,options", [("pca", {}), ("lstm", {"epochs": 1, "shape": lstm.Shape(77, 6, 3)})])
def test_fit_evaluate_save_and_load(spark, rows, tmp_path, kind, options):
    fitted = training.fit(rows, v.ORDER, v.BATCH_ISO, kind, **options)
    report = training.evaluate(fitted.scored, fitted.threshold)
    assert report.count() == 10
    normal = training.held_out(fitted.scored).where(~F.col("label"))
    values = np.array([r["score"] for r in normal.collect()])
    assert fitted.threshold == pytest.approx(np.percentile(values, 95)) and fitted.metadata["n_samples"] == len(values)
    artefacts.save_model(spark, str(tmp_path), fitted.inputs, fitted.model, fitted.metadata)
    inputs, model, facts = artefacts.load_model(spark, str(tmp_path))
    assert facts["threshold"] == fitted.threshold and facts["kind"] == kind
    again = scoring.score_windows(rows, inputs, model, v.ORDER)
    joined = again.join(fitted.scored.select("event_id", F.col("score").alias("old")), "event_id")
    assert joined.count() == fitted.scored.count()
    assert joined.agg(F.max(F.abs(F.col("score") - F.col("old")))).first()[0] < 1e-9


def test_fit_from_the_lake(spark, rows, tmp_path):
    """Stored rows with their file positions as tie-break give the windows of the table."""
    write_lake(rows, str(tmp_path / "lake"))
    stored = with_event_time(scan_lake(spark, str(tmp_path / "lake"), positions=True))
    order = ["event_time", *POSITION]
    assert stored.select(*POSITION).distinct().count() == rows.count()
    fitted = training.fit(stored, order, v.BATCH_ISO)
    assert fitted.scored.count() == window_labels(rows, v.ORDER).count()
    assert stored.where("event_time is null").count() == 0


def test_errors_of_many_windows_equal_one_by_one():
    """More windows than are taken at a time, in views over rows; a plain formula, window by window."""
    rng = np.random.default_rng(4)
    rows = rng.standard_normal((1200, 3)).astype(np.float32)
    windows = np.lib.stride_tricks.sliding_window_view(rows, 4, axis=0).transpose(0, 2, 1)
    model = pca.PcaModel(rng.standard_normal(12), np.linalg.qr(rng.standard_normal((12, 5)))[0])
    flat = [w.reshape(-1).astype(np.float64) - model.mean for w in windows]
    want = [((x - model.components @ (model.components.T @ x)) ** 2).mean() for x in flat]
    np.testing.assert_allclose(model.errors(windows), want, rtol=1e-9, atol=1e-12)
    assert model.errors(windows[:0]).shape == (0,)


def test_a_fit_keeps_its_window_rows(spark, sf):
    """So that a loaded model scores the very rows the saved one scored, and nothing is read or shuffled again."""
    fitted = training.fit(v.dealt_enriched(spark, sf), v.ORDER, v.BATCH_ISO)
    again = scoring.score_source(fitted.source, fitted.inputs, fitted.model, v.ORDER)
    assert again.exceptAll(fitted.scored).count() == 0 and again.count() == fitted.scored.count() > 0
    assert "Scan parquet" not in again._jdf.queryExecution().executedPlan().toString()
