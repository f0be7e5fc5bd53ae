"""LSTM autoencoder of log windows, trained and applied by Spark tasks.

The network: two bidirectional LSTM layers, a dense code, a dense layer repeated
over time, two LSTM layers, a softmax over time that weighs the steps, a dense
output. Training is data parallel: in each epoch every task runs Adam over its
own windows from the same start, and the weights are averaged by window count
(parallelised SGD, Zinkevich et al. 2010). The averaging is a Spark aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from ..session import materialised
from ..shared import Shared
from .features import N_FEATURES
from .scoring import Inputs, vector_windows, window_source
from .windows import HOT_ROWS

# --- Fixed values: sizes and training settings. ---
HIDDEN = 64
LATENT = 32
LAYERS = 2
DROPOUT = 0.2
BATCH = 64
EPOCHS = 50
RATE = 1e-3
CLIP = 1.0
STOP_AFTER = 7
HALVE_AFTER = 3
# --- End of fixed values. ---
_BETA1, _BETA2, _EPSILON = 0.9, 0.999, 1e-8
_CHUNK = 4096


@dataclass
class Shape:
    features: int = N_FEATURES
    hidden: int = HIDDEN
    latent: int = LATENT

    def parameters(self) -> dict[str, tuple[int, ...]]:
        """Name and shape of every weight. Each LSTM has input, state and two bias blocks."""
        h = self.hidden
        out: dict[str, tuple[int, ...]] = {}
        for part, layer, width in [("enc", 0, self.features), ("enc", 1, 2 * h), ("dec", 0, h), ("dec", 1, h)]:
            for way in ("f", "b") if part == "enc" else ("f",):
                name = f"{part}{layer}{way}"
                out |= {f"{name}.x": (4 * h, width), f"{name}.h": (4 * h, h), f"{name}.b1": (4 * h,), f"{name}.b2": (4 * h,)}
        dense = {"code": (self.latent, 2 * h), "open": (h, self.latent), "weigh": (1, h), "out": (self.features, h)}
        for name, shape in dense.items():
            out |= {f"{name}.w": shape, f"{name}.b": shape[:1]}
        return out

    def count(self) -> int:
        return sum(int(np.prod(s)) for s in self.parameters().values())

    def start(self, seed: int = 42) -> np.ndarray:
        """Uniform start within one over the root of the fan-in (of the state size for LSTMs)."""
        rng = np.random.default_rng(seed)
        fan = {"code": 2 * self.hidden, "open": self.latent, "weigh": self.hidden, "out": self.hidden}
        return np.concatenate([
            rng.uniform(-1, 1, int(np.prod(s))) / np.sqrt(fan.get(name.split(".")[0], self.hidden))
            for name, s in self.parameters().items()
        ])

    def unpack(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.parameters().items():
            size = int(np.prod(shape))
            out[name] = flat[at: at + size].reshape(shape)
            at += size
        return out


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def _run_lstm(p, name, x):
    """States over time for inputs (n, steps, width), and what the way back needs."""
    wx, wh, bias = p[f"{name}.x"], p[f"{name}.h"], p[f"{name}.b1"] + p[f"{name}.b2"]
    n, steps, _ = x.shape
    hidden = wh.shape[1]
    drive = x @ wx.T + bias
    h, c = np.zeros((n, hidden), x.dtype), np.zeros((n, hidden), x.dtype)
    states, kept = np.empty((n, steps, hidden), x.dtype), []
    for t in range(steps):
        i, f, g, o = np.split(drive[:, t] + h @ wh.T, 4, axis=1)
        i, f, g, o = _sigmoid(i), _sigmoid(f), np.tanh(g), _sigmoid(o)
        before_h, before_c = h, c
        c = f * c + i * g
        squashed = np.tanh(c)
        h = o * squashed
        states[:, t] = h
        kept.append((i, f, g, o, before_h, before_c, squashed))
    return states, (x, kept)


def _back_lstm(p, grads, name, saved, d_states):
    """Adds weight gradients; returns the gradient of the inputs."""
    x, kept = saved
    wx, wh = p[f"{name}.x"], p[f"{name}.h"]
    n, steps, hidden = d_states.shape
    d_gates = np.empty((n, steps, 4 * hidden), x.dtype)
    dh, dc = np.zeros((n, hidden), x.dtype), np.zeros((n, hidden), x.dtype)
    for t in reversed(range(steps)):
        i, f, g, o, before_h, before_c, squashed = kept[t]
        dh = dh + d_states[:, t]
        dc = dc + dh * o * (1 - squashed**2)
        d = np.concatenate(
            [dc * g * i * (1 - i), dc * before_c * f * (1 - f), dc * i * (1 - g**2), dh * squashed * o * (1 - o)], axis=1)
        d_gates[:, t] = d
        grads[f"{name}.h"] += d.T @ before_h
        dh, dc = d @ wh, dc * f
    flat = d_gates.reshape(-1, 4 * hidden)
    grads[f"{name}.x"] += flat.T @ x.reshape(-1, x.shape[2])
    grads[f"{name}.b1"] += flat.sum(axis=0)
    grads[f"{name}.b2"] += flat.sum(axis=0)
    return d_gates @ wx


def _mask(rng, like, rate):
    if rng is None or rate == 0:
        return like.dtype.type(1)
    return (rng.random(like.shape, dtype=np.float32) >= rate).astype(like.dtype) / like.dtype.type(1 - rate)


def run_network(p, x, rng=None, dropout=DROPOUT):
    """Reconstruction of windows (n, steps, features) and saved values; dropout only with ``rng``."""
    n, steps, _ = x.shape
    saved = {"x": x}
    low_f, saved["enc0f"] = _run_lstm(p, "enc0f", x)
    low_b, saved["enc0b"] = _run_lstm(p, "enc0b", x[:, ::-1])
    low = np.concatenate([low_f, low_b[:, ::-1]], axis=2)
    saved["m_low"] = _mask(rng, low, dropout)
    low = low * saved["m_low"]
    top_f, saved["enc1f"] = _run_lstm(p, "enc1f", low)
    top_b, saved["enc1b"] = _run_lstm(p, "enc1b", low[:, ::-1])
    ends = np.concatenate([top_f[:, -1], top_b[:, -1]], axis=1)
    saved["m_ends"] = _mask(rng, ends, dropout)
    saved["ends"] = ends * saved["m_ends"]
    saved["latent"] = saved["ends"] @ p["code.w"].T + p["code.b"]
    opened = saved["latent"] @ p["open.w"].T + p["open.b"]
    first, saved["dec0f"] = _run_lstm(p, "dec0f", np.repeat(opened[:, None], steps, axis=1))
    saved["m_first"] = _mask(rng, first, dropout)
    second, saved["dec1f"] = _run_lstm(p, "dec1f", first * saved["m_first"])
    logits = second @ p["weigh.w"].T + p["weigh.b"]
    weights = np.exp(logits - logits.max(axis=1, keepdims=True))
    weights /= weights.sum(axis=1, keepdims=True)
    saved["second"], saved["weights"] = second, weights
    saved["m_out"] = _mask(rng, second, dropout)
    saved["weighed"] = second * weights * saved["m_out"]
    return saved["weighed"] @ p["out.w"].T + p["out.b"], saved


def loss_and_gradient(shape: Shape, flat: np.ndarray, x: np.ndarray, rng=None, dropout=DROPOUT):
    """Mean squared reconstruction error of a batch and its gradient."""
    p = shape.unpack(flat)
    total = np.zeros_like(flat)
    grads = shape.unpack(total)
    out, s = run_network(p, x, rng, dropout)
    n, steps, features = x.shape
    h = shape.hidden
    error = out - x
    d_out = error * x.dtype.type(2.0 / error.size)
    grads["out.w"] += d_out.reshape(-1, features).T @ s["weighed"].reshape(-1, h)
    grads["out.b"] += d_out.sum(axis=(0, 1))
    d_weighed = (d_out @ p["out.w"]) * s["m_out"]
    d_weights = (d_weighed * s["second"]).sum(axis=2, keepdims=True)
    d_logits = s["weights"] * (d_weights - (s["weights"] * d_weights).sum(axis=1, keepdims=True))
    grads["weigh.w"] += (d_logits * s["second"]).sum(axis=(0, 1))[None]
    grads["weigh.b"] += d_logits.sum()
    d_second = d_weighed * s["weights"] + d_logits * p["weigh.w"]
    d_first = _back_lstm(p, grads, "dec1f", s["dec1f"], d_second) * s["m_first"]
    d_opened = _back_lstm(p, grads, "dec0f", s["dec0f"], d_first).sum(axis=1)
    grads["open.w"] += d_opened.T @ s["latent"]
    grads["open.b"] += d_opened.sum(axis=0)
    d_latent = d_opened @ p["open.w"]
    grads["code.w"] += d_latent.T @ s["ends"]
    grads["code.b"] += d_latent.sum(axis=0)
    d_ends = (d_latent @ p["code.w"]) * s["m_ends"]
    d_top = np.zeros((n, steps, h), x.dtype)
    d_top[:, -1] = d_ends[:, :h]
    d_low = _back_lstm(p, grads, "enc1f", s["enc1f"], d_top)
    d_top = np.zeros((n, steps, h), x.dtype)
    d_top[:, -1] = d_ends[:, h:]
    d_low = (d_low + _back_lstm(p, grads, "enc1b", s["enc1b"], d_top)[:, ::-1]) * s["m_low"]
    _back_lstm(p, grads, "enc0f", s["enc0f"], d_low[:, :, :h])
    _back_lstm(p, grads, "enc0b", s["enc0b"], d_low[:, ::-1, h:])
    return float((error**2).mean()), total


@dataclass
class LstmModel:
    shape: Shape
    flat: np.ndarray

    def errors(self, windows: np.ndarray) -> np.ndarray:
        """Mean squared reconstruction error per window."""
        p = self.shape.unpack(self.flat.astype(np.float32))
        out = []
        for at in range(0, len(windows), 1024):
            x = windows[at: at + 1024].astype(np.float32)
            out.append(((run_network(p, x)[0] - x) ** 2).mean(axis=(1, 2), dtype=np.float64))
        return np.concatenate(out) if out else np.zeros(0)


@dataclass
class Adam:
    """Weights with their moment estimates, as one vector that can be averaged."""

    flat: np.ndarray
    first: np.ndarray
    second: np.ndarray
    steps: float = 0.0

    def step(self, gradient: np.ndarray, rate: float) -> None:
        norm = np.linalg.norm(gradient)
        if norm > CLIP:
            gradient = gradient * (CLIP / (norm + 1e-6))
        self.steps += 1
        self.first = _BETA1 * self.first + (1 - _BETA1) * gradient
        self.second = _BETA2 * self.second + (1 - _BETA2) * gradient**2
        mean = self.first / (1 - _BETA1**self.steps)
        spread = self.second / (1 - _BETA2**self.steps)
        self.flat = self.flat - rate * mean / (np.sqrt(spread) + _EPSILON)

    def packed(self) -> np.ndarray:
        return np.concatenate([self.flat, self.first, self.second, [self.steps]])

    @staticmethod
    def unpacked(vector: np.ndarray) -> Adam:
        size = (len(vector) - 1) // 3
        return Adam(vector[:size], vector[size: 2 * size], vector[2 * size: 3 * size], float(vector[-1]))


@dataclass
class History:
    train: list[float] = field(default_factory=list)
    validation: list[float] = field(default_factory=list)
    rates: list[float] = field(default_factory=list)


def _epoch(source: DataFrame, inputs: Inputs, shape: Shape, state: Adam, rate: float, seed: int) -> tuple[Adam, float]:
    """One pass of every task over its windows, then the weighted mean of their results."""
    shared = Shared(source.sparkSession.sparkContext, (inputs, shape, state.packed()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, net, start = shared.value
        local, rng = Adam.unpacked(start.astype(np.float32)), np.random.default_rng(seed)
        n, loss = 0, 0.0
        for _, _, windows, labels, validation in vector_windows(batches, held):
            x = windows[~labels & ~validation].astype(np.float32)
            x = x[rng.permutation(len(x))]
            for at in range(0, len(x), BATCH):
                part = x[at: at + BATCH]
                value, gradient = loss_and_gradient(net, local.flat, part, rng)
                local.step(gradient, rate)
                n, loss = n + len(part), loss + value * len(part)
        if n:
            vector = np.concatenate([local.packed().astype(np.float64) * n, [loss]])
            vector = np.pad(vector, (0, -len(vector) % _CHUNK))
            pieces = len(vector) // _CHUNK
            offsets = pa.array(np.arange(0, len(vector) + 1, _CHUNK, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(pieces, dtype=np.int32)), pa.array([n] * pieces, pa.int64()),
                 pa.ListArray.from_arrays(offsets, pa.array(vector))], names=["piece", "n", "sums"])

    parts = source.mapInArrow(run, "piece int, n bigint, sums array<double>")
    merged = parts.groupBy("piece").agg(
        F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"))
    rows = sorted(merged.collect(), key=lambda r: r["piece"])
    if not rows:
        raise ValueError("no normal window to train on")
    mean = np.concatenate([np.array(r["sums"]) for r in rows]) / rows[0]["n"]
    size = 3 * len(state.flat) + 1
    return Adam.unpacked(mean[:size]), float(mean[size])


def mean_error(source: DataFrame, inputs: Inputs, model: LstmModel) -> float:
    """Mean score of normal validation windows."""
    shared = Shared(source.sparkSession.sparkContext, (inputs, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, net = shared.value
        n, total = 0, 0.0
        for _, _, windows, labels, validation in vector_windows(batches, held):
            x = windows[~labels & validation]
            n, total = n + len(x), total + float(net.errors(x).sum())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total])], names=["n", "total"])

    row = source.mapInArrow(run, "n bigint, total double").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    return row["total"] / row["n"] if row["n"] else float("inf")


def fit_lstm(enriched: DataFrame, inputs: Inputs, order: list[str], shape: Shape | None = None, epochs: int = EPOCHS,
             rate: float = RATE, seed: int = 42, hot_rows: int | None = HOT_ROWS) -> tuple[LstmModel, History]:
    """Best model by validation error, with the losses per epoch.

    The sorted blocks are checkpointed once and read by every epoch. The rate is
    halved after more than 3 epochs without gain, and training stops after 7.
    """
    shape = shape or Shape()
    source = materialised(window_source(enriched, order, hot_rows, list(inputs.keys), inputs.seq_len))
    zero = np.zeros(shape.count())
    state = Adam(shape.start(seed), zero, zero.copy())
    best, best_model, stale, flat_for, history = float("inf"), None, 0, 0, History()
    lowest = float("inf")
    for epoch in range(epochs):
        state, loss = _epoch(source, inputs, shape, state, rate, seed + epoch)
        model = LstmModel(shape, state.flat.copy())
        error = mean_error(source, inputs, model)
        history.train.append(loss)
        history.validation.append(error)
        history.rates.append(rate)
        # Plateau rule of the rate: only a relative gain of 1e-4 counts.
        if error < lowest * (1 - 1e-4):
            lowest, flat_for = error, 0
        else:
            flat_for += 1
            if flat_for > HALVE_AFTER:
                rate, flat_for = rate * 0.5, 0
        if error < best or best_model is None:
            best, best_model, stale = error, model, 0
        else:
            stale += 1
            if stale >= STOP_AFTER:
                break
    return best_model, history
