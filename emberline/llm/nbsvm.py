"""Text quality by naive Bayes support vectors.

Features are indicators of word n-grams (runs of letters and digits, and runs of other signs, so that ornaments count as
words), hashed to a fixed number of buckets. Each indicator is scaled by the log ratio of its smoothed frequencies in the
two classes, counted over all training rows by a grouped sum. A linear model with squared hinge loss is then fitted on the
scaled vectors by dual coordinate descent: one dual variable a row, updated in closed form, row by row in random order.
The vectors have unit length, so a text's length is no evidence. A logistic curve fitted to margins of rows
that the descent left out turns margins into probabilities.

The descent and the curve use at most ``FIT_ROWS`` labelled rows, those whose ids and texts hash lowest in their class: the
only sample taken. Classes have their shares of it, but at least ``FIT_LEAST`` rows if there are as many; rows of a class taken
more often than its share weigh less. The fit is one task of that bounded size; the model it returns is two arrays of ``BUCKETS`` numbers.

Cases: a null or empty text has no indicators and gets the share of label 1 that the curve gives to the margin of the bias
alone; unlabelled rows and labels other than 0 and 1 aren't learned from; with one class or none the score is the share of
label 1 (0.5 without labels); repeated rows count as often as they stand there; input columns named like an output
are replaced.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import bounded, with_columns
from .words import RUNS, mix, words

#: Hash buckets of the n-grams, the longest n-gram, and lengths of n-grams of one repeated word.
BUCKETS, LONGEST, REPEATS = 1 << 18, 2, (3, 4, 6)
#: Labelled rows that the descent and the curve see, at most; a fifth of them is for the curve.
FIT_ROWS = 6_000
#: Of each class so many at least.
FIT_LEAST = 600
#: Up to so many labels are broadcast to pick their texts; beyond, texts and labels are joined by a shuffle.
BROADCAST_LABELS = 1_000_000
#: Smoothing of counts, cost of a unit of loss, and passes of the descent.
SMOOTHING, COST, PASSES = 1.0, 1.0, 12


def indicators(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of each text's n-grams, and where each text's begin."""
    found = words(texts, RUNS, lower=False)
    text = found.owners()
    parts, owners = [found.hashes], [text]
    same = (found.hashes[1:] == found.hashes[:-1]) & (text[1:] == text[:-1])
    for n in REPEATS:  # the n-gram of one word n times counts as one feature, whatever the word
        size = max(len(text) - n + 1, 0)
        whole = np.ones(size, dtype=bool)
        for i in range(n - 1):
            whole &= same[i:size + i]
        parts.append(np.full(int(whole.sum()), mix(np.array([n], dtype=np.uint64))[0]))
        owners.append(text[:size][whole])
    for n in range(2, LONGEST + 1):
        size = max(len(text) - n + 1, 0)
        value = np.zeros(size, dtype=np.uint64)
        for i in range(n):
            value = mix(value * np.uint64(0x9E3779B97F4A7C15) + found.hashes[i:size + i])
        whole = text[:size] == text[n - 1:]
        parts.append(value[whole])
        owners.append(text[:size][whole])
    bucket = (np.concatenate(parts) >> np.uint64(20)).astype(np.int64) % BUCKETS
    pairs = np.unique(np.concatenate(owners) * BUCKETS + bucket)
    return pairs % BUCKETS, np.searchsorted(pairs // BUCKETS, np.arange(len(texts) + 1))


@dataclass
class Model:
    """Weights of the buckets (log ratio times hinge weight), log ratios, bias, and the curve's slope and offset."""

    weight: np.ndarray
    ratio: np.ndarray
    bias: float
    slope: float
    offset: float

    def margins(self, bucket: np.ndarray, first: np.ndarray) -> np.ndarray:
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        n = len(first) - 1
        norm = np.sqrt(np.bincount(text, self.ratio[bucket] ** 2, n))
        return np.bincount(text, self.weight[bucket], n) / np.maximum(norm, 1e-12) + self.bias

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(*indicators(texts)) + self.offset, -30, 30)))


def log_ratios(count0: np.ndarray, count1: np.ndarray, n0: float, n1: float) -> np.ndarray:
    """Log of how much more often a bucket's indicator stands in rows of label 1; buckets never seen are 0."""
    p, q = SMOOTHING + count1, SMOOTHING + count0
    out = np.log(p / (n1 + 2 * SMOOTHING)) - np.log(q / (n0 + 2 * SMOOTHING))
    return np.where(count0 + count1 > 0, out, 0.0)


def descend(rows: list[np.ndarray], label: np.ndarray, ratio: np.ndarray, seed: int = 0, worth: np.ndarray | float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and bias of the squared-hinge model by dual coordinate descent; labels are -1 and 1, rows' losses count ``worth`` times."""
    rng = np.random.default_rng(seed)
    values = [ratio[r] / max(np.sqrt((ratio[r] ** 2).sum()), 1e-12) for r in rows]
    weight, bias = np.zeros(len(ratio)), 0.0
    alpha = np.zeros(len(rows))
    ridge = 0.5 / (COST * np.broadcast_to(worth, len(rows)))
    square = np.array([(v * v).sum() for v in values]) + 1.0 + ridge  # 1.0: the bias is a feature that is always 1
    for _ in range(PASSES):
        largest = 0.0
        for i in rng.permutation(len(rows)):
            y = label[i]
            gradient = y * (weight[rows[i]] @ values[i] + bias) - 1.0 + ridge[i] * alpha[i]
            new = max(alpha[i] - gradient / square[i], 0.0)
            step = new - alpha[i]
            if step:
                weight[rows[i]] += step * y * values[i]
                bias += step * y
                alpha[i] = new
                largest = max(largest, abs(step))
        if largest < 1e-3:
            break
    return weight, bias


def curve(margin: np.ndarray, label: np.ndarray, worth: np.ndarray | float = 1.0) -> tuple[float, float]:
    """Slope and offset of a logistic curve from margin to probability of label 1, by Newton's method with smoothed targets."""
    worth = np.broadcast_to(worth, len(label))
    n1, n0 = float(worth[label > 0].sum()), float(worth[label < 0].sum())
    target = np.where(label > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margin, np.ones_like(margin)], axis=1)
    at = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        hessian = (x * (worth * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (worth * (p - target)))
        at = at - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(at[0]), 0.0), float(at[1])


def fit(rows: list[np.ndarray], label: np.ndarray, ratio: np.ndarray, worth: tuple[float, float] = (1.0, 1.0)) -> Model:
    """A model from rows (buckets of each), their labels 0 and 1, the log ratios of all training rows, and the weights of rows of either label."""
    label = np.where(np.asarray(label) == 1, 1.0, -1.0)
    if len(set(label.tolist())) < 2:
        share = 0.5 if not len(label) else float((label > 0).mean())
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(len(ratio)), ratio, 0.0, 0.0, float(np.log(share / (1 - share))))
    aside = np.arange(len(rows)) % 5 == 0
    if min((label[aside] > 0).sum(), (label[aside] < 0).sum(), (label[~aside] > 0).sum(), (label[~aside] < 0).sum()) < 5:
        aside = np.zeros(len(rows), dtype=bool)
    train = np.flatnonzero(~aside)
    each = np.where(label > 0, worth[1], worth[0])
    weight, bias = descend([rows[i] for i in train], label[train], ratio, worth=each[train])
    model = Model(weight * ratio, ratio, bias, 1.0, 0.0)
    check = np.flatnonzero(aside) if aside.any() else train
    flat = np.concatenate([rows[i] for i in check]) if len(check) else np.zeros(0, np.int64)
    first = np.concatenate([[0], np.cumsum([len(rows[i]) for i in check])]).astype(np.int64)
    model.slope, model.offset = curve(model.margins(flat, first), label[check], each[check])
    return model


def labelled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str) -> DataFrame:
    """Rows (id, text, y) of the documents with a label 0 or 1; texts are shuffled only where labels are many."""
    own = labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{label}`").cast("int").alias("y")).where("y IN (0, 1)")
    few = own.count() <= BROADCAST_LABELS
    return docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")).join(
        F.broadcast(own) if few else own, "id")


def class_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Training rows of each class that hold each bucket, and training rows of each class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS + 1), dtype=np.int64)  # the last counts rows
        for batch in batches:
            bucket, first = indicators(batch.column(0))
            y = batch.column(1).to_numpy()
            of = np.repeat(y, np.diff(first))
            for c in (0, 1):
                counts[c, :BUCKETS] += np.bincount(bucket[of == c], minlength=BUCKETS)
                counts[c, BUCKETS] += int((y == c).sum())
        seen = np.flatnonzero(counts.sum(axis=0))
        for a in range(0, len(seen), 65_536):
            some = seen[a:a + 65_536]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[0, some]), pa.array(counts[1, some])],
                                             names=["bucket", "c0", "c1"])

    summed = (rows.select("text", "y").mapInArrow(run, "bucket long, c0 long, c1 long")
              .groupBy("bucket").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))).toArrow()
    out = np.zeros((2, BUCKETS + 1))
    out[:, summed["bucket"].to_numpy()] = summed["c0"].to_numpy(), summed["c1"].to_numpy()
    return out[0, :BUCKETS], out[1, :BUCKETS], float(out[0, BUCKETS]), float(out[1, BUCKETS])


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """A model of ``label`` from the documents that have one; leave rows out of ``labels`` to hold them out."""
    spark = bounded(docs.sparkSession)
    rows = labelled(docs, labels, doc_id, text, label)
    count0, count1, n0, n1 = class_counts(rows)
    ratio = log_ratios(count0, count1, n0, n1)
    n = np.array([n0, n1])
    quota, picked = n, rows
    if n.sum() > FIT_ROWS:
        quota = np.maximum(np.floor(FIT_ROWS * n / n.sum()), np.minimum(n, FIT_LEAST))
        quota[n.argmax()] = min(quota[n.argmax()], FIT_ROWS - quota[n.argmin()])
        hashed = rows.withColumn("h", F.pmod(F.xxhash64("id", "text"), F.lit(1 << 32)))

        def lowest(y: int) -> DataFrame:
            """Rows of one class; those beyond a third more than the quota can be left before the sort."""
            upto = int(min(1.0, 1.3 * quota[y] / max(n[y], 1.0)) * (1 << 32))
            return hashed.where((F.col("y") == y) & (F.col("h") <= upto)).orderBy("h").limit(int(quota[y])).drop("h")

        picked = lowest(0).unionByName(lowest(1))
    worth = n / np.maximum(quota, 1.0)
    worth = tuple(worth * quota.sum() / max(n.sum(), 1.0))

    def vectors(texts: pa.Array):
        bucket, first = indicators(texts)
        raw = bucket.astype("<i4").tobytes()
        return (pa.array([raw[4 * a:4 * b] for a, b in zip(first[:-1], first[1:])], pa.binary()),)

    made = with_columns(picked, ["text"], [T.StructField("buckets", T.BinaryType())], lambda: vectors, drop=["text"])
    shared = spark.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sorted(row for b in batches for row in zip(*[c.to_pylist() for c in b.columns]))
        model = fit([np.frombuffer(b, "<i4").astype(np.int64) for _, _, b in held], np.array([y for _, y, _ in held]), shared.value, worth)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    keyed = made.select(F.xxhash64("id").alias("h"), "y", "buckets")
    return pickle.loads(keyed.repartition(1).mapInArrow(run, "model binary").first()[0])


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """Adds the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        own = shared.value
        return lambda texts: (pa.array(own.scores(texts)),)

    return with_columns(docs, [text], [T.StructField(name, T.DoubleType())], start)
