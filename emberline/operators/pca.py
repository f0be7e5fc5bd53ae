"""Linear reconstruction model: principal components of normal windows.

Spark tasks reduce their windows to sums and a product matrix of fixed size; the
partial matrices are added up by row on the executors, and only the finished
770 x 770 matrix reaches the driver, which takes its leading eigenvectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from ..shared import Shared
from .scoring import Inputs, vector_windows, window_source
from .windows import HOT_ROWS

LATENT = 32  # fixed value
#: Windows taken at a time: their tenfold copy as doubles, about 3 MB, stays in a core's cache.
_STEP = 512


@dataclass
class PcaModel:
    mean: np.ndarray
    components: np.ndarray

    def errors(self, windows: np.ndarray) -> np.ndarray:
        """Mean squared reconstruction error per window (orthonormal components)."""
        out = np.empty(len(windows))
        for at in range(0, len(windows), _STEP):
            x = windows[at: at + _STEP].reshape(-1, len(self.mean)).astype(np.float64)
            x -= self.mean
            kept = x @ self.components
            out[at: at + _STEP] = np.einsum("ij,ij->i", x, x) - np.einsum("ij,ij->i", kept, kept)
        return np.maximum(out, 0.0) / len(self.mean)


def product_sums(source: DataFrame, inputs: Inputs) -> DataFrame:
    """From a frame of ``window_source``, per value ``i`` of the flattened window: n, sum, and row ``i`` of the product matrix (training windows)."""
    shared = Shared(source.sparkSession.sparkContext, inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, product = 0, None, None
        for _, _, windows, labels, validation in vector_windows(batches, shared.value):
            used = np.flatnonzero(~labels & ~validation)
            for at in range(0, len(used), _STEP):
                x = windows[used[at: at + _STEP]]
                x = x.reshape(len(x), -1).astype(np.float64)
                n += len(x)
                total = x.sum(axis=0) if total is None else total + x.sum(axis=0)
                product = x.T @ x if product is None else product + x.T @ x
        if n:
            d = len(total)
            offsets = pa.array(np.arange(0, d * d + 1, d, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(d, dtype=np.int32)), pa.array([n] * d, pa.int64()), pa.array(total),
                 pa.ListArray.from_arrays(offsets, pa.array(product.ravel()))],
                names=["i", "n", "total", "product"])

    parts = source.mapInArrow(
        run, "i int, n bigint, total double, product array<double>")
    return parts.groupBy("i").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"),
        vector_to_array(Summarizer.sum(array_to_vector("product"))).alias("product"))


def fit_pca(enriched: DataFrame, inputs: Inputs, order: list[str], k: int = LATENT,
            hot_rows: int | None = HOT_ROWS) -> PcaModel:
    return fit_source(window_source(enriched, order, hot_rows, list(inputs.keys), inputs.seq_len), inputs, k)


def fit_source(source: DataFrame, inputs: Inputs, k: int = LATENT) -> PcaModel:
    rows = sorted(product_sums(source, inputs).collect(), key=lambda r: r["i"])
    if not rows:
        raise ValueError("no normal window to fit on")
    n = rows[0]["n"]
    mean = np.array([r["total"] for r in rows]) / n
    covariance = np.array([r["product"] for r in rows]) / n - np.outer(mean, mean)
    _, vectors = np.linalg.eigh(covariance)
    return PcaModel(mean, np.ascontiguousarray(vectors[:, ::-1][:, :k]))
