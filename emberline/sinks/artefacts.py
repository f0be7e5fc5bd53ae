"""Fitted models as tables: readable anywhere Spark is, and nothing pickled."""

from __future__ import annotations

import json
from dataclasses import asdict

import numpy as np
from pyspark.sql import SparkSession

from ..operators.features import Encoder, Scaler
from ..operators.lstm import LstmModel, Shape
from ..operators.pca import PcaModel
from ..operators.scoring import Inputs


def _write_arrays(spark: SparkSession, arrays: dict[str, np.ndarray], path: str) -> None:
    rows = [
        (name, i, [int(x) for x in a.shape], [float(x) for x in row])
        for name, a in arrays.items() for i, row in enumerate(a.reshape(len(a), -1))
    ]
    df = spark.createDataFrame(rows, "name string, i int, shape array<int>, row array<double>")
    df.coalesce(1).write.mode("overwrite").parquet(path)


def _read_arrays(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    out: dict[str, list] = {}
    for r in spark.read.parquet(path).orderBy("name", "i").collect():
        out.setdefault(r["name"], []).append(r)
    return {n: np.array([r["row"] for r in rows]).reshape(rows[0]["shape"]) for n, rows in out.items()}


def save_model(spark: SparkSession, folder: str, inputs: Inputs, model: PcaModel | LstmModel, metadata: dict) -> None:
    """Five tables: vocabulary, embeddings, scaler, weights, metadata. Sizes are fixed by the model."""
    vocabulary = [(t, i + 1) for i, t in enumerate(inputs.encoder.tokens)]
    spark.createDataFrame(vocabulary, "token string, idx int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/vocabulary")
    _write_arrays(spark, {"table": inputs.encoder.table}, f"{folder}/embeddings")
    _write_arrays(spark, {"mean": inputs.scaler.mean, "scale": inputs.scaler.scale}, f"{folder}/scaler")
    if isinstance(model, PcaModel):
        kind, weights = {"kind": "pca"}, {"mean": model.mean, "components": model.components}
    else:
        kind, weights = {"kind": "lstm", **asdict(model.shape)}, {"flat": model.flat[None]}
    _write_arrays(spark, weights, f"{folder}/weights")
    facts = {**metadata, **kind, "seq_len": inputs.seq_len, "keys": list(inputs.keys)}
    spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/metadata")


def load_model(spark: SparkSession, folder: str) -> tuple[Inputs, PcaModel | LstmModel, dict]:
    """Inputs, model and metadata, read through Spark from any file system it knows."""
    facts = json.loads(spark.read.text(f"{folder}/metadata").first()["value"])
    tokens = [r["token"] for r in spark.read.parquet(f"{folder}/vocabulary").orderBy("idx").collect()]
    table = _read_arrays(spark, f"{folder}/embeddings")["table"].astype(np.float32)
    scale = _read_arrays(spark, f"{folder}/scaler")
    inputs = Inputs(Encoder(tokens, table), Scaler(scale["mean"], scale["scale"]), tuple(facts["keys"]), facts["seq_len"])
    weights = _read_arrays(spark, f"{folder}/weights")
    if facts["kind"] == "pca":
        return inputs, PcaModel(weights["mean"], weights["components"]), facts
    shape = Shape(facts["features"], facts["hidden"], facts["latent"])
    return inputs, LstmModel(shape, weights["flat"][0]), facts
