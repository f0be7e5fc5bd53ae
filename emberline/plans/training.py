"""From enriched rows to a fitted, thresholded and evaluated window model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import evaluate as ev, features as ft, lstm, pca, scoring
from ..operators.windows import HOT_ROWS
from ..session import materialised


def prepare_inputs(enriched: DataFrame) -> scoring.Inputs:
    """Vocabulary of all messages, seeded embeddings, scaler of the normal rows."""
    encoder = ft.collect_encoder(ft.build_vocabulary(enriched))
    return scoring.Inputs(encoder, ft.collect_scaler(ft.fit_log_scaler(enriched, encoder)))


@dataclass
class Fitted:
    inputs: scoring.Inputs
    model: object
    threshold: float
    metadata: dict
    scored: DataFrame
    source: DataFrame | None = None  # the stored rows of the windows, where the fit stored them


def fit(enriched: DataFrame, order: list[str], computed_at: str, kind: str = "pca", hot_rows: int | None = HOT_ROWS,
        percentile: int = ev.THRESHOLD_PERCENTILE, **options) -> Fitted:
    """Fits on normal training windows; the threshold comes from normal validation windows.

    The shuffled and sorted rows are checkpointed once and read by fit and scores alike; so are the scores, since the
    threshold and every report read them again.
    """
    inputs = prepare_inputs(enriched)
    facts: dict = {}
    source = None
    if kind == "pca":
        source = materialised(scoring.window_source(enriched, order, hot_rows, list(inputs.keys), inputs.seq_len))
        model = pca.fit_source(source, inputs, **options)
    else:
        model, history = lstm.fit_lstm(enriched, inputs, order, hot_rows=hot_rows, **options)
        facts = {"train_loss": history.train[-1], "val_loss": history.validation[-1], "best_val_loss": min(history.validation)}
    scored = materialised(scoring.score_windows(enriched, inputs, model, order, hot_rows) if source is None
                          else scoring.score_source(source, inputs, model, order))
    row = ev.fit_threshold(held_out(scored).where(~F.col("label")), percentile).first()
    metadata = {
        "threshold": row["threshold"], "percentile": percentile, "computed_at": computed_at, "n_samples": row["n_samples"],
        "n_features": ft.N_FEATURES, "seq_len": inputs.seq_len, "hidden_size": None, "latent_size": None, "num_layers": None,
        "dropout": None, "vocab_size": len(inputs.encoder.tokens), "embed_dim": inputs.encoder.table.shape[1],
        "train_loss": None, "val_loss": None, "best_val_loss": None, **facts,
    }
    if kind == "pca":
        metadata["latent_size"] = model.components.shape[1]
    else:
        metadata |= {"hidden_size": model.shape.hidden, "latent_size": model.shape.latent, "num_layers": lstm.LAYERS, "dropout": lstm.DROPOUT}
    return Fitted(inputs, model, row["threshold"], metadata, scored, source)


METADATA_SCHEMA = (
    "threshold double, percentile int, computed_at string, n_samples long, n_features int, seq_len int, hidden_size int, "
    "latent_size int, num_layers int, dropout double, vocab_size int, embed_dim int, train_loss double, val_loss double, "
    "best_val_loss double")


def metadata_frame(spark: SparkSession, metadata: dict) -> DataFrame:
    """One row that describes a fitted model; what a kind of model does not have is null."""
    names = [part.split()[0] for part in METADATA_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(metadata[n] for n in names)], METADATA_SCHEMA)


def held_out(scored: DataFrame) -> DataFrame:
    """Windows no model was fitted on: the validation side and every anomalous window."""
    return scored.where(F.col("in_validation") | F.col("label"))


def evaluate(scored: DataFrame, threshold: float) -> DataFrame:
    """Report over all windows and over the held-out ones, told apart by ``windows``."""
    parts = [
        ev.classification_report(ev.predict(rows, threshold)).withColumn("windows", F.lit(name))
        for name, rows in (("all", scored), ("held out", held_out(scored)))
    ]
    return parts[0].unionByName(parts[1])
