"""Windows of log vectors fed to a model inside Spark tasks.

The shuffle carries plain log rows. Vectors are built once per row after it, and
windows are views over them, so the tenfold copy of the data is never stored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..shared import Shared
from .features import Encoder, Scaler, vectors_of, with_vector_inputs
from .windows import HOT_ROWS, KEYS, SEQ_LEN, full_windows, sorted_blocks

SPLIT_SEED = 42  # fixed value
VALIDATION_SHARE = 0.2  # fixed value


@dataclass
class Inputs:
    """Lookup data of a window scorer; fixed size, one broadcast."""

    encoder: Encoder
    scaler: Scaler | None
    keys: tuple[str, ...] = tuple(KEYS)
    seq_len: int = SEQ_LEN


def in_validation(df: DataFrame, identity: list[str], share: float = VALIDATION_SHARE, seed: int = SPLIT_SEED) -> Column:
    """Repeatable split of windows by what identifies their last row; no shuffle, no shared state.

    The first 32 bits of the MD5 of the parts (times as microseconds, missing ones as nothing), so any engine can tell the side.
    """
    parts = [F.unix_micros(c) if isinstance(df.schema[c].dataType, T.TimestampType) else F.col(c) for c in identity]
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts], F.lit(str(seed)))
    place = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    return place % 10_000 < int(share * 10_000)


def window_source(enriched: DataFrame, order: list[str], hot_rows: int | None, keys: list[str] = KEYS,
                  size: int = SEQ_LEN, record: list[str] = ()) -> DataFrame:
    """Sorted blocks with vector inputs, ``_val`` (split) and only the columns scoring needs."""
    wanted = list(dict.fromkeys([*keys, *order, "source", "level", "hour", "message", "is_anomaly_candidate", *record]))
    blocks = sorted_blocks(enriched.select(*wanted), order, keys, size, hot_rows)
    return with_vector_inputs(blocks.withColumn("_val", in_validation(blocks, [*keys, *order])))


def vector_windows(batches: Iterator[pa.RecordBatch], inputs: Inputs):
    """Yields (rows, ends, windows, labels, validation) per batch; windows are (k, seq_len, features)."""
    for rows, ends in full_windows(batches, list(inputs.keys), inputs.seq_len):
        if len(ends) == 0:
            continue
        x = vectors_of(rows, inputs.encoder, inputs.scaler)
        views = np.lib.stride_tricks.sliding_window_view(x, inputs.seq_len, axis=0)
        windows = views[ends - inputs.seq_len + 1].transpose(0, 2, 1)
        flags = rows.column("is_anomaly_candidate").to_numpy(zero_copy_only=False).astype(bool)
        seen = np.concatenate([[0], np.cumsum(flags)])
        labels = seen[ends + 1] - seen[ends + 1 - inputs.seq_len] > 0
        validation = rows.column("_val").to_numpy(zero_copy_only=False).astype(bool)[ends]
        yield rows, ends, windows, labels, validation


def score_windows(enriched: DataFrame, inputs: Inputs, model, order: list[str], hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """One row per full window: keys, order columns of its last row, ``label``, ``in_validation``, ``score``.

    ``model`` has ``errors(windows) -> array`` and a bounded size; it is broadcast.
    """
    return score_source(window_source(enriched, order, hot_rows, list(inputs.keys), inputs.seq_len), inputs, model, order)


def anomalies_of(enriched: DataFrame, inputs: Inputs, model, order: list[str], threshold: float, record: list[str],
                 hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Windows above ``threshold`` with their records in ``sequence``, which are gathered for these windows only."""
    source = window_source(enriched, order, hot_rows, list(inputs.keys), inputs.seq_len, record)
    return score_source(source, inputs, model, order, threshold, record)


def score_source(source: DataFrame, inputs: Inputs, model, order: list[str], threshold: float | None = None,
                 record: list[str] = ()) -> DataFrame:
    """The same from a frame of ``window_source``, so that several passes can share one."""
    shown = list(dict.fromkeys([*inputs.keys, *order]))
    shared = Shared(source.sparkSession.sparkContext, (inputs, model))
    kinds = {f.name: f.dataType for f in source.schema.fields}
    schema = T.StructType(
        [T.StructField(c, kinds[c]) for c in shown]
        + [T.StructField("label", T.BooleanType()), T.StructField("in_validation", T.BooleanType()),
           T.StructField("score", T.DoubleType())]
    )
    if record:
        schema = schema.add("sequence", T.ArrayType(T.StructType([T.StructField(c, kinds[c]) for c in record])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, scorer = shared.value
        for rows, ends, windows, labels, validation in vector_windows(batches, held):
            errors = np.asarray(scorer.errors(windows), dtype=np.float64)
            hit = np.arange(len(ends)) if threshold is None else np.flatnonzero(errors > threshold)
            out = rows.select(shown).take(pa.array(ends[hit]))
            out = out.append_column("label", pa.array(labels[hit]))
            out = out.append_column("in_validation", pa.array(validation[hit]))
            out = out.append_column("score", pa.array(errors[hit]))
            if record:
                out = out.append_column("sequence", sequences(rows, ends[hit], held.seq_len, list(record)))
            yield from out.combine_chunks().to_batches()

    return source.mapInArrow(run, schema)


def hit_windows(enriched: DataFrame, order: list[str], hit: Column, record: list[str], keep: list[str] = (),
                keys: list[str] = KEYS, size: int = SEQ_LEN, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Full windows whose last row meets ``hit``: keys, order and ``keep`` of that row, ``label`` and ``sequence``.

    Records are gathered for these windows only.
    """
    shown = list(dict.fromkeys([*keys, *order, *keep]))
    rows = enriched.select(*dict.fromkeys([*shown, *record, "is_anomaly_candidate"]), F.coalesce(hit, F.lit(False)).alias("_hit"))
    blocks = sorted_blocks(rows, order, keys, size, hot_rows)
    kinds = {f.name: f.dataType for f in blocks.schema.fields}
    schema = T.StructType([*[T.StructField(c, kinds[c]) for c in shown], T.StructField("label", T.BooleanType()),
                           T.StructField("sequence", T.ArrayType(T.StructType([T.StructField(c, kinds[c]) for c in record])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ends in full_windows(batches, keys, size):
            ends = ends[rows.column("_hit").to_numpy(zero_copy_only=False).astype(bool)[ends]]
            if not len(ends):
                continue
            flags = rows.column("is_anomaly_candidate").to_numpy(zero_copy_only=False).astype(bool)
            seen = np.concatenate([[0], np.cumsum(flags)])
            out = rows.select(shown).take(pa.array(ends))
            out = out.append_column("label", pa.array(seen[ends + 1] - seen[ends + 1 - size] > 0))
            out = out.append_column("sequence", sequences(rows, ends, size, record))
            yield from out.combine_chunks().to_batches()

    return blocks.mapInArrow(run, schema)


def sequences(rows: pa.Table, ends: np.ndarray, size: int, names: list[str]) -> pa.ListArray:
    """Records of the windows that end at ``ends``, oldest first, as lists of structs."""
    at = pa.array((ends[:, None] + np.arange(1 - size, 1)).ravel())
    columns = [rows.column(n).combine_chunks().take(at) for n in names]
    offsets = pa.array(np.arange(0, len(ends) * size + 1, size, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, names))


def score_runs(runs: DataFrame, inputs: Inputs, model, threshold: float, shown: list[str], record: list[str]) -> DataFrame:
    """Windows above ``threshold`` of rows that already lie in order, run after run (a stream's state output).

    Gives ``shown`` of the last row, ``label``, ``score`` and ``sequence``; records
    are gathered for the hits only.
    """
    shared = Shared(runs.sparkSession.sparkContext, (inputs, model))
    fields = {f.name: f.dataType for f in runs.schema.fields}
    schema = T.StructType(
        [T.StructField(c, fields[c]) for c in shown]
        + [T.StructField("label", T.BooleanType()), T.StructField("score", T.DoubleType()),
           T.StructField("sequence", T.ArrayType(T.StructType([T.StructField(c, fields[c]) for c in record])))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, scorer = shared.value
        for rows, ends, windows, labels, _ in vector_windows(batches, held):
            errors = np.asarray(scorer.errors(windows), dtype=np.float64)
            hit = np.flatnonzero(errors > threshold)
            if len(hit) == 0:
                continue
            out = rows.select(shown).take(pa.array(ends[hit]))
            out = out.append_column("label", pa.array(labels[hit])).append_column("score", pa.array(errors[hit]))
            out = out.append_column("sequence", sequences(rows, ends[hit], held.seq_len, record))
            yield from out.combine_chunks().to_batches()

    return with_vector_inputs(runs.withColumn("_val", F.lit(False))).mapInArrow(run, schema)
