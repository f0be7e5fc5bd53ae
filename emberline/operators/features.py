"""Vocabulary, message embeddings, 77-value log vectors and the standard scaler."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions import text
from ..session import materialised
from ..shared import Shared

# --- Fixed values: category order, sizes, seed and scale of the embedding table. ---
SOURCES = ["linux", "ssh", "hadoop", "spark", "supercomputer", "hdfs"]
LEVELS = ["DEBUG", "INFO", "WARN", "ERROR", "FATAL"]
VOCAB_SIZE = 5000
EMBED_DIM = 64
EMBED_SEED = 42
EMBED_SCALE = 0.1
# --- End of fixed values. ---
PLAIN_DIMS = len(SOURCES) + len(LEVELS) + 2
N_FEATURES = PLAIN_DIMS + EMBED_DIM
_GATHER = 8192


def build_vocabulary(messages: DataFrame, message: str = "message", size: int = VOCAB_SIZE,
                     order_by: str | None = None) -> DataFrame:
    """``token``, ``n``, ``idx``: the most frequent tokens, ranked from 1.

    Equal counts rank by first appearance when ``order_by`` gives the order of
    the messages, else by token. Counting combines before the shuffle, so a token
    in every message costs no more than any other; only ``size`` rows are ranked.
    """
    if order_by is None:
        words = messages.select(F.explode(text.tokens(F.col(message))).alias("token"))
        counted = words.groupBy("token").agg(F.count("*").alias("n"))
        ties = [F.col("token")]
    else:
        words = messages.select(F.col(order_by).alias("_o"), F.posexplode(text.tokens(F.col(message))).alias("_p", "token"))
        counted = words.groupBy("token").agg(
            F.count("*").alias("n"), F.min(F.struct("_o", "_p")).alias("_first"))
        ties = [F.col("_first"), F.col("token")]
    top = counted.orderBy(F.desc("n"), *ties).limit(size)
    rank = F.row_number().over(W.orderBy(F.desc("n"), *ties))
    return top.select("token", "n", rank.alias("idx"))


def lookup(words: DataFrame, vocabulary: DataFrame, token: str = "token") -> DataFrame:
    """Adds ``idx``, 0 for unknown tokens; the vocabulary has at most VOCAB_SIZE rows."""
    right = F.broadcast(vocabulary.select(F.col("token").alias("_token"), "idx"))
    return (
        words.join(right, F.col(token) == F.col("_token"), "left").drop("_token")
        .withColumn("idx", F.coalesce("idx", F.lit(0)))
    )


def lookup_counts(texts: DataFrame, row_id: str, message: str, vocabulary: DataFrame) -> DataFrame:
    """``row_id``, ``token``, ``idx`` and how often: texts are shuffled by id before they are cut, so their words, many times as large, never are.

    All of the shuffle's partitions are kept, as merged ones would hold too many distinct words to count in memory.
    """
    partitions = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = texts.select(row_id, message).repartition(partitions, row_id).select(row_id, F.explode(text.tokens(F.col(message))).alias("token"))
    return lookup(words, vocabulary).groupBy(row_id, "token", "idx").agg(F.count("*").alias("n"))


def coverage(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Share of tokens the vocabulary knows."""
    known = F.col("idx") > 0
    return lookup(words, vocabulary).agg(
        F.count("*").alias("tokens"), F.count_if(known).alias("known"), F.avg(known.cast("double")).alias("coverage"))


def embedding_table(vocab_size: int = VOCAB_SIZE, dim: int = EMBED_DIM) -> np.ndarray:
    """Seeded table, one row per vocabulary entry; row 0 (unknown) is zero."""
    table = np.random.default_rng(EMBED_SEED).standard_normal((vocab_size + 1, dim)).astype(np.float32) * np.float32(EMBED_SCALE)
    table[0] = 0.0
    return table


def one_hot(value: Column, categories: list[str]) -> list[Column]:
    return [F.coalesce(value == c, F.lit(False)).cast("float") for c in categories]


def hour_cycle(hour: Column) -> tuple[Column, Column]:
    angle = hour.cast("double") * F.lit(2 * math.pi / 24)
    return F.sin(angle), F.cos(angle)


def plain_dims(source: Column, level: Column, hour: Column) -> list[Column]:
    sin, cos = hour_cycle(hour)
    return [*one_hot(source, SOURCES), *one_hot(level, LEVELS), sin.cast("float"), cos.cast("float")]


@dataclass
class Encoder:
    """Fixed-size lookup data (5001 x 64 floats at most) that travels as one broadcast."""

    tokens: list[str]
    table: np.ndarray

    def embed(self, token_lists: pa.ListArray) -> np.ndarray:
        """Mean of the token rows per message; unknown tokens count, no tokens give zeros."""
        if isinstance(token_lists, pa.ChunkedArray):
            token_lists = token_lists.combine_chunks()
        flat = token_lists.flatten()
        known = pc.index_in(flat, value_set=pa.array(self.tokens, flat.type))
        idx = pc.fill_null(pc.add(known, 1), 0).to_numpy(zero_copy_only=False)
        sizes = pc.fill_null(pc.list_value_length(token_lists), 0).to_numpy(zero_copy_only=False)
        message = np.repeat(np.arange(len(sizes)), sizes)
        sums = np.zeros((len(sizes), self.table.shape[1]))
        # Token rows are gathered a few thousand at a time: texts may be long, memory stays small.
        for at in range(0, len(idx), _GATHER):
            part = message[at: at + _GATHER]
            starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            sums[part[starts]] += np.add.reduceat(self.table[idx[at: at + _GATHER]], starts, axis=0, dtype=np.float64)
        return (sums / np.maximum(sizes, 1)[:, None]).astype(np.float32)


def collect_encoder(vocabulary: DataFrame, table: np.ndarray | None = None) -> Encoder:
    """Brings the vocabulary (at most VOCAB_SIZE short rows) to the driver for broadcast."""
    rows = vocabulary.select("token", "idx").collect()
    if len(rows) > VOCAB_SIZE:
        raise ValueError(f"vocabulary has {len(rows)} rows, more than {VOCAB_SIZE}")
    tokens = [r["token"] for r in sorted(rows, key=lambda r: r["idx"])]
    return Encoder(tokens, embedding_table() if table is None else table)


def message_embedding(spark, encoder: Encoder):
    """Arrow function: message -> 64 floats. Tokens are cut on the JVM side."""
    shared = Shared(spark.sparkContext, encoder)

    @F.arrow_udf("array<float>")
    def embed(token_lists: pa.Array) -> pa.Array:
        rows = shared.value.embed(token_lists)
        offsets = pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(rows.ravel(), pa.float32()))

    return lambda message: embed(text.tokens(message))


def log_vectors(enriched: DataFrame, encoder: Encoder, name: str = "vector") -> DataFrame:
    """Adds the 77-value vector: source, level, hour, message."""
    embed = message_embedding(enriched.sparkSession, encoder)
    plain = F.array(*plain_dims(F.col("source"), F.col("level"), F.col("hour")))
    return enriched.withColumn(name, F.concat(plain, embed(F.col("message"))))


_MOMENTS = "dim int, n bigint, mean double, m2 double"


class Moments:
    """Count, mean and squared deviation of each value, added up chunk by chunk."""

    def __init__(self):
        self.n, self.mean, self.m2 = 0, 0.0, 0.0

    def add(self, chunk: np.ndarray) -> None:
        k = len(chunk)
        if k == 0:
            return
        x = chunk.astype(np.float64)
        mu = x.mean(axis=0)
        step = mu - self.mean
        self.m2 = self.m2 + ((x - mu) ** 2).sum(axis=0) + step**2 * self.n * k / (self.n + k)
        self.mean = self.mean + step * k / (self.n + k)
        self.n += k


def log_moments(enriched: DataFrame, encoder: Encoder, by_day: bool = False) -> DataFrame:
    """``dim``, ``n``, ``mean``, ``m2`` of the log vectors of normal rows, one row a task and value; ``by_day`` also a ``date``.

    The vectors are never stored. Rows by day can be: they merge over any days, without reading the lake again.
    """
    shared = Shared(enriched.sparkSession.sparkContext, encoder)
    normal = enriched.where(~F.col("is_anomaly_candidate"))
    day = F.make_date("year", "month", "day") if by_day else F.lit(None).cast("date")
    rows = with_vector_inputs(normal).select(F.unix_date(day).alias("_date"), "_tokens", "_plain")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int | None, Moments] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = vectors_of(pa.Table.from_batches([batch]), shared.value, None)
            dates = np.array(batch.column(0).fill_null(-(1 << 31)))
            for date in np.unique(dates).tolist():
                held.setdefault(date, Moments()).add(x[dates == date])
        for date, m in held.items():
            d = len(m.mean)
            dates = pa.array([None if date == -(1 << 31) else date] * d, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [dates, pa.array(np.arange(d, dtype=np.int32)), pa.array([m.n] * d, pa.int64()), pa.array(m.mean), pa.array(m.m2)],
                names=["_date", "dim", "n", "mean", "m2"])

    found = rows.mapInArrow(run, "_date int, " + _MOMENTS)
    return found.select(*([F.date_from_unix_date("_date").alias("date")] if by_day else []), "dim", "n", "mean", "m2")


def merge_moments(parts: DataFrame, *by: str) -> DataFrame:
    """One row per value (and ``by``) from any number of parts; both sums combine before their shuffles."""
    key = [*by, "dim"]
    total = parts.groupBy(*key).agg(F.sum("n").alias("_n"), (F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("_mean"))
    apart = F.col("m2") + F.col("n") * F.pow(F.col("mean") - F.col("_mean"), F.lit(2.0))
    return (parts.join(total, key).groupBy(*key, F.col("_n").alias("n"), F.col("_mean").alias("mean"))
            .agg(F.sum(apart).alias("m2")).select(*key, "n", "mean", "m2"))


def subtract_moments(whole: DataFrame, part: DataFrame) -> DataFrame:
    """Moments of the rows of ``whole`` that are not those of ``part``, per value: a day taken out of a sum of days."""
    both = whole.join(part.select("dim", F.col("n").alias("_n"), F.col("mean").alias("_mean"), F.col("m2").alias("_m2")), "dim")
    n = F.col("n") - F.col("_n")
    mean = (F.col("n") * F.col("mean") - F.col("_n") * F.col("_mean")) / n
    m2 = F.col("m2") - F.col("_m2") - F.pow(mean - F.col("_mean"), F.lit(2.0)) * n * F.col("_n") / F.col("n")
    return both.where(n > 0).select("dim", n.alias("n"), mean.alias("mean"), F.greatest(m2, F.lit(0.0)).alias("m2"))


def scaler_of(moments: DataFrame) -> DataFrame:
    """``dim``, ``mean``, ``scale`` (population deviation, 1 where it is 0)."""
    deviation = F.sqrt(F.col("m2") / F.col("n"))
    return moments.select("dim", "mean", F.when(deviation == 0, F.lit(1.0)).otherwise(deviation).alias("scale"))


def fit_log_scaler(enriched: DataFrame, encoder: Encoder) -> DataFrame:
    """Scaler of the log vectors of the normal rows."""
    return scaler_of(merge_moments(materialised(log_moments(enriched, encoder))))


@dataclass
class Scaler:
    mean: np.ndarray
    scale: np.ndarray

    def apply(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale).astype(np.float32)


def collect_scaler(fitted: DataFrame) -> Scaler:
    """One row per vector value, so 77 rows."""
    rows = sorted(fitted.collect(), key=lambda r: r["dim"])
    return Scaler(np.array([r["mean"] for r in rows]), np.array([r["scale"] for r in rows]))


def scaled_log_vectors(enriched: DataFrame, encoder: Encoder, scaler: Scaler | None, name: str = "vector") -> DataFrame:
    """Adds the vector as the models see it: made and scaled inside tasks by ``vectors_of``."""
    shared = Shared(enriched.sparkSession.sparkContext, (encoder, scaler))

    @F.arrow_udf("array<float>")
    def vectors(tokens: pa.Array, plain: pa.Array) -> pa.Array:
        rows = vectors_of(pa.table({"_tokens": pa.chunked_array([tokens]), "_plain": pa.chunked_array([plain])}), *shared.value)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)), pa.array(rows.ravel(), pa.float32()))

    return with_vector_inputs(enriched).withColumn(name, vectors(F.col("_tokens"), F.col("_plain"))).drop("_tokens", "_plain")


def value_columns(rows: DataFrame, vector: str, prefix: str, size: int, keep: list[str], digits: int | None = None) -> DataFrame:
    """``keep``, and the first ``size`` values of an array of floats as double columns, rounded to at most six ``digits``, halves away from zero.

    They are laid out inside tasks: so many expressions in one stage are more code than the JVM compiles. Rounding is that of
    ``F.round``: a float times a power of ten up to 10^6 is exact in a double, so no tie is made or lost.
    """
    kept = rows.select(*keep, vector)
    schema = T.StructType([*kept.schema.fields[:-1], *[T.StructField(f"{prefix}{i}", T.DoubleType()) for i in range(size)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(keep))
            values = [pc.cast(pc.list_element(lists, i), pa.float64()) for i in range(size)]
            if digits is not None:
                values = [pc.add(pc.round(x, digits, "half_towards_infinity"), 0.0) for x in values]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *values], names=schema.names)

    return kept.mapInArrow(run, schema)


def with_vector_inputs(enriched: DataFrame) -> DataFrame:
    """Adds what ``vectors_of`` needs; done after a shuffle, so that the shuffle carries the plain text."""
    return enriched.withColumns({
        "_tokens": text.tokens(F.col("message")),
        "_plain": F.array(*plain_dims(F.col("source"), F.col("level"), F.col("hour"))),
    })


def vectors_of(rows: pa.Table, encoder: Encoder, scaler: Scaler | None) -> np.ndarray:
    """Log vectors of the rows of one Arrow batch, inside a task."""
    plain = rows.column("_plain").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    plain = plain.reshape(rows.num_rows, PLAIN_DIMS).astype(np.float32)
    x = np.concatenate([plain, encoder.embed(rows.column("_tokens"))], axis=1)
    return x if scaler is None else scaler.apply(x)
