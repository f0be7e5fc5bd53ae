"""Sliding count windows over a stream, in order of event time: rows wait until the watermark has passed them.

The state of a key is two lists, in RocksDB: rows that wait for the watermark, and the last nine rows it has let
through. Rows may come in any order and in any micro-batch, as long as they are no later than the watermark allows; what
comes later is dropped by Spark, counted in its progress, and found again by ``streaming.late``. Event-time timers let waiting
rows through and forget keys gone silent, so a replay does the same again; a time to live by the clock would not.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.scoring import sequences
from ..operators.windows import KEYS, SEQ_LEN, full_windows

RECORD = ["timestamp", "level", "message"]
_ROW = T.StructType([
    T.StructField("source", T.StringType()), T.StructField("host", T.StringType()),
    T.StructField("timestamp", T.StringType()), T.StructField("level", T.StringType()),
    T.StructField("message", T.StringType()), T.StructField("hour", T.IntegerType()),
    T.StructField("is_anomaly_candidate", T.BooleanType()), T.StructField("position", T.LongType()),
    T.StructField("_halo", T.BooleanType()), T.StructField("_block", T.IntegerType()),
])
#: What the state holds of a row: its time in microseconds first, then the columns that are no keys.
_HELD = ["micros", "position", "timestamp", "level", "message", "hour", "is_anomaly_candidate"]
_STATE = T.StructType([T.StructField("micros", T.LongType()), *[_ROW[c] for c in _HELD[1:]]])

LATENESS = "10 minutes"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(spark: SparkSession) -> None:
    """Streams started from now on keep their state in RocksDB, which lists and timers need; running ones keep what they have."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _plain(values: pd.Series) -> list:
    """Python values, None for a missing one."""
    if values.hasnans:
        return values.astype(object).where(values.notna(), None).tolist()
    return values.tolist()


@contextmanager
def state_partitions(spark: SparkSession, least: int = 8) -> Iterator[None]:
    """Streams started inside keep their state in as many partitions as tasks run at once, at least ``least``, never more than configured.

    Every micro-batch opens, writes and commits each partition's state with a Python worker of its own, however few rows it has.
    A stream keeps the number it began with.
    """
    key = "spark.sql.shuffle.partitions"
    configured = spark.conf.get(key)
    spark.conf.set(key, str(min(int(configured), max(least, spark.sparkContext.defaultParallelism))))
    try:
        yield
    finally:
        spark.conf.set(key, configured)


class InOrder(StatefulProcessor):
    """Rows of a key in order of (event time, position) once the watermark has passed them, led by the rows before."""

    def __init__(self, size: int, idle_minutes: int | None):
        self.carry, self.idle = size - 1, idle_minutes and idle_minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _STATE)
        self.kept = handle.getListState("kept", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = [r for part in rows for r in zip(*[_plain(part[c]) for c in _HELD])]
        yield from self._let_through(key, list(self.waiting.get()), fresh, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._let_through(key, list(self.waiting.get()), [], timerValues.getCurrentWatermarkInMs())

    def _let_through(self, key, waited: list[tuple], fresh: list[tuple], watermark: int) -> Iterator[pd.DataFrame]:
        waiting = [*waited, *fresh]
        ready = sorted((r for r in waiting if r[0] <= watermark * 1000), key=lambda r: (r[0], r[1]))
        rest = [r for r in waiting if r[0] > watermark * 1000]
        kept = list(self.kept.get()) if ready or self.idle else []
        if ready:
            rows = [*kept, *ready]
            block = np.zeros(len(rows), dtype=np.int32)
            if self.idle:
                times = np.array([r[0] for r in rows])
                block[1:] = np.cumsum(np.diff(times) // 1000 > self.idle)
            own = [r for r, b in zip(rows[-self.carry:], block[-self.carry:]) if b == block[-1]] if self.carry else []
            self._put(self.kept, own)
            held = dict(zip(_HELD, zip(*rows)))
            held |= {"source": [key[0]] * len(rows), "host": [key[1]] * len(rows), "_halo": np.arange(len(rows)) < len(kept), "_block": block}
            yield pd.DataFrame({c: held[c] for c in _ROW.names})
            kept = rows[-1:]
        if rest != waited:
            self._put(self.waiting, rest)
        forgotten = self.idle and kept and not rest and kept[-1][0] // 1000 + self.idle <= watermark
        if forgotten:
            self.kept.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if rest:
            self.handle.registerTimer(-(-min(r[0] for r in rest) // 1000))
        elif self.idle and kept and not forgotten:
            self.handle.registerTimer(kept[-1][0] // 1000 + self.idle)

    @staticmethod
    def _put(state, rows: list[tuple]) -> None:
        if rows:
            state.put(rows)
        else:
            state.clear()

    def close(self) -> None:
        pass


def stream_runs(enriched: DataFrame, position: str, size: int = SEQ_LEN, lateness: str = LATENESS,
                idle_minutes: int | None = None) -> DataFrame:
    """Rows in order, key after key, each run led by the (at most ``size - 1``) rows let through before.

    Rows go by (event time, ``position``, an integer). The rows from before are marked ``_halo``: they complete windows
    and end none. What one call holds is what a key has within ``lateness`` and one micro-batch.
    A silence of more than ``idle_minutes`` of event time ends a key's run: no window spans it, and its rows are forgotten.
    """
    keyed_state(enriched.sparkSession)
    wanted = enriched.withColumn("position", F.col(position).cast("bigint")).withColumn("micros", F.unix_micros("event_time"))
    wanted = wanted.select(*KEYS, "event_time", *_HELD).withWatermark("event_time", lateness)
    return wanted.groupBy(*KEYS).transformWithStateInPandas(InOrder(size, idle_minutes), _ROW, "append", "eventtime")


def stream_windows(enriched: DataFrame, position: str, size: int = SEQ_LEN, lateness: str = LATENESS,
                   idle_minutes: int | None = None) -> DataFrame:
    """One row per row from the ``size``-th of its key on: position, label and the window's records."""
    schema = T.StructType([
        *[_ROW[c] for c in ("source", "host", "position")], T.StructField("label", T.BooleanType()),
        T.StructField("sequence", T.ArrayType(T.StructType([_ROW[c] for c in RECORD]))),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ends in full_windows(batches, KEYS, size):
            if len(ends) == 0:
                continue
            flags = rows.column("is_anomaly_candidate").to_numpy(zero_copy_only=False).astype(bool)
            seen = np.concatenate([[0], np.cumsum(flags)])
            out = rows.select(["source", "host", "position"]).take(pa.array(ends))
            out = out.append_column("label", pa.array(seen[ends + 1] - seen[ends + 1 - size] > 0))
            out = out.append_column("sequence", sequences(rows, ends, size, RECORD))
            yield from out.combine_chunks().to_batches()

    return stream_runs(enriched, position, size, lateness, idle_minutes).mapInArrow(run, schema)
