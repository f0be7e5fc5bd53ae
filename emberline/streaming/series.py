"""Infrastructure series as streams: aligned means, increases and rates, and alerts that open and close.

Points wait in a key's state until the watermark has passed their whole period, then they are taken in order of time and
place, so every period is told once and is final. A counter remembers its last value; an alert remembers the run of
periods it is in. Both are small values in RocksDB; what waits is what one series has within the lateness and a period,
as chunks of packed points: a state row for each point costs a hundred times what its arithmetic does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.metrics import DELTA_SECONDS, MEAN_SECONDS
from .windows import LATENESS, keyed_state

MEAN, DELTA, RATE = "mean", "delta", "rate"
_POINT = np.dtype([("micros", "<i8"), ("place", "<i8"), ("value", "<f8")])
#: Points of a chunk of the state: 1.5 MB.
CHUNK = 1 << 16


def _points(part: pd.DataFrame) -> np.ndarray:
    out = np.empty(len(part), _POINT)
    for name in _POINT.names:
        out[name] = part[name].to_numpy()
    return out


class Aligned(StatefulProcessor):
    """Periods of a series in order, each once the watermark has passed it; with ``limit`` the alerts they make instead."""

    def __init__(self, keys: list[str], kind: str, seconds: int, limit: float | None, min_periods: int):
        self.keys, self.kind, self.seconds, self.limit, self.min_periods = keys, kind, seconds, limit, min_periods

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "points binary")
        self.last = handle.getValueState("last", "value double")
        self.run = handle.getValueState("run", "first long, last long, periods long, peak double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield from self._close(key, [_points(part) for part in rows], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._close(key, [], timerValues.getCurrentWatermarkInMs())

    def _close(self, key, fresh: list[np.ndarray], watermark: int) -> Iterator[pd.DataFrame]:
        waiting = [np.frombuffer(chunk, _POINT) for chunk, in self.waiting.get()]
        points = np.concatenate([np.empty(0, _POINT), *waiting, *fresh])
        # a point at the watermark itself would be late, so periods that end at it are whole
        whole = watermark // 1000 // self.seconds * self.seconds
        passed = points["micros"] < whole * 1_000_000
        ready, rest = points[passed], points[~passed]
        ready = ready[np.lexsort((ready["value"], ready["place"], ready["micros"]))]
        if len(ready) or fresh:
            if len(rest):
                self.waiting.put([(rest[i:i + CHUNK].tobytes(),) for i in range(0, len(rest), CHUNK)])
            else:
                self.waiting.clear()
        out = list(self._told(self._values(ready), whole))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        ends = [int(rest["micros"].min()) // 1_000_000 // self.seconds + 1] if len(rest) else []
        if self.limit is not None and self.run.exists():
            ends.append(self.run.get()[1] // self.seconds + 2)
        if ends:
            self.handle.registerTimer(min(ends) * self.seconds * 1000)
        if out:
            names = ["period", "value"] if self.limit is None else ["event", "first_period", "last_period", "periods", "peak"]
            yield pd.DataFrame(out, columns=names).assign(**dict(zip(self.keys, key)))[[*self.keys, *names]]

    def _values(self, points: np.ndarray) -> Iterator[tuple[int, float]]:
        last = self.last.get()[0] if len(points) and self.kind != MEAN and self.last.exists() else None
        periods, first = np.unique(points["micros"] // 1_000_000 // self.seconds * self.seconds, return_index=True)
        for period, begin, end in zip(periods.tolist(), first.tolist(), [*first[1:].tolist(), len(points)]):
            values = points["value"][begin:end].tolist()
            if self.kind == MEAN:
                yield period, sum(values) / len(values)
                continue
            grown = 0.0
            for x in values:
                grown += max(x - last, 0.0) if last is not None else 0.0
                last = x
            yield period, grown / self.seconds if self.kind == RATE else grown
        if len(points) and self.kind != MEAN:
            self.last.update((last,))

    def _told(self, values: Iterator[tuple[int, float]], whole: int) -> Iterator[tuple]:
        """The periods themselves; or ``open`` where a run of high periods is long enough, and ``close`` with all of it at its end."""
        if self.limit is None:
            yield from values
            return
        run = self.run.get() if self.run.exists() else None
        before = run

        def closed():
            return [("close", *run)] if run is not None and run[2] >= self.min_periods else []

        for period, value in values:
            if run is not None and (value <= self.limit or period != run[1] + self.seconds):
                yield from closed()
                run = None
            if value > self.limit:
                run = (period, period, 1, value) if run is None else (run[0], period, run[2] + 1, max(run[3], value))
                if run[2] == self.min_periods:
                    yield ("open", *run)
        if run is not None and run[1] + 2 * self.seconds <= whole:  # the period after it has passed
            yield from closed()
            run = None
        if run is None and before is not None:
            self.run.clear()
        elif run is not None and run != before:
            self.run.update(run)

    def close(self) -> None:
        pass


def _stream(points: DataFrame, series: list[str], place: str, kind: str, seconds: int, lateness: str, limit: float | None = None,
            min_periods: int = 1) -> DataFrame:
    keyed_state(points.sparkSession)
    fields = {f.name: f.dataType for f in points.schema.fields}
    told = "period long, value double" if limit is None else "event string, first_period long, last_period long, periods long, peak double"
    schema = T.StructType([T.StructField(c, fields[c]) for c in series] + T._parse_datatype_string(told).fields)
    rows = points.where("ts IS NOT NULL AND value IS NOT NULL").select(
        *series, "ts", F.unix_micros("ts").alias("micros"), F.col(place).cast("long").alias("place"), F.col("value").cast("double").alias("value"))
    keyed = rows.withWatermark("ts", lateness).groupBy(*series)
    return keyed.transformWithStateInPandas(Aligned(series, kind, seconds, limit, min_periods), schema, "append", "eventtime")


def stream_mean(points: DataFrame, series: list[str], place: str, seconds: int = MEAN_SECONDS, lateness: str = LATENESS) -> DataFrame:
    """Mean of each period. ``points`` has ``ts``, ``value``, the series' columns and ``place``, an integer that orders equal times."""
    return _stream(points, series, place, MEAN, seconds, lateness)


def stream_delta(points: DataFrame, series: list[str], place: str, seconds: int = DELTA_SECONDS, lateness: str = LATENESS) -> DataFrame:
    """Increase of a counter per period; a reset counts as none."""
    return _stream(points, series, place, DELTA, seconds, lateness)


def stream_rate(points: DataFrame, series: list[str], place: str, seconds: int = MEAN_SECONDS, lateness: str = LATENESS) -> DataFrame:
    """Increase of a counter per second."""
    return _stream(points, series, place, RATE, seconds, lateness)


def stream_alert(points: DataFrame, series: list[str], place: str, kind: str, threshold: float, seconds: int, min_periods: int = 1,
                 lateness: str = LATENESS) -> DataFrame:
    """``open`` and ``close`` events of stretches of at least ``min_periods`` adjacent periods above ``threshold``.

    An alert opens in its ``min_periods``-th period and closes with the whole stretch once the period after it has passed.
    """
    return _stream(points, series, place, kind, seconds, lateness, threshold, min_periods)
