"""Growing log files of a folder as a stream: whole lines by (file, byte), admitted by number or by waiting time.

A micro-batch starts once ``minRows`` lines wait, or ``maxDelaySeconds`` after the first of them came, and takes at most ``maxRows``,
file after file in order of name. Offsets are bytes, so a stopped stream goes on inside a file, and a file that grows is
read on. A line counts once its newline is there. The driver looks through no more bytes than a micro-batch holds; tasks read
them, one range of one file each.

Spark asks for the newest offset without saying where it is, so the reader keeps the end of the last planned micro-batch in a small file at
``progress``, which belongs to one checkpoint: it is written before the batch runs, and a batch that must run again is planned again from Spark's
own log.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .topics import BATCH_ROWS, BATCH_SECONDS, MAX_ROWS

SCHEMA = "file string, position long, value string"
CHUNK = 1 << 20


class Range(InputPartition):
    """Bytes of one file that begin and end with lines."""

    def __init__(self, file: str, start: int, end: int):
        super().__init__((file, start, end))
        self.file, self.start, self.end = file, start, end


def _file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:") and not path.startswith("file://") else path)


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.progress = options["path"], options["progress"]
        self.least, self.most = int(options.get("minRows", BATCH_ROWS)), int(options.get("maxRows", MAX_ROWS))
        self.delay = float(options.get("maxDelaySeconds", BATCH_SECONDS))
        self.at: dict[str, int] | None = None
        self.since: float | None = None

    def initialOffset(self) -> dict:
        return {}

    def _planned(self) -> dict[str, int]:
        fs, path = _file_system(self.progress)
        if fs.get_file_info(path).type == pa.fs.FileType.NotFound:
            return {}
        with fs.open_input_stream(path) as f:
            return json.loads(f.read())

    def _plan(self, end: dict[str, int]) -> None:
        self.at, self.since = dict(end), None
        fs, path = _file_system(self.progress)
        attempt = f"{path}.{uuid.uuid4().hex}"
        with fs.open_output_stream(attempt) as f:
            f.write(json.dumps(self.at).encode())
        fs.move(attempt, path)

    def latestOffset(self) -> dict:
        if self.at is None:
            self.at = self._planned()
        fs, folder = _file_system(self.folder)
        found = fs.get_file_info(pa.fs.FileSelector(folder))
        end, rows = dict(self.at), 0
        for info in sorted((i for i in found if i.is_file and not i.base_name.startswith(("_", "."))), key=lambda i: i.base_name):
            start = self.at.get(info.base_name, 0)
            if rows < self.most and info.size > start:
                lines, stop = self._lines(fs, info.path, start, info.size, self.most - rows)
                rows += lines
                if lines:
                    end[info.base_name] = stop
        if 0 < rows < self.least:
            self.since = self.since or time.monotonic()
            if time.monotonic() - self.since < self.delay:
                return dict(self.at)
        return end

    @staticmethod
    def _lines(fs: pa.fs.FileSystem, path: str, start: int, size: int, most: int) -> tuple[int, int]:
        """Whole lines from ``start`` on, at most so many, and where the last of them ends."""
        rows, end, at = 0, start, start
        with fs.open_input_file(path) as f:
            f.seek(start)
            while at < size and rows < most:
                chunk = f.read(min(CHUNK, size - at))
                if not chunk:
                    break
                place = -1
                while rows < most and (place := chunk.find(b"\n", place + 1)) >= 0:
                    rows, end = rows + 1, at + place + 1
                at += len(chunk)
        return rows, end

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self._plan(end)
        return [Range(name, start.get(name, 0), stop) for name, stop in sorted(end.items()) if stop > start.get(name, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        fs, folder = _file_system(self.folder)
        with fs.open_input_file(f"{folder}/{partition.file}") as f:
            f.seek(partition.start)
            at, rest = partition.start, b""
            while at < partition.end:
                chunk = f.read(min(CHUNK, partition.end - at))
                *lines, rest = (rest + chunk).split(b"\n")
                first = at + len(chunk) - len(rest) - sum(len(x) + 1 for x in lines)
                at += len(chunk)
                places, place = [], first
                for line in lines:
                    places.append(place)
                    place += len(line) + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([partition.file] * len(lines), pa.string()), pa.array(places, pa.int64()),
                     pa.array([x.decode("utf-8", "replace").removesuffix("\r") for x in lines], pa.string())], names=["file", "position", "value"])

    def commit(self, end: dict) -> None:
        pass


class LogTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def stream_log_folder(spark: SparkSession, folder: str, progress: str, min_rows: int = BATCH_ROWS, max_rows: int = MAX_ROWS,
                      max_delay_seconds: float = BATCH_SECONDS) -> DataFrame:
    """``file``, ``position`` (byte of the line's start) and ``value`` of the lines of a folder's files as they grow."""
    spark.dataSource.register(LogTail)
    options = {"path": folder, "progress": progress, "minRows": str(min_rows), "maxRows": str(max_rows), "maxDelaySeconds": str(max_delay_seconds)}
    return spark.readStream.format("log_tail").options(**options).load()
