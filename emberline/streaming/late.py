"""Rows that a stream's watermark left out, found again from the query's own checkpoint.

A stateful stream drops rows that are older than the watermark of the batch before, and only counts them. The checkpoint says
which files a batch read and what the watermark was, so the same rows can be read once more and told apart: kept and late
rows together are what was received. Spark keeps the last hundred batches of its log (``spark.sql.streaming.minBatchesToRetain``),
so a side table is brought up to date within that time; ``append_late`` takes each batch once.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.files import list_paths, path_exists, read_text, write_text

_MARKS = "file string, batch_id long, watermark_ms long"


def batch_watermarks(spark: SparkSession, checkpoint: str) -> list[tuple[int, int, int]]:
    """(batch, last entry of the file log it read, watermark its rows were held against), one a retained and finished batch."""
    read, marks = {}, {}
    for path in list_paths(spark, f"{checkpoint}/offsets/*"):
        name = path.rsplit("/", 1)[1]
        if name.isdigit():
            _, told, *sources = read_text(spark, path).splitlines()
            marks[int(name)] = json.loads(told)["batchWatermarkMs"]
            read[int(name)] = json.loads(sources[0])["logOffset"]
    done = {int(p.rsplit("/", 1)[1]) for p in list_paths(spark, f"{checkpoint}/commits/*") if p.rsplit("/", 1)[1].isdigit()}
    # rows are held against the watermark of the batch before; the first retained batch has none to go by unless it is the very first
    return [(b, read[b], marks.get(b - 1, 0)) for b in sorted(read) if b in done and (b == 0 or b - 1 in marks)]


def file_marks(spark: SparkSession, checkpoint: str, after_batch: int = -1) -> DataFrame:
    """Files of a folder source with the batch that read them and that batch's watermark: a row a file."""
    known = batch_watermarks(spark, checkpoint)
    ends = {b: end for b, end, _ in known}
    ranges = [(b, ends.get(b - 1, -1 if b == 0 else end - 1), end, mark) for b, end, mark in known if b > after_batch]
    if not ranges:
        return spark.createDataFrame([], _MARKS)
    spans = spark.createDataFrame(ranges, "batch_id long, _after long, _until long, watermark_ms long")
    log = spark.read.schema("path string, batchId long").json(f"{checkpoint}/sources/0/*").where("path IS NOT NULL").distinct()
    within = (F.col("batchId") > F.col("_after")) & (F.col("batchId") <= F.col("_until"))
    # the log writes local files with three slashes, a file's metadata with one
    return log.join(F.broadcast(spans), within).select(F.regexp_replace("path", "^file:/+", "file:/").alias("file"), "batch_id", "watermark_ms")


def late_rows(rows: DataFrame, event_time: str, marks: DataFrame) -> DataFrame:
    """Of ``rows`` (with the ``file`` they came from) those at or below their batch's watermark, with its ``batch_id``.

    Rows without a time are never late.
    """
    micros = F.unix_micros(F.col(event_time))
    return rows.join(marks, "file").where(micros <= F.col("watermark_ms") * 1000).drop("watermark_ms")


def append_late(spark: SparkSession, checkpoint: str, read: Callable[[list[str]], DataFrame], event_time: str, table: str) -> int:
    """Adds late rows of the batches finished since the last call; how many batches those were.

    ``read`` gives the rows of files as the stream sees them, with ``file``. A batch's rows lie in a folder of their own
    and are written over when a call that stopped halfway is repeated; a batch without late rows leaves a mark all the same.
    """
    done = int(read_text(spark, f"{table}/_done")) if path_exists(spark, f"{table}/_done") else -1
    batches = [b for b, _, _ in batch_watermarks(spark, checkpoint) if b > done]
    if not batches:
        return 0
    marks = file_marks(spark, checkpoint, done)
    files = [r["file"] for r in marks.select("file").collect()]  # names of the files of a few batches
    if files:
        found = late_rows(read(files), event_time, F.broadcast(marks)).drop("file")
        (found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(table))
    write_text(spark, f"{table}/_done", str(batches[-1]))
    return len(batches)
