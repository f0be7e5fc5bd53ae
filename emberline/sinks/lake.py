"""Writing the partitioned Parquet lake."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce
from operator import and_
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schemas import ENRICHED_FIELDS, LAKE_PARTITIONS
from ..sources.files import delete_path, folder_files, list_folders, write_new
from ..sources.lake import COMMITS, COMPACTED, commits, file_key, live_files

BATCH = "batch_id"


def lake_layout(enriched: DataFrame) -> DataFrame:
    """Lake columns with month and day as two-digit text, as the folders spell them."""
    return enriched.select(*ENRICHED_FIELDS).withColumns({
        "month": F.lpad(F.col("month").cast("string"), 2, "0"),
        "day": F.lpad(F.col("day").cast("string"), 2, "0"),
    })


def write_lake(enriched: DataFrame, root: str, batch_id: int | str | None = None, max_rows_per_file: int = 5_000_000) -> None:
    """Adds to the folders of (source, year, month, day, batch).

    Streams and batch loads write the same folders, so one read serves both. A
    batch of the same name is overwritten, which makes a replay harmless; a load
    without a name gets one of its own. Days of a named batch that a compaction
    has taken in stand written: a replay leaves them out.
    """
    name = f"stream-{batch_id}" if isinstance(batch_id, int) else batch_id or f"load-{uuid.uuid4().hex}"
    rows = lake_layout(enriched)
    if batch_id is not None:
        rows = _without_compacted(rows, root, name)
    _write_folders(rows.withColumn(BATCH, F.lit(name)), root, [*LAKE_PARTITIONS, BATCH], max_rows_per_file)


def _without_compacted(rows: DataFrame, root: str, batch: str) -> DataFrame:
    """Rows of days whose files of this batch no compaction has read; a batch has few days."""
    days = set()
    for commit in commits(rows.sparkSession, root):
        for file in commit.removed:
            values = [_folder_value(part) for part in file.split("/")[:-1]]
            if file.split("/")[-2].startswith(f"{BATCH}=") and values[-1] == batch:
                days.add(tuple(values[:-1]))
    if not days:
        return rows
    taken = rows.sparkSession.createDataFrame(sorted(days, key=str), ", ".join(f"_{c} string" for c in LAKE_PARTITIONS))
    same = reduce(and_, [F.col(c).cast("string").eqNullSafe(F.col(f"_{c}")) for c in LAKE_PARTITIONS])
    return rows.join(F.broadcast(taken), same, "left_anti")


def _folder_value(part: str) -> str | None:
    """A partition's value: Spark escapes it in the folder's name, and once more in addresses."""
    value = unquote(unquote(part.split("=", 1)[1]))
    return None if value == "__HIVE_DEFAULT_PARTITION__" else value


def _write_folders(rows: DataFrame, root: str, folders: list[str], max_rows_per_file: int) -> None:
    """``rebalance`` gathers small partitions into one file each, while adaptive execution splits those that hold too much."""
    (
        rows.hint("rebalance", *folders).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").option("compression", "snappy")
        .option("maxRecordsPerFile", max_rows_per_file).partitionBy(*folders).parquet(root)
    )


@dataclass(frozen=True)
class Prepared:
    """A compaction's files, written but not yet seen by readers, and exactly the files its rows came from."""

    compaction: str
    removed: list[str]


def prepare_compaction(spark: SparkSession, root: str, before: str, max_rows_per_file: int = 5_000_000) -> Prepared | None:
    """First phase: days before ``before`` (a date) that lie in several files are written anew beside the lake.

    Files and rows come from one listing, so a batch that lands meanwhile is neither read nor named. None where no day
    has several files.
    """
    day = F.make_date("year", "month", "day")
    rows = live_files(spark, root, file_key().alias("_file")).where(day < F.lit(before).cast("date"))
    files = rows.select(*LAKE_PARTITIONS, "_file").distinct()
    several = files.groupBy(*LAKE_PARTITIONS).agg(F.collect_list("_file").alias("_files")).where(F.size("_files") > 1)
    removed = sorted(f for r in several.select("_files").collect() for f in r["_files"])  # names of files, as every listing holds
    if not removed:
        return None
    made = Prepared(uuid.uuid4().hex, removed)
    _write_folders(lake_layout(rows.where(F.col("_file").isin(removed))), _compaction_folder(root, made.compaction), LAKE_PARTITIONS,
                   max_rows_per_file)
    return made


def commit_compaction(spark: SparkSession, root: str, made: Prepared) -> bool:
    """Second phase: one new file makes the compaction count and the files it read pass out of sight, both at once.

    False, and the compaction's files are deleted, where one of the files it read is gone: replayed, or taken by another
    compaction. Commits are numbered and a number is given once, so of two compactions the later one looks again.
    """
    while True:
        log = commits(spark, root)
        taken = {f for c in log for f in c.removed}
        if not taken.isdisjoint(made.removed) or not _all_there(spark, root, made.removed):
            delete_path(spark, _compaction_folder(root, made.compaction))
            return False
        number = 1 + max((c.number for c in log), default=0)
        told = json.dumps({"compaction": made.compaction, "removed": made.removed})
        if write_new(spark, f"{root}/{COMMITS}/{number:020d}.json", told):
            return True


def compact(spark: SparkSession, root: str, before: str, max_rows_per_file: int = 5_000_000) -> bool:
    """Rewrites the many small files of each (source, day) before ``before``, beside running writers and readers.

    A call that stops halfway leaves the lake as it was; ``sweep`` takes away what it wrote. Rows that arrive late for a
    compacted day are files of their own until the next call. Returns whether a compaction took effect.
    """
    made = prepare_compaction(spark, root, before, max_rows_per_file)
    return made is not None and commit_compaction(spark, root, made)


def sweep(spark: SparkSession, root: str, keep: int = 1) -> None:
    """Deletes the files that compactions replaced, but for the last ``keep`` commits, and compactions that never took effect.

    For times without a running compaction, and when readers that began before those commits have ended. After it, a
    replay of a batch that those commits took in would be written again.
    """
    log = commits(spark, root)
    for commit in log[:len(log) - keep] if keep else log:
        for file in commit.removed:
            delete_path(spark, _place(root, file))
        write_new(spark, f"{root}/{COMMITS}/{commit.number:020d}.swept", "")
    counted = {f"compaction={c.compaction}" for c in log}
    for folder in list_folders(spark, f"{root}/{COMPACTED}/compaction=*"):
        if folder.rsplit("/", 1)[1] not in counted:
            delete_path(spark, folder)


def _compaction_folder(root: str, compaction: str) -> str:
    return f"{root}/{COMPACTED}/compaction={compaction}"


def _place(root: str, file: str) -> str:
    return f"{root}/{COMPACTED}/{unquote(file)}" if file.startswith("compaction=") else f"{root}/{unquote(file)}"


def _all_there(spark: SparkSession, root: str, files: list[str]) -> bool:
    folders = {_place(root, f).rsplit("/", 1)[0] for f in files}
    names = {(folder, p.rsplit("/", 1)[1]) for folder in folders for p in folder_files(spark, folder)}
    return all(tuple(_place(root, f).rsplit("/", 1)) in names for f in files)


def partition_tuples(enriched: DataFrame) -> DataFrame:
    """Rows per lake folder: the files a batch writes."""
    return lake_layout(enriched).groupBy(*LAKE_PARTITIONS).agg(F.count("*").alias("n"))


def aged_partitions(enriched: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Lake folders whose day is more than ``days`` before ``as_of``."""
    day = F.make_date("year", "month", "day")
    return (
        enriched.groupBy(*LAKE_PARTITIONS).agg(F.count("*").alias("n"))
        .withColumn("age_days", F.datediff(F.lit(as_of).cast("date"), day))
        .where(F.col("age_days") > days)
    )
