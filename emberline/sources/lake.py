"""Reading the partitioned Parquet lake.

Batches lie in folders of their own below each day. A compaction writes its files below ``_compacted``, which no listing of the
lake shows, and takes effect by one small file in ``_commits``: it names the compaction and the files that its rows
came from. A reader looks at the commits first, then passes over the files they name and reads the compactions they name, so it
sees a compaction whole or not at all, whatever lands or stops in between.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import times
from ..schemas import ENRICHED_SCHEMA
from .files import list_paths, path_exists, read_text


POSITION = ["file", "row_index"]
COMMITS, COMPACTED = "_commits", "_compacted"


@dataclass(frozen=True)
class Commit:
    """One compaction that took effect. ``removed`` is empty once its files are deleted."""

    number: int
    compaction: str
    removed: list[str]


def commits(spark: SparkSession, root: str) -> list[Commit]:
    """Commits in order: one small file each, read by the driver."""
    paths = list_paths(spark, f"{root}/{COMMITS}/*")
    swept = {p.rsplit("/", 1)[1].split(".")[0] for p in paths if p.endswith(".swept")}
    out = []
    for path in paths:
        name = path.rsplit("/", 1)[1]
        if name.endswith(".json"):
            told = json.loads(read_text(spark, path))
            out.append(Commit(int(name.split(".")[0]), told["compaction"], [] if name.split(".")[0] in swept else told["removed"]))
    return out


def file_key() -> Column:
    """A data file's folders and name below the lake or its compactions, as Spark spells them in addresses."""
    return F.substring_index(F.col("_metadata.file_path"), "/", -6)


def live_files(spark: SparkSession, root: str, *extra: Column) -> DataFrame:
    """All rows that count, in the lake's schema, with ``extra`` columns over each file's metadata."""
    log = commits(spark, root)
    removed = [f for c in log for f in c.removed]
    parts = [spark.read.schema(ENRICHED_SCHEMA).parquet(root)]
    if log and path_exists(spark, f"{root}/{COMPACTED}"):
        stored = T.StructType([*ENRICHED_SCHEMA.fields, T.StructField("compaction", T.StringType())])
        parts.append(spark.read.schema(stored).parquet(f"{root}/{COMPACTED}").where(F.col("compaction").isin([c.compaction for c in log])))
    shown = []
    for part in parts:
        if removed:  # a condition on the file alone, so files are passed over before any is opened
            part = part.where(~file_key().isin(removed))
        shown.append(part.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in ENRICHED_SCHEMA.fields], *extra))
    return shown[0] if len(shown) == 1 else shown[0].unionByName(shown[1])


def scan_lake(spark: SparkSession, root: str, positions: bool = False) -> DataFrame:
    """The whole lake in its fixed schema; filters on partition columns prune folders.

    Month and day folders are zero-padded text; the declared integer types read them.
    ``positions`` adds the file and row number of each row: a tie-break that is
    unique and the same on every read until a compaction moves the row.
    """
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row_index")] if positions else []
    return live_files(spark, root, *place)


def with_event_time(stored: DataFrame) -> DataFrame:
    """Adds ``event_time``, read back from the rendered ``timestamp``."""
    return stored.withColumn("event_time", times.parse_iso(F.col("timestamp"), accept_offset=True))
