"""Fair interleaving of sources, and resuming inside the interleaved order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .prefix import CHUNK_ROWS, row_ranks


def union_sources(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def round_robin(df: DataFrame, order: list[str], position: str, source: str = "source",
                chunk: int = CHUNK_ROWS) -> DataFrame:
    """Adds ``turn`` (rank in the source) and ``slot`` (0-based place in the interleaved order).

    One row of each source in turn, in the sequence of ``order``, passing over
    sources that ran out; sources that ``order`` does not name follow by name, a
    missing one as the empty name. The place follows from the rank and the row counts
    of the sources, so no global sort is needed: earlier turns took
    ``min(count, turn - 1)`` rows of every source, and this turn took one row of
    each earlier source that still had some. The counts, one per source, are what
    every row looks at.
    """
    name = F.coalesce(F.col(source), F.lit(""))
    listed = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("_s")) if order else F.lit(0)
    ranked = row_ranks(df, position, [source], "turn", chunk)
    counts = (
        df.groupBy(name.alias("_s")).agg(F.count("*").alias("n"))
        .agg(F.array_sort(F.collect_list(F.struct(
            F.when(listed > 0, listed).otherwise(len(order) + 1).alias("place"), F.col("_s").alias("name"), "n"))).alias("_sizes"))
    )
    earlier = F.aggregate(
        "_sizes", F.lit(0).cast("bigint"), lambda acc, s: acc + F.least(s["n"], F.col("turn") - 1)
    )
    same_turn = F.size(F.filter("_sizes", lambda s, i: (i < F.col("_place") - 1) & (s["n"] >= F.col("turn"))))
    return (
        ranked.withColumn("_sizes", counts.scalar())
        .withColumn("_place", F.array_position(F.transform("_sizes", lambda s: s["name"]), name))
        .withColumn("slot", earlier + same_turn).drop("_place", "_sizes")
    )


def resume(mixed: DataFrame, offset: int, limit: int | None = None, slot: str = "slot") -> DataFrame:
    """Rows from ``offset`` on (at most ``limit``): a filter on the place, no sort."""
    out = mixed.where(F.col(slot) >= offset)
    return out if limit is None else out.where(F.col(slot) < offset + limit)
