"""Running totals and ranks whose work is split inside a key.

``position`` is a unique integer (offset, line number, batch number). Rows are
cut into chunks of consecutive positions, so one chunk never holds more than
``chunk`` rows however many rows its key has. Totals per chunk are summed up on
their own (one row per chunk) and added to the totals inside each chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

CHUNK_ROWS = 1_000_000


def running_sums(df: DataFrame, position: str, values: dict[str, Column], keys: list[str] = (),
                 chunk: int = CHUNK_ROWS) -> DataFrame:
    """Adds one inclusive running sum per entry of ``values``, in order of ``position``."""
    # One struct as key: it treats missing parts as equal, so window and join share one shuffle.
    group = F.struct(*[F.col(k) for k in keys], (F.col(position) - F.pmod(F.col(position), F.lit(chunk))).alias("_chunk"))
    chunked = df.withColumn("_group", group)
    totals = chunked.groupBy("_group").agg(*[F.sum(v).alias(f"_t_{n}") for n, v in values.items()])
    before = W.partitionBy(*[f"_group.{k}" for k in keys]).orderBy("_group._chunk").rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select(
        F.col("_group").alias("_base"), *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in values])
    inside = W.partitionBy("_group").orderBy(position).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = chunked.withColumns({f"_l_{n}": F.sum(v).over(inside) for n, v in values.items()})
    joined = local.join(bases, F.col("_group") == F.col("_base"))
    return joined.select(*df.columns, *[(F.col(f"_l_{n}") + F.col(f"_b_{n}")).alias(n) for n in values])


def row_ranks(df: DataFrame, position: str, keys: list[str] = (), name: str = "rank",
              chunk: int = CHUNK_ROWS) -> DataFrame:
    """Adds the 1-based rank of each row within its key, in order of ``position``."""
    return running_sums(df, position, {name: F.lit(1).cast("bigint")}, keys, chunk)
