"""Sliding count windows over ordered rows of a key, safe for keys of any size.

A window needs the ``size - 1`` rows before it. Keys with few rows are shuffled
whole. A key with more than ``hot_rows`` rows is cut into blocks of about
``block_rows``: bounds are rows of a sample by hash, which merges like any
aggregate, and each row finds its block by comparing its order columns with them.
The last ``size - 1`` rows of a block, told by their rank, are stored once and
handed to the blocks that follow. The copies complete the first windows of a block
and are never reported themselves.

So the plan of a window query reads its input once and shuffles it once. What it
needs to know is found beforehand: a count by key, and only where a key is hot, its
sample and the rows handed over.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, WindowSpec, functions as F, types as T

from ..session import materialised

SEQ_LEN = 10  # fixed value: rows per window
HOT_ROWS = 2_000_000
BLOCK_ROWS = 1_000_000
KEYS = ["source", "host"]
#: Rows of the sample for one bound, and the most bounds that are broadcast: blocks grow where there would be more.
SAMPLED, MOST_BOUNDS = 16, 200_000
#: Hot keys up to this number are broadcast to find their sample.
LISTED_KEYS = 100_000


def _same_keys(keys: list[str]) -> Column:
    """Keys equal those of the hot list, a missing part being equal to a missing part."""
    out = F.lit(True)
    for i, k in enumerate(keys):
        out = out & F.col(k).eqNullSafe(F.col(f"_h{i}"))
    return out


def key_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)]).agg(F.count("*").alias("_rows"))


def _with_tie(df: DataFrame) -> DataFrame:
    """Adds a hash of the row: rows of equal order follow it, so only rows equal in every column can change places."""
    hashed = [F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return df.withColumn("_tie", F.xxhash64(*hashed))


def block_bounds(df: DataFrame, keys: list[str], order: list[str], hot_rows: int, block_rows: int) -> DataFrame | None:
    """For each hot key the last rows (their order columns) of its blocks but the last one, sorted; None where no key is hot.

    A block holds the row that bounds it, so only a key's last block can be empty.
    """
    hot = key_counts(df, keys).where(F.col("_rows") > hot_rows)
    told = hot.agg(F.count("*").alias("keys"), F.sum("_rows").alias("rows")).first()
    if not told["keys"]:
        return None
    block_rows = max(block_rows, told["rows"] // MOST_BOUNDS)
    per_bound = min(SAMPLED, block_rows)
    sample = df.select(*keys, F.struct(*order).alias("_at")).where(F.pmod(F.xxhash64(*keys, *order), F.lit(block_rows // per_bound)) == 0)
    listed = hot.drop("_rows")
    sample = sample.join(F.broadcast(listed) if told["keys"] <= LISTED_KEYS else listed, _same_keys(keys), "left_semi")
    bounds = sample.groupBy(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)]).agg(F.sort_array(F.collect_list("_at")).alias("_bounds"))
    bounds = bounds.withColumn("_bounds", F.array_distinct(F.filter("_bounds", lambda _, i: (i + 1) % per_bound == 0)))
    bounds = bounds.withColumn("_width", F.ceil(F.sqrt(F.size("_bounds"))).cast("int")).where("_width > 0")
    # the last bound of each group of so many, to be looked through first
    ends = F.filter("_bounds", lambda _, i: (i + 1) % F.col("_width") == 0)
    return materialised(bounds.withColumn("_ends", ends))


def _block_of(order: list[str]) -> Column:
    """How many bounds stand before a row: first among the groups' ends, then in one group."""
    at = F.struct(*order)
    groups = F.size(F.filter("_ends", lambda b: b < at))
    within = F.size(F.filter(F.slice("_bounds", groups * F.col("_width") + 1, F.col("_width")), lambda b: b < at))
    return groups * F.col("_width") + within


def blocked(df: DataFrame, keys: list[str], order: list[str], size: int = SEQ_LEN,
            hot_rows: int | None = HOT_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``_block``, ``_halo`` and ``_tie``: each (keys, _block) group has what its windows need.

    Every block but a key's last holds a row, so the ``size - 1`` blocks before one hold the rows it may miss.
    ``hot_rows=None`` keeps keys whole.
    """
    df = _with_tie(df)
    bounds = None if hot_rows is None else block_bounds(df, keys, order, hot_rows, block_rows)
    if bounds is None:
        return df.withColumns({"_block": F.lit(0), "_halo": F.lit(False)})
    here = F.when(F.col("_bounds").isNull(), F.lit(0)).otherwise(_block_of(order))
    told = [c for c in bounds.columns]
    placed = df.join(F.broadcast(bounds), _same_keys(keys), "left").withColumns({"_block": here, "_halo": F.lit(False)})
    carry = size - 1
    last = W.partitionBy(*keys, "_block").orderBy(*[F.col(c).desc_nulls_last() for c in [*order, "_tie"]])
    until = F.least(F.col("_block") + carry, F.size("_bounds"))
    copies = (
        df.join(F.broadcast(bounds), _same_keys(keys)).withColumns({"_block": _block_of(order), "_halo": F.lit(True)})
        .where(F.col("_block") < F.size("_bounds"))
        .withColumn("_rank", F.row_number().over(last)).where(F.col("_rank") <= carry).drop("_rank")
        .withColumn("_block", F.explode(F.sequence(F.col("_block") + 1, until)))
    )
    return placed.drop(*told).unionByName(materialised(copies.drop(*told)))


def count_windows(df: DataFrame, columns: Callable[[WindowSpec], dict[str, Column]], order: list[str],
                  keys: list[str] = KEYS, size: int = SEQ_LEN, full: bool = True,
                  hot_rows: int | None = HOT_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``columns(frame)`` over the last ``size`` rows; ``full`` drops shorter windows.

    Hand in only the columns needed later: equal orders are told apart by a hash of all of them.
    """
    split = blocked(df, keys, order, size, hot_rows, block_rows)
    run = W.partitionBy(*keys, "_block").orderBy(*order, "_tie")
    made = split.withColumns({**columns(run.rowsBetween(-(size - 1), 0)), "_place": F.row_number().over(run)})
    made = made.where(~F.col("_halo") & (F.col("_place") >= (size if full else 1)))
    return made.drop("_block", "_halo", "_place", "_tie")


def _needed(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*dict.fromkeys(names))


def sliding_windows(enriched: DataFrame, order: list[str], record: list[str] | None = None, row_id: str | None = None,
                    keep: list[str] = (), keys: list[str] = KEYS, **params) -> DataFrame:
    """One row per full window: keys, order and ``keep`` columns of its last row, and its label.

    ``row_id`` adds the ids of its first and last row, ``record`` its rows as an
    array of those columns, oldest first.
    """

    def columns(frame: WindowSpec) -> dict[str, Column]:
        out = {"label": F.max("is_anomaly_candidate").over(frame)}
        if row_id:
            out["first_id"] = F.first(row_id).over(frame)
            out["last_id"] = F.last(row_id).over(frame)
        if record:
            out["sequence"] = F.collect_list(F.struct(*record)).over(frame)
        return out

    names = [*keys, *order, "is_anomaly_candidate", *keep, *(record or []), *([row_id] if row_id else [])]
    made = count_windows(_needed(enriched, *names), columns, order, keys, **params)
    extra = [c for c in ("label", "first_id", "last_id", "sequence") if c in made.columns]
    return _needed(made, *keys, *order, *keep, *extra)


def window_labels(enriched: DataFrame, order: list[str], keep: list[str] = (), **params) -> DataFrame:
    """Label per window without building the windows."""
    return sliding_windows(enriched, order, keep=keep, **params)


def window_counts(labelled: DataFrame) -> DataFrame:
    return labelled.agg(
        F.count("*").alias("windows"),
        F.count_if(~F.col("label")).alias("normal"),
        F.count_if(F.col("label")).alias("anomalous"),
    )


def active_keys(enriched: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Number of keys that hold a buffer; a missing key part counts as a value."""
    return enriched.select(*keys).distinct().agg(F.count("*").alias("active_keys"))


def full_windows(batches: Iterator[pa.RecordBatch], keys: list[str], width: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Walks a sorted partition batch by batch, carrying ``width - 1`` rows over.

    Yields ``(rows, ends)``: rows start with the carried ones; ``ends`` are the
    places where a full window of one (keys, _block) run ends that is to be
    reported. Memory holds one Arrow batch, never a group.
    """
    carried = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        rows = pa.Table.from_batches([batch])
        old = 0
        if carried is not None:
            old = carried.num_rows
            rows = pa.concat_tables([carried, rows])
        rows = rows.combine_chunks()
        ids = rows.select([*keys, "_block"]).to_pandas()
        prior = ids.shift()
        new_run = (ids.ne(prior) & ~(ids.isna() & prior.isna())).any(axis=1).to_numpy()
        new_run[0] = True
        place = np.arange(len(ids))
        start = np.maximum.accumulate(np.where(new_run, place, 0))
        ok = (place - start + 1 >= width) & ~rows.column("_halo").to_numpy(zero_copy_only=False).astype(bool)
        ok[:old] = False
        yield rows, np.flatnonzero(ok)
        carried = rows.slice(max(0, rows.num_rows - (width - 1))).combine_chunks()


def sorted_blocks(df: DataFrame, order: list[str], keys: list[str] = KEYS, size: int = SEQ_LEN,
                  hot_rows: int | None = HOT_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows shuffled once by (keys, _block) and sorted, ready for ``full_windows``; adaptive execution sizes the partitions."""
    by = [*keys, "_block"]
    return blocked(df, keys, order, size, hot_rows, block_rows).repartition(*by).sortWithinPartitions(*by, *order, "_tie")
