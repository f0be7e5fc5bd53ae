"""What history has seen already: stored bitmaps of key hashes, so that only possible hits meet history itself.

A filter is a bit for each of ``2 ** bits`` hash values, cut into bitmaps of Spark's own bucket size; a row a bucket (and
day). Filters of days merge by OR. A clear bit proves that a key is new; the few keys with a set bit are looked up in history,
which is scanned with them broadcast and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialised

#: Bits of a filter: sixteen or more a key keep false hits below one in sixteen; a billion bits are 128 MB of rows.
BITS = 30
#: Possible hits up to this number are broadcast to history; beyond it both sides are shuffled.
BROADCAST_KEYS = 1_000_000


def _place(keys: list[str], bits: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(1 << bits))


def key_filters(rows: DataFrame, keys: list[str], *by: str, bits: int = BITS) -> DataFrame:
    """``bucket`` and ``bitmap`` of the keys' hashes, for each ``by``; bits combine before the shuffle."""
    at = _place(keys, bits)
    return rows.groupBy(*by, F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bitmap"))


def possible_hits(rows: DataFrame, keys: list[str], filters: DataFrame, bits: int = BITS) -> DataFrame:
    """Rows whose keys' bit is set in any of the filters."""
    at = _place(keys, bits)
    merged = filters.groupBy(F.col("bucket").alias("_bucket")).agg(F.bitmap_or_agg("bitmap").alias("_bitmap"))
    placed = rows.withColumns({"_at": F.bitmap_bucket_number(at), "_bit": F.bitmap_bit_position(at)})
    byte = F.conv(F.hex(F.substring("_bitmap", (F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1
    return placed.join(merged, F.col("_at") == F.col("_bucket")).where(hit).drop("_at", "_bit", "_bucket", "_bitmap")


def unseen(rows: DataFrame, history: DataFrame, filters: DataFrame, keys: list[str], bits: int = BITS) -> DataFrame:
    """Rows whose keys no row of ``history`` has; ``filters`` hold at least the keys of ``history``. Keys with a null are never seen.

    The possible hits are stored: they are counted, and then looked up. ``rows`` and ``history`` are read twice and once.
    """
    maybe = materialised(possible_hits(rows.select(*keys).distinct(), keys, filters, bits))
    few = maybe.count() <= BROADCAST_KEYS
    seen = history.select(*keys).join(F.broadcast(maybe) if few else maybe, keys, "left_semi").distinct()
    return rows.join(F.broadcast(seen) if few else seen, keys, "left_anti")  # no more keys seen than may be
