"""Exact percentile with linear interpolation, by counting instead of sorting.

A double splits exactly into sign, exponent and mantissa. Three passes count
rows by sign, exponent and 12 mantissa bits, by the next 20 bits, then by the last 20,
each pass looking only at the range that holds the wanted rank. A pass yields at
most about 16 million groups over the full range of doubles (a few thousand
for values of like size), whatever the number of rows; the first pass ranks its
groups in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

_BITS = (12, 20, 20)
_LEAST = 1080  # above the size of the least exponent of a double


def _digits(x: Column) -> list[Column]:
    """Order-preserving digits of a double: sign, exponent and leading bits, then the rest."""
    size = F.abs(x)
    guess = F.floor(F.log2(size))
    two = F.lit(2.0)
    exponent = (
        F.when(F.pow(two, guess) > size, guess - 1).when(F.pow(two, guess + 1) <= size, guess + 1).otherwise(guess)
    )
    rest = (size / F.pow(two, exponent) - 1) * F.lit(float(1 << _BITS[0]))
    out = [(exponent + _LEAST) * F.lit(1 << _BITS[0]) + F.floor(rest)]  # positive for every size
    for bits in _BITS[1:]:
        rest = (rest - F.floor(rest)) * F.lit(float(1 << bits))
        out.append(F.floor(rest))
    zero = F.lit(0).cast("bigint")
    return [F.when(x > 0, d).when(x < 0, -d).otherwise(zero) for d in out]


def exact_percentile(df: DataFrame, column: str, percentile: float, name: str = "threshold") -> DataFrame:
    """One row: ``name`` and ``n_samples``. Nulls are ignored; NaN and infinite values stop the job with a clear error."""
    value = F.col(column).cast("double")
    odd = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    refused = F.raise_error(F.concat(F.lit(f"exact_percentile: column {column} holds "), value.cast("string")))
    values = df.select(F.when(odd, refused.cast("double")).otherwise(value).alias("v")).where(F.col("v").isNotNull())
    first, second, third = _digits(F.col("v"))
    digits = values.select("v", first.alias("d0"), second.alias("d1"), third.alias("d2"))

    # First pass: one count per leading digit gives the number of rows and the cumulative counts.
    leading = digits.groupBy("d0").agg(F.count("*").alias("_c"), F.min("v").alias("v"))
    whole = W.orderBy("d0")
    placed = leading.withColumn("_upto", F.sum("_c").over(whole)).withColumn(
        "n", F.sum("_c").over(whole.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    rank = F.lit(percentile / 100.0) * (F.col("n") - 1)
    # One target per neighbouring rank; "left" counts ranks inside the range found so far.
    sides = F.array(
        F.struct(F.lit(0).alias("side"), F.floor(rank).alias("left")),
        F.struct(F.lit(1).alias("side"), F.least(F.floor(rank) + 1, F.col("n") - 1).alias("left")),
    )
    targets = _hit(placed.select("*", (rank - F.floor(rank)).alias("part"), F.inline(sides)))

    for level in range(1, len(_BITS)):
        fixed = [f"d{i}" for i in range(level)]
        joined = digits.join(F.broadcast(targets.drop("v")), fixed)
        counted = joined.groupBy("side", "n", "part", "left", *fixed, f"d{level}").agg(
            F.count("*").alias("_c"), F.min("v").alias("v"))
        upto = F.sum("_c").over(W.partitionBy("side").orderBy(f"d{level}"))
        targets = _hit(counted.withColumn("_upto", upto))
    low = F.max(F.when(F.col("side") == 0, F.col("v")))
    high = F.max(F.when(F.col("side") == 1, F.col("v")))
    return targets.agg((low + (high - low) * F.max("part")).alias(name), F.max("n").alias("n_samples"))


def _hit(cumulated: DataFrame) -> DataFrame:
    """The one group per side that holds the wanted rank, with the rank left inside it."""
    below = F.col("_upto") - F.col("_c")
    return (
        cumulated.where((F.col("_upto") > F.col("left")) & (below <= F.col("left")))
        .withColumn("left", F.col("left") - below).drop("_c", "_upto")
    )
