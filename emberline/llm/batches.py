"""Adding columns to a DataFrame from Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Arrow batches end at this size; one text longer than that is a batch of its own.
BATCH_BYTES = 3 << 20


def bounded(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches by bytes, as texts differ in length by orders of magnitude."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def with_columns(df: DataFrame, needs: Sequence[str | Column], adds: Sequence[T.StructField],
                 f: Callable[[], Callable[..., Sequence[pa.Array]]], drop: Sequence[str] = ()) -> DataFrame:
    """``df`` with the columns ``adds``; input columns of the same names (in any case) are replaced, ``drop`` leave.

    ``f()`` runs once a task and returns the function that maps the columns ``needs`` of a batch to the new columns.
    """
    bounded(df.sparkSession)
    gone = {a.name.lower() for a in adds} | {d.lower() for d in drop}
    inputs = [F.col(f"`{c}`") if isinstance(c, str) else c for c in needs]
    kept = [c for c in df.columns if c.lower() not in gone]
    n = len(inputs)
    source = df.select(*[c.alias(f"__need_{i}") for i, c in enumerate(inputs)], *[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([*source.schema.fields[n:], *[T.StructField(a.name, a.dataType, True) for a in adds]])
    kinds = [to_arrow_type(a.dataType) for a in adds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = f()
        for batch in batches:
            made = [pa.array([], k) for k in kinds] if batch.num_rows == 0 else g(*batch.columns[:n])
            yield pa.RecordBatch.from_arrays([*batch.columns[n:], *[a.cast(k) for a, k in zip(made, kinds)]],
                                             names=schema.names)

    return source.mapInArrow(run, schema)
