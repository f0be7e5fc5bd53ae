"""Dealing documents to shards by ranges of their id, and each document's successor in that order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import bounded, with_columns

#: Stands for a null id, which comes before all others.
NULL_ID = -(1 << 63)


def bounds_of(docs: DataFrame, doc_id: str, shard_documents: int) -> np.ndarray:
    """Ids at which the shards after the first begin, each the id of a document: one integer a shard for the driver."""
    n = docs.count()
    shards = -(-n // shard_documents)
    if shards < 2:
        return np.zeros(0, dtype=np.int64)
    cuts = [i / shards for i in range(1, shards)]
    found = docs.select(F.percentile_approx(doc_id, cuts, max(10_000, 20 * shards)).alias("b")).first()["b"]
    return np.array(sorted(set(found or [])), dtype=np.int64)


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", next_text: str = "next_text",
              shard_documents: int = 8_192) -> DataFrame:
    """Rows (id, text, text of the next document by id; after the last, the first); null texts become empty.

    One shuffle. The document that begins a shard also goes to the shard before it, so that shard's last document finds
    its successor there; equal ids are ordered by their texts.
    """
    spark = bounded(docs.sparkSession)
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    place = F.coalesce("id", F.lit(NULL_ID))
    first = docs.agg(F.min(place)).first()[0]
    shared = spark.sparkContext.broadcast((bounds_of(docs, "id", shard_documents), first))

    def deal():
        bounds, first = shared.value

        def run(ids: pa.Array):
            ids = ids.to_numpy(zero_copy_only=False)
            own = np.searchsorted(bounds, ids, "right")
            begins = (own > 0) & (bounds[own - 1] == ids) if len(bounds) else np.zeros(len(ids), dtype=bool)
            rows = [[2 * s] for s in own.tolist()]  # even: at home; odd: only as the successor of the shard's last
            for i in np.flatnonzero(begins):
                rows[i].append(2 * (int(own[i]) - 1) + 1)
            for i in np.flatnonzero(ids == first):
                rows[i].append(2 * len(bounds) + 1)
            return (pa.array(rows, pa.list_(pa.int32())),)

        return run

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            if table.num_rows > 1:
                place = table["place"].to_numpy()
                keep = (place[:-1] % 2 == 0) & (place[:-1] // 2 == place[1:] // 2)
                pairs = pa.table([table["id"].slice(0, len(keep)), table["text"].slice(0, len(keep)), table["text"].slice(1)],
                                 names=[doc_id, text, next_text]).filter(pa.array(keep))
                yield from pairs.to_batches()
            if table.num_rows:
                held = table.slice(table.num_rows - 1).combine_chunks().to_batches()[0]

    dealt = with_columns(docs, [place], [T.StructField("places", T.ArrayType(T.IntegerType()))], deal)
    dealt = dealt.select("id", "text", F.explode("places").alias("place"))
    shards = len(shared.value[0]) + 1
    ordered = dealt.repartition(shards, F.floor(F.col("place") / 2)).sortWithinPartitions(
        F.floor(F.col("place") / 2), "place", F.col("id").asc_nulls_first(), "text")
    return ordered.mapInArrow(pair, f"`{doc_id}` long, `{text}` string, `{next_text}` string")
