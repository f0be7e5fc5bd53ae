"""The most frequent tokens without counting every token across the cluster.

Each task keeps at most ``KEPT`` counters. Where there are more, the smallest surplus count is taken off all of them, and the task
remembers how much it took: a counter is low by at most that, and so is a token it no longer holds. Summed over
tasks this gives every token a lower and an upper bound. Tokens whose upper bound reaches the ``size``-th lower bound are
counted again, exactly; if the sum of all errors stays below the last count, no token can be missing, else all are counted.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import text
from ..session import materialised
from .features import VOCAB_SIZE, build_vocabulary

KEPT = 100_000
#: Candidates up to this number are broadcast to be counted.
CANDIDATES = 400_000


def _summaries(kept: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        lost = 0
        for batch in batches:
            found = pc.value_counts(batch.column(0).flatten())
            counts.update(dict(zip(found.field("values").to_pylist(), found.field("counts").to_pylist())))
            if len(counts) > 2 * kept:
                cut = int(np.partition(np.fromiter(counts.values(), np.int64, len(counts)), -kept - 1)[-kept - 1])
                lost += cut
                counts = Counter({t: n - cut for t, n in counts.items() if n > cut})
        tokens = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([None, *tokens], pa.string()), pa.array([lost, *[counts[t] for t in tokens]], pa.int64())],
                                         names=["token", "n"])

    return run


def frequent_tokens(messages: DataFrame, message: str = "message", size: int = VOCAB_SIZE, kept: int = KEPT) -> DataFrame:
    """``token``, ``n``, ``idx`` as ``build_vocabulary`` gives them, with at most ``2 * kept`` rows a task shuffled."""
    words = messages.select(text.tokens(F.col(message)).alias("_tokens")).where("_tokens IS NOT NULL")
    # a row without token is what its task took off
    told = materialised(words.mapInArrow(_summaries(kept), "token string, n long").groupBy("token").agg(F.sum("n").alias("low")))
    error = told.where("token IS NULL").agg(F.coalesce(F.sum("low"), F.lit(0))).first()[0]
    lows = told.where("token IS NOT NULL")
    last = lows.orderBy(F.desc("low")).limit(size).agg(F.min("low").alias("low"), F.count("*").alias("n")).first()
    if last["n"] < size and error == 0:
        candidates = lows
    else:
        candidates = lows.where(F.col("low") + error >= last["low"])
    if candidates.count() > CANDIDATES:
        return build_vocabulary(messages, message, size)
    some = F.broadcast(candidates.select("token"))
    counted = words.select(F.explode("_tokens").alias("token")).join(some, "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    top = materialised(counted.orderBy(F.desc("n"), "token").limit(size))
    least = top.agg(F.min("n").alias("n"), F.count("*").alias("rows")).first()
    if error and (least["rows"] < size or least["n"] <= error):
        return build_vocabulary(messages, message, size)
    return top.select("token", "n", F.row_number().over(W.orderBy(F.desc("n"), "token")).alias("idx"))
