"""Importance resampling of documents towards a target distribution of hashed word n-grams.

A feature is a run of one to three consecutive words; its bucket is the CRC-32 of its bytes modulo ``BUCKETS``. A bucket's gain
is the logarithm of its share in the target over its share in the documents, a document's weight the sum of its features' gains.
Gumbel noise from a hash of the id makes taking the highest scores a draw without replacement.

**Segments.** Newlines cut texts into lines. Of the whole table only distinct lines are counted: equal lines meet in an
aggregate that combines before its shuffle, features of each are computed once and multiplied by its occurrences, and runs of
words that cross a newline are counted apart, where the document is read. Weights do the same within a batch of
documents: each distinct line is weighed once, its weight goes to all its places, and runs across newlines are added.

**Plan.** Two scans of the texts and one shuffle of distinct lines give ``BUCKETS`` sums, the only thing that reaches the
driver and, as gains, the tasks. A third scan weighs without a shuffle. Only rows above a score that at least the share to be
drawn reaches are sorted, by range; a row's rank is its place plus the sizes of the ranges before it.

Cases: a null or empty text, or one without words, has no features and weight 0, and is never drawn below ``least_words``; a
null id hashes like an empty one and loses ties; repeated rows are documents of their own; an empty target or table gives
gains from the formula, and empty tables give empty results; columns not named are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crc
from .batches import bounded
from .stored import stored
from .words import ALNUM, LOWER, Prefix, utf8

BUCKETS = 10_000
LONGEST = 3
#: Of rows in order of score, so many more than the share are sorted, as the quantile that picks them is approximate.
SLACK = 0.01


@dataclass
class Cut:
    """Words of a batch of texts: bounds in the bytes, the text and the line (numbered through the batch) each belongs to."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    line: np.ndarray
    line_starts: np.ndarray
    line_ends: np.ndarray
    texts: int


def cut(column: pa.Array) -> Cut:
    data, offsets = utf8(column)
    data = LOWER[data]
    inside = ALNUM[data]
    n = len(data)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True  # words end where texts do
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    stops[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    newlines = np.flatnonzero(data == 10)
    texts = len(offsets) - 1
    line_starts = np.sort(np.concatenate([offsets[:-1], newlines + 1]))
    # a line ends at its newline or with its text
    line_ends = np.sort(np.concatenate([offsets[1:], newlines]))
    line = np.searchsorted(line_starts, starts, "right") - 1
    text = np.searchsorted(offsets, starts, "right") - 1
    return Cut(data, starts, ends, text, line, line_starts, line_ends, texts)


def runs(c: Cut, used: np.ndarray, across: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first word, whether it crosses lines, bucket) of runs of words.

    Runs within a line are those of words marked ``used``; runs across newlines of one text come with ``across``.
    """
    n = len(c.starts)
    picked, crosses = [], []
    needed = used.copy()
    for size in range(1, min(LONGEST, n) + 1):
        last = n - size + 1
        other = c.line[:last] != c.line[size - 1:]
        take = ~other & used[:last]
        if across and size > 1:
            over = other & (c.text[:last] == c.text[size - 1:])
            for k in range(size):
                needed[k:last + k] |= over
            take |= over
        at = np.flatnonzero(take)
        picked.append(at)
        crosses.append(other[at])
    at = np.flatnonzero(needed)
    place = np.cumsum(needed) - 1
    size = (c.ends - c.starts)[at]
    alone = crc.registers(c.data, c.starts[at], c.ends[at])
    space = crc.step_table()[np.full(1, ord(" "))]
    spaced = crc.moved(np.repeat(space, len(size)), size) ^ alone  # with the blank before it
    for k, (first, crossing) in enumerate(zip(picked, crosses)):
        own = place[first]
        register, length = alone[own], size[own]
        for more in range(1, k + 1):
            following = own + more  # words of a run are all needed, so they stand side by side
            register = crc.moved(register, size[following] + 1) ^ spaced[following]
            length = length + size[following] + 1
        yield first, crossing, crc.checksum(register, length) % np.uint32(BUCKETS)


def _sums(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])


def count_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features by bucket of (line, occurrences)."""
    total = np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        c, times = cut(batch.column(0)), batch.column(1).to_numpy()
        for first, _, bucket in runs(c, np.ones(len(c.starts), dtype=bool), False):
            np.add.at(total, bucket, times[c.text[first]])
    yield from _sums(total)


def count_crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features by bucket of runs of words that cross newlines within a text."""
    total = np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        c = cut(batch.column(0))
        for _, _, bucket in runs(c, np.zeros(len(c.starts), dtype=bool), True):
            total += np.bincount(bucket, minlength=BUCKETS)
    yield from _sums(total)


def bucket_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Features of all documents by bucket."""
    bounded(docs.sparkSession)
    texts = docs.select(F.col(f"`{text}`").cast("string").alias("text")).where("text IS NOT NULL")
    lines = texts.select(F.explode(F.split("text", "\n")).alias("line")).where("line <> ''").groupBy("line").count()
    schema = "bucket int, n long"
    parts = lines.mapInArrow(count_lines, schema).unionByName(texts.mapInArrow(count_crossing, schema))
    out = np.zeros(BUCKETS, dtype=np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most BUCKETS rows
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floors of a thousand times the log ratio of smoothed shares, by bucket."""
    whole, wanted = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1.0) * whole / ((s + 1.0) * wanted)))
                     for s, t in zip(source.tolist(), target.tolist())], dtype=np.int64)


def weigh(c: Cut, gain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, features and weight of each text; each distinct line of the batch is weighed once."""
    words = np.bincount(c.text, minlength=c.texts)
    features = sum(np.maximum(words - k, 0) for k in range(LONGEST))
    keys = np.stack([Prefix(c.data).slices(c.line_starts, c.line_ends), (c.line_ends - c.line_starts).astype(np.uint64)], axis=1)
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    ranked = keys[order]
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (ranked[1:] != ranked[:-1]).any(axis=1)
    like = np.empty(len(order), dtype=np.int64)  # the line that is weighed in a line's stead
    like[order] = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))] if len(order) else order
    used = (like == np.arange(len(like)))[c.line]
    lines, texts = np.zeros(len(like)), np.zeros(c.texts)
    for first, crossing, bucket in runs(c, used, True):
        worth = gain[bucket].astype(np.float64)  # sums of integers below 2^53 are exact
        lines += np.bincount(c.line[first[~crossing]], worth[~crossing], len(like))
        texts += np.bincount(c.text[first[crossing]], worth[crossing], c.texts)
    filled = np.unique(c.line)  # lines without words weigh nothing
    owner = np.zeros(len(like), dtype=np.int64)
    owner[c.line] = c.text
    texts += np.bincount(owner[filled], lines[like[filled]], c.texts)
    return words, features, texts.astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (id, ``n_words``, ``n_features``, ``weight``) of all documents."""
    spark = bounded(docs.sparkSession)
    shared = spark.sparkContext.broadcast(gain)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = weigh(cut(batch.column(1)), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(m.astype(np.int64)) for m in made]],
                                             names=["doc_id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def with_noise(weighed: DataFrame, seed: int) -> DataFrame:
    """Adds ``score``: the weight and Gumbel noise of the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return weighed.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))))


def ranked(rows: DataFrame, drawn: int) -> DataFrame:
    """Adds ``rank`` by descending score, ties to the smaller id, and drops it beyond ``drawn``."""
    placed = stored(
        rows.repartitionByRange(F.desc("score"), F.col("doc_id").asc_nulls_last())
        .sortWithinPartitions(F.desc("score"), F.col("doc_id").asc_nulls_last())
        .withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)  # as the function packs them
    sizes = sorted((r["part"], r["n"]) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    firsts, before = [], 0
    for p, n in sizes:
        firsts.append((p, before))
        before += n
    offsets = rows.sparkSession.createDataFrame(firsts, "_part long, _before long")  # a row a range
    rank = F.col("_before") + place + 1
    return (placed.join(F.broadcast(offsets), part == F.col("_part"))
            .withColumn("rank", F.when(rank <= drawn, rank)).drop("_at", "_part", "_before"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42,
             doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's id, ``n_features``, ``weight``, ``score``, and the ``rank`` of those drawn.

    Drawn are ``percent`` in a hundred of the documents with ``least_words`` words, those of the highest scores.
    """
    gain = gains(bucket_counts(docs, text), bucket_counts(target, text))
    scored = stored(with_noise(weights(docs, gain, doc_id, text), seed))
    able = F.col("n_words") >= least_words
    cuts = max(0.0, 1 - percent / 100 - SLACK)
    told = scored.where(able).agg(F.count("*").alias("n"), F.percentile_approx("score", F.lit(cuts), F.lit(10_000)).alias("low")).first()
    drawn = percent * told["n"] // 100
    shown = ["doc_id", "n_features", "weight", "score"]
    if drawn == 0:
        return scored.select(*shown, F.lit(None).cast("long").alias("rank"))
    high = able & (F.col("score") >= told["low"])
    if scored.where(high).count() < drawn:  # never by the quantile's bound; then all are sorted
        high = able
    return ranked(scored.where(high), drawn).select(*shown, "rank").unionByName(
        scored.where(~high).select(*shown, F.lit(None).cast("long").alias("rank")))
