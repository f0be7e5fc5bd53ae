"""Packing documents into windows of tokens with their lexical neighbours, from a sharded BM25 index.

**Deal.** Documents go to shards by the rarest of their terms that at least ``COMPANY`` documents hold, in ranges of that term and
the id: documents on one matter meet, and a term or text that a third of all documents share is cut by id like any other. A
partition is a range of about ``PARTITION_TOKENS`` tokens; its task walks it in shards of ``SHARD_TOKENS``.

**Retrieve.** A shard's index holds for each term its documents and BM25 weights. Terms are token ids; document frequencies and
the mean length are counted over all documents, and a term that more than half of them hold weighs nothing and leaves the
index. The next unused document is the seed of a window; the unused documents fill it in order of their scores for the seed's
terms, then of the shard.

**Fill.** A document longer than a window fills windows of its own first. The neighbour that no longer fits whole is cut, its rest
stays unused, so a window has no padding. What is left of a shard when no window can be filled goes on to the next shard of the
partition; at the partition's end it is cut into sequences whose lengths are powers of two, which need no padding either.

**Plan.** Texts are encoded once and stored as ids of two bytes where the vocabulary allows; one aggregate of at most a row a term and
task counts frequencies; one range shuffle moves the ids. Sequence ids hold the partition and a number in it.

Cases: a null or empty text is the end token alone; a seed with no term that weighs anything is followed by the shard's order; null ids come first; repeated rows are documents of their own; an empty table
gives no pieces; columns not named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..session import scratch_folder
from .batches import bounded
from .pieces import binary, classes, encoder, with_end

WINDOW = 2_048
#: BM25's saturation and length parameters.
K1, B = 1.2, 0.75
#: A term deals documents to shards where at least so many hold it.
COMPANY = 16
SHARD_TOKENS, PARTITION_TOKENS = 1 << 19, 1 << 22
#: A sequence's id is its number in its partition, below the partition's number.
SEQUENCE_BITS = 32


def encoded(docs: DataFrame, file: str, end: int, doc_id: str, text: str) -> DataFrame:
    """Rows (id, ``n``, ``ids``) stored in the shared folder, ids as little-endian numbers of the vocabulary's width."""
    spark = bounded(docs.sparkSession)
    width = width_of(file)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))

    table = spark.sparkContext.broadcast(classes(file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(file, table.value).encode
        for batch in batches:
            ids, counts = with_end(*encode([t or "" for t in batch.column(1).to_pylist()]), end)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), binary(ids.astype(width), counts).cast(pa.binary())],
                                             names=["doc_id", "n", "ids"])

    folder = scratch_folder(spark)
    rows.mapInArrow(run, "doc_id long, n long, ids binary").write.option("compression", "zstd").parquet(folder)
    return spark.read.schema("doc_id long, n long, ids binary").parquet(folder)


def width_of(file: str) -> str:
    return "<u2" if Tokenizer.from_file(file).get_vocab_size(True) <= 1 << 16 else "<u4"


def numbers(column: pa.Array, width: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a batch's rows, one after another, and where each row's begin and the last one's end."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]]
    return data.view(width), (offsets - offsets[0]) // np.dtype(width).itemsize


def frequencies(coded: DataFrame, width: str, vocabulary: int) -> np.ndarray:
    """How many documents hold each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, mark = np.zeros(vocabulary, dtype=np.int64), np.zeros(vocabulary, dtype=bool)
        for batch in batches:
            ids, bounds = numbers(batch.column(0), width)
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if b - a > 4_096:
                    mark[ids[a:b]] = True
                    total += mark
                    mark[ids[a:b]] = False
                else:
                    total[np.unique(ids[a:b])] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["term", "n"])

    out = np.zeros(vocabulary, dtype=np.int64)
    parts = coded.select("ids").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    for row in parts.collect():  # at most a row a term of the vocabulary
        out[row["term"]] = row["n"]
    return out


class Index:
    """BM25 postings of a shard's documents, weights already computed."""

    def __init__(self, documents: list[np.ndarray], idf: np.ndarray, mean: float):
        n = len(documents)
        sizes = np.array([len(d) for d in documents], dtype=np.int64)
        terms, owner = np.concatenate(documents).astype(np.int64), np.repeat(np.arange(n), sizes)
        worth = idf[terms] > 0
        found, tf = np.unique(terms[worth] * n + owner[worth], return_counts=True)
        term, self.docs = found // n, found % n
        length = K1 * (1 - B + B * sizes / mean)
        self.weights = idf[term] * tf * (K1 + 1) / (tf + length[self.docs])
        _, begins, place = np.unique(term, return_index=True, return_inverse=True)
        self.begins = np.append(begins, len(term))
        order = np.argsort(self.docs, kind="stable")
        self.terms_of, self.at = place[order], np.searchsorted(self.docs[order], np.arange(n + 1))
        self.n = n

    def scores(self, document: int) -> np.ndarray:
        """Scores of all the shard's documents for the distinct terms of one; zeros where none of them weighs anything."""
        terms = self.terms_of[self.at[document]:self.at[document + 1]]
        a, size = self.begins[terms], self.begins[terms + 1] - self.begins[terms]
        before = np.cumsum(size) - size
        postings = np.repeat(a - before, size) + np.arange(int(size.sum()))
        return np.bincount(self.docs[postings], self.weights[postings], self.n).astype(np.float64, copy=False)  # of no postings it makes integers


#: A piece: document's place in its shard, first token, tokens, sequence, place in the sequence.
Piece = tuple[int, int, int, int, int]


def pack_shard(sizes: np.ndarray, index: Index, done: np.ndarray, window: int, sequence: int) -> tuple[list[Piece], int]:
    """Whole windows of a shard's documents, of which ``done`` tokens (kept up to date) are placed; the next free sequence."""
    out: list[Piece] = []
    for d in np.flatnonzero(sizes - done >= window).tolist():
        for _ in range(int(sizes[d] - done[d]) // window):
            out.append((d, int(done[d]), window, sequence, 0))
            done[d] += window
            sequence += 1
    left = int((sizes - done).sum())
    seed = 0
    while left >= window:
        while done[seed] == sizes[seed]:
            seed += 1
        unused = np.flatnonzero(done < sizes)
        scores = index.scores(seed)[unused]
        scores[unused == seed] = np.inf
        ranked = unused[np.argsort(-scores, kind="stable")]
        rest = sizes[ranked] - done[ranked]
        upto = np.cumsum(rest)
        last = int(np.searchsorted(upto, window))
        rest[last] -= upto[last] - window
        for d, offset, n in zip(ranked[:last + 1].tolist(), (np.cumsum(rest[:last + 1]) - rest[:last + 1]).tolist(), rest[:last + 1].tolist()):
            out.append((d, int(done[d]), n, sequence, offset))
        done[ranked[:last + 1]] += rest[:last + 1]
        sequence += 1
        left -= window
    return out, sequence


def pack_rest(sizes: np.ndarray, done: np.ndarray, sequence: int) -> tuple[list[Piece], int]:
    """What is left, in sequences whose lengths are its powers of two, the largest first."""
    out: list[Piece] = []
    left, d = int((sizes - done).sum()), 0
    while left:
        room, offset = 1 << (left.bit_length() - 1), 0
        left -= room
        while room:
            while done[d] == sizes[d]:
                d += 1
            n = min(room, int(sizes[d] - done[d]))
            out.append((d, int(done[d]), n, sequence, offset))
            done[d] += n
            offset, room = offset + n, room - n
        sequence += 1
    return out, sequence


def pack(docs: DataFrame, file: str, window: int = WINDOW, end: int = 1, doc_id: str = "doc_id", text: str = "text",
         shard_tokens: int = SHARD_TOKENS, partition_tokens: int = PARTITION_TOKENS) -> DataFrame:
    """Pieces of all documents: id, ``start`` (its document's tokens before it), ``length``, ``ids`` (little-endian, 32 bits),
    ``doc_tokens`` (the document's, with the end), ``sequence_id`` and ``offset`` in that sequence. ``window`` is a power of two."""
    if window & (window - 1):
        raise ValueError("a window is a power of two")
    coded = encoded(docs, file, end, doc_id, text)
    width, vocabulary = width_of(file), Tokenizer.from_file(file).get_vocab_size(True)
    vocabulary = max(vocabulary, end + 1)
    told = coded.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
    held = frequencies(coded, width, vocabulary)
    idf = np.maximum(np.log((told["n"] - held + 0.5) / (held + 0.5)), 0)
    idf[end] = 0
    mean = told["tokens"] / max(told["n"], 1)
    rarity = np.zeros(vocabulary, dtype=np.int32)  # the higher the rarer, of terms held by enough documents
    company = np.flatnonzero((held >= COMPANY) & (idf > 0))
    rarity[company[np.argsort(-held[company], kind="stable")]] = np.arange(1, len(company) + 1)
    shared = coded.sparkSession.sparkContext.broadcast((idf, rarity))

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, rarity = shared.value
        for batch in batches:
            ids, bounds = numbers(batch.column(2), width)
            leads = np.maximum.reduceat(rarity[ids], bounds[:-1]) if batch.num_rows else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leads)], names=["doc_id", "n", "ids", "lead"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, _ = shared.value
        sequence = TaskContext.get().partitionId() << SEQUENCE_BITS
        names: list[int | None] = []
        tokens: list[np.ndarray] = []
        done: list[int] = []
        waiting = 0

        def told(pieces: list[Piece]) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(pieces), 1_024):
                some = pieces[a:a + 1_024]
                parts = [tokens[d][start:start + n] for d, start, n, _, _ in some]
                counts = np.array([len(p) for p in parts], dtype=np.int64)
                columns = [pa.array([names[p[0]] for p in some], pa.int64()), *[pa.array([p[k] for p in some], pa.int64()) for k in (1, 2)],
                           binary(np.concatenate(parts).astype("<u4"), counts).cast(pa.binary()),
                           pa.array([len(tokens[p[0]]) for p in some], pa.int64()), *[pa.array([p[k] for p in some], pa.int64()) for k in (3, 4)]]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        def shard(whole: bool) -> Iterator[pa.RecordBatch]:
            nonlocal names, tokens, done, waiting, sequence
            sizes, at = np.array([len(t) for t in tokens], dtype=np.int64), np.array(done, dtype=np.int64)
            pieces, sequence = pack_shard(sizes, Index(tokens, idf, mean), at, window, sequence)
            if whole:
                more, sequence = pack_rest(sizes, at, sequence)
                pieces += more
            yield from told(pieces)
            left = np.flatnonzero(at < sizes).tolist()
            names, tokens, done = [names[d] for d in left], [tokens[d] for d in left], at[left].tolist()
            waiting = int((sizes - at).sum())

        for batch in batches:
            ids, bounds = numbers(batch.column(1), width)
            ids = ids.copy()
            for i, name in enumerate(batch.column(0).to_pylist()):
                names.append(name)
                tokens.append(ids[bounds[i]:bounds[i + 1]])
                done.append(0)
                waiting += len(tokens[-1])
                if waiting >= shard_tokens:
                    yield from shard(False)
        if tokens:
            yield from shard(True)

    parts = max(1, -(-told["tokens"] // partition_tokens))
    order = ["lead", F.col("doc_id").asc_nulls_first(), F.xxhash64("ids")]
    dealt = coded.mapInArrow(lead, "doc_id long, n long, ids binary, lead int").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return dealt.select("doc_id", "ids").mapInArrow(
        packed, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
