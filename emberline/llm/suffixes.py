"""Benchmark decontamination with suffix arrays of the training text.

Each task cuts its documents into shards (one Arrow batch each), writes a shard's words as numbers of the test
vocabulary, and sorts the positions of the shard into a suffix array. Every suffix of every test item is binary-searched
in it: the neighbours of its place give its longest verbatim match, and the places of its first ``window`` words are a
range of the array, read off with two more searches. Words outside the test vocabulary can't be part of a match, so they
are 0 and end a suffix.

The test items go out as broadcasts of at most ``BLOCK_BYTES`` of text each, as many as they need; the shard is searched
for one block after the other. Documents are never shuffled.

Cases: a null or empty text has no words and no hits; an item without words has no windows and never counts; an item of
fewer words than the window is one window; items with equal ids are one item, whatever their texts; a null item id is
listed as ``null``; repeated documents are each reported; empty tables give no hits or no rows; other columns pass
through, and input columns named like an output are replaced. Hits are exact up to collisions of 64-bit word hashes.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import with_columns
from .words import ALNUM, words

#: Words of a window.
WINDOW = 10
#: Test text in one broadcast, in bytes.
BLOCK_BYTES = 16 << 20

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


class TestItems:
    """Words of a block of test items as numbers, packed several to a 64-bit key in reading order."""

    __test__ = False

    def __init__(self, ids: list[str | None], texts: pa.Array, window: int):
        found = words(texts, ALNUM)
        self.vocabulary, numbers = np.unique(found.hashes, return_inverse=True)
        self.bits = max(1, int(len(self.vocabulary)).bit_length())
        self.per_key = 64 // self.bits
        counts = found.counts
        self.flat = separated(numbers.astype(np.uint64) + np.uint64(1), found.first, self.per_key)
        self.keys = packed(self.flat, self.bits, self.per_key)
        starts = np.repeat(found.first[:-1] + np.arange(len(counts)), counts)
        within = np.arange(len(numbers)) - np.repeat(found.first[:-1], counts)
        owner = np.repeat(np.arange(len(counts)), counts)
        size = np.minimum(counts, window)[owner]
        #: Every suffix: where it starts, the words left in its item, its item, and the words of its window (0: none).
        self.suffix = starts + within
        self.left = counts[owner] - within
        self.window = np.where(self.left >= size, size, 0)
        self.longest = int(counts.max(initial=0))
        names = [i if i is not None else "null" for i in ids]
        self.names, number = np.unique(np.array(names, dtype=object).astype(str), return_inverse=True)
        self.item = number[owner] if len(number) else owner
        order = np.argsort(self.keys[self.suffix], kind="stable")  # neighbours in the array are searched together
        self.suffix, self.left, self.window, self.item = (x[order] for x in (self.suffix, self.left, self.window, self.item))


def separated(numbers: np.ndarray, first: np.ndarray, spare: int) -> np.ndarray:
    """Numbers of all texts with a 0 after each text, and zeros at the end."""
    out = np.zeros(len(numbers) + len(first) - 1 + spare + 1, dtype=np.uint64)
    out[np.arange(len(numbers)) + np.repeat(np.arange(len(first) - 1), np.diff(first))] = numbers
    return out


def packed(numbers: np.ndarray, bits: int, per_key: int) -> np.ndarray:
    """At each position the next ``per_key`` numbers as one integer; after the first 0 all are 0."""
    key, alive = numbers.copy(), numbers > 0
    for shift in range(1, per_key):
        following = np.zeros_like(numbers)
        following[:-shift] = numbers[shift:]
        following[~alive] = 0
        alive &= following > 0
        key = (key << np.uint64(bits)) | following
    return key


class SuffixArray:
    """Suffixes of a shard in word order, compared as far as the longest test item reaches."""

    def __init__(self, numbers: np.ndarray, first: np.ndarray, bits: int, per_key: int, longest: int):
        self.bits, self.per_key = bits, per_key
        self.flat = separated(numbers, first, per_key)
        self.keys = packed(self.flat, bits, per_key)
        places = np.flatnonzero(self.flat)
        order = np.argsort(self.keys[places], kind="stable")
        self.places = places[order]
        self._refine(longest)

    def _refine(self, longest: int) -> None:
        """Order runs of suffixes with equal keys by their next key, until all differ or end."""
        full = np.uint64((1 << self.bits) - 1)
        key = self.keys[self.places]
        group = np.zeros(len(key), dtype=np.int64)
        group[1:] = np.cumsum(key[1:] != key[:-1])
        at, depth = np.arange(len(key)), self.per_key
        while len(at) and depth < longest:
            same = np.zeros(len(at), dtype=bool)
            equal = group[1:] == group[:-1]
            same[1:] |= equal
            same[:-1] |= equal
            keep = same & ((key & full) > 0)
            at, group = at[keep], group[keep]
            if not len(at):
                break
            suffix = self.places[at]
            key = self.keys[suffix + depth]
            order = np.lexsort((key, group))
            self.places[at] = suffix[order]
            key, group = key[order], group[order]
            change = np.ones(len(at), dtype=np.int64)
            change[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
            group = np.cumsum(change)
            depth += self.per_key

    def _sign(self, middle: np.ndarray, items: TestItems, query: np.ndarray, size: np.ndarray) -> np.ndarray:
        """-1, 0 or 1: the suffix at ``middle`` comes before the first ``size`` words of ``query``, starts so, or comes after."""
        out = np.zeros(len(middle), dtype=np.int8)
        suffix, active, depth = self.places[middle], np.arange(len(middle)), 0
        while len(active):
            left = size[active] - depth
            shift = (np.maximum(self.per_key - left, 0) * self.bits).astype(np.uint64)
            own, wanted = self.keys[suffix[active] + depth] >> shift, items.keys[query[active] + depth] >> shift
            out[active] = np.where(own < wanted, -1, np.where(own > wanted, 1, 0))
            active = active[(own == wanted) & (left > self.per_key)]
            depth += self.per_key
        return out

    def bound(self, items: TestItems, query: np.ndarray, size: np.ndarray, upper: bool = False) -> np.ndarray:
        """Where the first ``size`` words of each query would stand: before its equals, or after them."""
        low, high = np.zeros(len(query), dtype=np.int64), np.full(len(query), len(self.places), dtype=np.int64)
        while len(active := np.flatnonzero(low < high)):
            middle = (low[active] + high[active]) // 2
            sign = self._sign(middle, items, query[active], size[active])
            right = sign <= 0 if upper else sign < 0
            low[active[right]] = middle[right] + 1
            high[active[~right]] = middle[~right]
        return low

    def common(self, rank: np.ndarray, items: TestItems, query: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Words that the suffix of a rank shares with the query."""
        out = np.zeros(len(rank), dtype=np.int64)
        active = np.flatnonzero((rank >= 0) & (rank < len(self.places)))
        while len(active):
            n = out[active]
            same = (n < size[active]) & (self.flat[self.places[rank[active]] + n] == items.flat[query[active] + n])
            active = active[same]
            out[active] += 1
        return out


def search(texts: pa.Array, items: TestItems):
    """Per text: the number of words, hit words (flat), pairs of text and item, and the longest match in words."""
    found = words(texts, ALNUM)
    hits, pairs, longest = np.zeros(len(found.hashes), dtype=bool), np.zeros((0, 2), np.int64), np.zeros(len(texts), np.int64)
    if len(items.suffix) and len(found.hashes):
        number = np.searchsorted(items.vocabulary, found.hashes)
        known = items.vocabulary[np.minimum(number, len(items.vocabulary) - 1)] == found.hashes
        numbers = np.where(known, number + 1, 0).astype(np.uint64)
        array = SuffixArray(numbers, found.first, items.bits, items.per_key, items.longest)
        place = array.bound(items, items.suffix, items.left)
        match = np.maximum(array.common(place, items, items.suffix, items.left),
                           array.common(place - 1, items, items.suffix, items.left))
        hit = np.flatnonzero((items.window > 0) & (match >= items.window))
        size = items.window[hit]
        low, high = array.bound(items, items.suffix[hit], size), array.bound(items, items.suffix[hit], size, upper=True)
        owner = np.repeat(np.arange(len(texts) + 1), np.append(found.counts + 1, array.per_key + 1))[:len(array.flat)]
        change = np.zeros(len(found.hashes) + 1, dtype=np.int64)
        parts = []
        for some in np.array_split(np.arange(len(hit)), max(1, int((high - low).sum()) // 1_000_000)):
            runs = (high - low)[some]
            ranks = np.repeat(low[some] - np.cumsum(runs) + runs, runs) + np.arange(runs.sum())
            which = np.repeat(hit[some], runs)
            spot = array.places[ranks]
            text = owner[spot]
            np.add.at(change, spot - text, 1)
            np.add.at(change, spot - text + items.window[which], -1)
            np.maximum.at(longest, text, array.common(ranks, items, items.suffix[which], items.left[which]))
            parts.append(np.unique(np.stack([text, items.item[which]], axis=1), axis=0))
        hits = np.cumsum(change)[:-1] > 0
        pairs = np.unique(np.concatenate(parts), axis=0) if parts else pairs
    return found, hits, pairs, longest


def spans_of(hits: np.ndarray, first: np.ndarray) -> pa.Array:
    """Runs of hit words of each text, as word positions in the text, end exclusive."""
    edge = np.zeros(len(hits), dtype=bool)
    edge[first[:-1][first[:-1] < len(hits)]] = True
    before = np.append(False, hits[:-1]) & ~edge
    after = np.append(hits[1:] & ~edge[1:], False)
    starts, ends = np.flatnonzero(hits & ~before), np.flatnonzero(hits & ~after) + 1
    text = np.searchsorted(first, starts, "right") - 1
    rows = pa.StructArray.from_arrays([pa.array((starts - first[text]).astype(np.int32)),
                                       pa.array((ends - first[text]).astype(np.int32))], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(first))).astype(np.int32)), rows)


def item_blocks(items: DataFrame, item_id: str, text: str, window: int) -> Iterator[TestItems]:
    """The test items in blocks of a bounded size, each fetched on its own."""
    own = items.select(F.col(item_id).cast("string").alias("id"), F.coalesce(text, F.lit("")).alias("text")).distinct()
    size = own.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-2 * size // BLOCK_BYTES)) if size > BLOCK_BYTES else 1
    for block in range(blocks):
        some = own.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block).toArrow()
        yield TestItems(some["id"].to_pylist(), some["text"].combine_chunks(), window)


def mark(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
         window: int = WINDOW) -> DataFrame:
    """Adds ``n_words``, ``hit_spans`` (word positions), ``hit_items`` (sorted ids) and ``longest_match`` (words)."""
    sc = docs.sparkSession.sparkContext
    blocks = [sc.broadcast(b) for b in item_blocks(items, item_id, item_text, window)]

    def start():
        def run(texts: pa.Array):
            found, hits, longest, names = None, None, None, [set() for _ in range(len(texts))]
            for block in blocks:
                test = block.value
                found, some, pairs, far = search(texts, test)
                hits = some if hits is None else hits | some
                longest = far if longest is None else np.maximum(longest, far)
                for row, own in itertools.groupby(pairs.tolist(), key=lambda p: p[0]):
                    names[row].update(test.names[i] for _, i in own)
            return (pa.array(found.counts), spans_of(hits, found.first),
                    pa.array([sorted(n) for n in names], pa.list_(pa.string())), pa.array(longest))

        return run

    return with_columns(docs, [text], [
        T.StructField("n_words", T.LongType()), T.StructField("hit_spans", SPANS),
        T.StructField("hit_items", T.ArrayType(T.StringType())), T.StructField("longest_match", T.LongType())], start)


def hit_words(spans: str = "hit_spans"):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` without those that hold a window of a test item."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    marked = mark(docs.select(row, F.col(f"`{text}`").alias("text")), items, **options)
    return marked.where(F.size("hit_spans") == 0).select("__row.*")
