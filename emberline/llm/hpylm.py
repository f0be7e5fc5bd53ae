"""A hierarchical Pitman-Yor language model with seating sampled by Gibbs, and what it makes of every text.

**Tokens** are words (anything but ASCII white space, A-Z lower-cased) and an end after each text.

**Restaurants.** Every training token is a context: a restaurant whose customers are the tokens after it. The at most
``CLASSES`` commonest tokens are classes of their own; all others, seen or not, share one class, *rare*. Parents:

* The restaurants of classes over classes share a parent over all classes, whose base is uniform. They are the dense table.
* A rare token after a class is drawn from that class's own restaurant over rare tokens, a child of the word restaurant.
* A token after a rare one is drawn from that token's own restaurant over all tokens. Its parent is the product of the
  class row *rare* and, for rare tokens, of the word restaurant.
* The word restaurant is over all rare tokens; its base is uniform over the known tokens and one for all unknown ones.

So every pair of tokens seen in training has its own customers (``learn_whole``); classes only bound the broadcast dense
table, and pairs with a rare token are a distributed table as large as the corpus makes it. Tables of these restaurants
are the customers of the word restaurant and of the row *rare*. ``learn`` gives the parents alone, from plain counts.

**Seating.** A dish of a pair or of a word, with at most ``DRAWN`` customers, is only a number of tables (``learn_and_score``): in a sweep
it is drawn as a whole from its exact distribution given the other dishes' tables (``draw_tables``). Otherwise, a
restaurant's state is the sizes of the tables at which each dish is eaten. In a sweep, each restaurant takes
``MOVES`` customers of every dish, one after the other, from a table drawn by size, and seats them again: at a table of
the dish with weight size less discount, at a new one with weight (strength + discount * tables) * parent's probability.
Tables are the parent's customers. Restaurants are seated in parallel given the parent. A parent keeps its seating: after
each sweep below it, a customer leaves for each table gone there, drawn by table size, one sits down for each new table, drawn
like any other, and then it is swept itself (``Seating.follow``). After ``BURN_IN`` sweeps, predictive probabilities are averaged over ``SAMPLES``. Seating
starts at the expected number of tables. Discounts are estimated from dishes seen once and twice, at each level.

Tokens and pairs known to the broadcast tables of the ``LOOKUP`` and ``PAIRS`` commonest are scored where the text is read;
the others are joined with the tables of all tokens and of all pairs. A pair's log probability is that of its parent, the
context's back-off weight, and what the pair's own customers add, so each of them is one lookup. Identities of pairs are
64-bit hashes, like those of tokens.

Cases: a null or empty text is an end alone; rows with a null id count as training text; repeated rows count as often
as they stand there; an empty training set scores every token 1 / (1 + 0), so 0; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import bounded, with_columns
from .stored import dropped, shuffles_dropped, stored
from .words import Prefix, mix, utf8

CLASSES, LOOKUP, PAIRS = 2_047, 1 << 18, 1 << 20
BURN_IN, SAMPLES, MOVES = 2, 3, 6
DRAWN = 32  # dishes with so many customers have their number of tables drawn as a whole
MIN_PARTS = 8
SHARD_BYTES = 4 << 20  # of text
STRENGTH, PARENT_DISCOUNT = 1.0, 0.5

END = mix(np.array([0xE4D], dtype=np.uint64))[0]


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts with their ends, and where each text's begin."""
    data, offsets = utf8(texts)
    n = len(data)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = data
    padded[:n] |= (data - np.uint8(ord("A")) < 26).astype(np.uint8) << 5  # lower case
    inside = (data != 0x20) & (data - np.uint8(0x09) >= 5)
    start, end = inside.copy(), inside.copy()  # of a word: its neighbour is white space or of another text
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edge = offsets[:-1][offsets[:-1] < n]
    start[edge] = inside[edge]
    edge = edge[edge > 0] - 1
    end[edge] = inside[edge]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    count = np.searchsorted(starts, offsets)
    first = count + np.arange(len(offsets))
    out = np.full(first[-1], END, dtype=np.uint64)
    out[np.arange(len(starts)) + np.repeat(np.arange(len(offsets) - 1), np.diff(count))] = hashes(padded, starts, ends - starts)
    return out, first


#: What of eight bytes belongs to a word that ends after so many.
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)
LONG = 256


def hashes(padded: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Identities of words of a buffer that goes on for eight bytes: eight bytes at a time, very long words by the buffer's running sums."""
    eight = np.ndarray(len(padded) - 7, np.dtype("<u8"), padded, strides=(1,))
    out = mix((eight[starts] & _MASKS[np.minimum(sizes, 8)]) + sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    rest = np.flatnonzero(sizes > 8)
    for at in range(8, min(LONG, int(sizes.max(initial=0))), 8):
        rest = rest[sizes[rest] > at]
        out[rest] = mix(out[rest] * np.uint64(0x9E3779B97F4A7C15) + (eight[starts[rest] + at] & _MASKS[np.minimum(sizes[rest] - at, 8)]))
    long = np.flatnonzero(sizes > LONG)
    if len(long):
        out[long] = Prefix(padded).slices(starts[long], starts[long] + sizes[long])
    return out


def kinds_of(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and which of them each value is."""
    order = np.argsort(found)
    found = found[order]
    new = np.append(True, found[1:] != found[:-1])[:len(found)]
    which = np.empty(len(found), np.int32)
    which[order] = np.cumsum(new, dtype=np.int32) - 1
    return found[new], which


def discount(counts: np.ndarray | None = None, once: float = 0, twice: float = 0) -> float:
    """From dishes seen once and twice."""
    if counts is not None:
        once, twice = float((counts == 1).sum()), float((counts == 2).sum())
    return float(np.clip(once / (once + 2 * twice) if once else 0.5, 0.1, 0.95))


def start_tables(counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """About the expected number of tables of each dish where a new one has this weight."""
    expected = np.rint(weight * np.log1p(counts / np.maximum(weight, 1e-12)))
    return np.clip(expected, np.minimum(counts, 1), counts).astype(np.int64)


@dataclass
class Seating:
    """Table sizes of dishes: those of dish ``i`` are ``sizes[first[i]:first[i + 1]]``."""

    counts: np.ndarray
    sizes: np.ndarray
    first: np.ndarray

    @classmethod
    def even(cls, counts: np.ndarray, tables: np.ndarray) -> Seating:
        first = np.concatenate([[0], np.cumsum(tables)])
        dish = np.repeat(np.arange(len(counts)), tables)
        place = np.arange(first[-1]) - first[dish]
        share, more = counts // np.maximum(tables, 1), counts % np.maximum(tables, 1)
        return cls(counts, share[dish] + (place < more[dish]), first)

    @property
    def tables(self) -> np.ndarray:
        return np.diff(self.first)

    def sweep(self, restaurant: np.ndarray, total: np.ndarray, parent: np.ndarray, d: float, rng: np.random.Generator,
              moves: int = MOVES, strength: float = STRENGTH) -> Seating:
        """Reseat ``moves`` customers of each dish; ``total`` are the tables of each restaurant, ``parent`` the dishes' probabilities."""
        tables, total = self.tables.copy(), total.astype(float)
        room = np.where(self.counts > 1, tables + moves, tables)
        first = np.concatenate([[0], np.cumsum(room)])
        sizes = np.zeros(first[-1], dtype=np.int64)
        dish = np.repeat(np.arange(len(tables)), tables)
        sizes[np.arange(len(self.sizes)) - self.first[dish] + first[dish]] = self.sizes
        free = first[:-1] + tables
        moving = np.flatnonzero(self.counts > 1)  # a lone customer always has the one table
        if len(moving):
            c, begin, where = self.counts[moving], first[moving], restaurant[moving]
            for _ in range(moves):
                upto = np.concatenate([[0], np.cumsum(sizes)])
                taken = np.searchsorted(upto, upto[begin] + (rng.random(len(moving)) * c).astype(np.int64), "right") - 1
                sizes[taken] -= 1
                left = sizes[taken] == 0
                tables[moving] -= left
                np.subtract.at(total, where, left)
                old = c - 1 - d * tables[moving]
                new = (strength + d * total[where]) * parent[moving]
                draw = rng.random(len(moving)) * (old + new)
                upto = np.concatenate([[0.0], np.cumsum(np.maximum(sizes - d, 0.0))])
                joined = np.searchsorted(upto, upto[begin] + draw, "right") - 1
                joined = np.clip(joined, begin, first[moving + 1] - 1)
                opened = (draw >= old) | (sizes[joined] == 0)
                spot = np.where(opened, np.where(left, taken, free[moving]), joined)
                free[moving] += opened & ~left
                sizes[spot] += 1
                tables[moving] += opened
                np.add.at(total, where, opened)
        kept = sizes > 0
        return Seating(self.counts, sizes[kept], np.concatenate([[0], np.cumsum(tables)]))

    def follow(self, counts: np.ndarray, restaurant: np.ndarray, total: np.ndarray, parent: np.ndarray, d: float, rng: np.random.Generator,
               strength: float = STRENGTH) -> Seating:
        """The same tables for other numbers of customers: those gone are drawn from the seated, those new sit down one after the other."""
        held = self.sizes.copy()
        for i in np.flatnonzero(counts < self.counts):
            own = slice(self.first[i], self.first[i + 1])
            held[own] -= rng.multivariate_hypergeometric(held[own], self.counts[i] - counts[i], method="marginals")
        dish = np.repeat(np.arange(len(counts)), self.tables)
        dish, held = dish[held > 0], held[held > 0]
        tables, total = np.bincount(dish, minlength=len(counts)), total.astype(float)
        np.subtract.at(total, restaurant, self.tables - tables)
        # dishes by how many sit down, most first: those with one more to seat stand in front
        come = np.maximum(counts - self.counts, 0)
        order = np.argsort(-come, kind="stable")
        come, where, p, c, left = come[order], restaurant[order], parent[order], np.minimum(self.counts, counts)[order], tables[order]
        first = np.concatenate([[0], np.cumsum(left + come)])
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        sizes = np.zeros(first[-1], np.int64)
        sizes[first[place[dish]] + np.arange(len(dish)) - np.concatenate([[0], np.cumsum(tables)])[dish]] = held
        for step in range(int(come.max(initial=0))):
            m = int(np.searchsorted(-come, -step, "left"))  # with more than ``step`` to come
            begin, upto = first[:m], np.concatenate([[0.0], np.cumsum(np.maximum(sizes[:first[m]] - d, 0.0))])
            old = c[:m] - d * left[:m]
            draw = rng.random(m) * (old + (strength + d * total[where[:m]]) * p[:m])
            joined = np.clip(np.searchsorted(upto, upto[begin] + draw, "right") - 1, begin, first[1:m + 1] - 1)
            opened = (draw >= old) | (sizes[joined] == 0)
            sizes[np.where(opened, begin + left[:m], joined)] += 1
            left[:m] += opened
            c[:m] += 1
            np.add.at(total, where[:m], opened)
        owner = np.repeat(order, np.diff(first))
        kept = sizes > 0
        owner, sizes = owner[kept], sizes[kept]
        by_dish = np.argsort(owner, kind="stable")
        return Seating(counts, sizes[by_dish], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(counts)))]))


def lists_seating(lists: pa.ListArray) -> Seating:
    """A seating out of its stored table sizes, a list a dish."""
    sizes, first = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64)
    return Seating(np.diff(np.concatenate([[0], np.cumsum(sizes)])[first]), sizes, first)


def seating_lists(seating: Seating) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(seating.first.astype(np.int32)), pa.array(seating.sizes))


def counted(docs: DataFrame, parts: int = 64) -> DataFrame:
    """Rows (word, n) of all tokens of the texts; counted within tasks before the shuffle, which moves arrays of words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0

        def rows():
            word, n = np.unique(np.concatenate(held), return_counts=True)
            order, bounds = by_part(part_of(word, parts), parts)
            return pa.RecordBatch.from_arrays([pa.array(np.arange(parts, dtype=np.int32)), blobs(word[order], bounds), blobs(n[order], bounds)], names=["part", "word", "n"])

        for batch in batches:
            held.append(tokens(batch.column(0))[0])
            waiting += len(held[-1])
            if waiting > 5_000_000:
                yield rows()
                held, waiting = [], 0
        if held:
            yield rows()

    def total(table: pa.Table) -> pa.Table:
        word, n = (np.frombuffer(b"".join(table[c].to_pylist()), np.int64) for c in ("word", "n"))
        word, which = kinds_of(word)
        return pa.table([pa.array(word), pa.array(np.bincount(which, n, len(word)).astype(np.int64))], names=["word", "n"])

    return docs.mapInArrow(run, "part int, word binary, n binary").groupBy("part").applyInArrow(total, "word long, n long")


def part_of(word: np.ndarray, parts: int) -> np.ndarray:
    return ((word >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)


def by_part(part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of things by part, and each part's bounds in it."""
    order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
    return order, np.append(0, np.cumsum(np.bincount(part, minlength=parts)))


def blobs(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Slices of an array, each as the bytes of one row."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def commonest(table: DataFrame, most: int, times: str | None = None) -> int:
    """The least count that no more than ``most`` words reach; ``times`` holds how many words a row stands for."""
    by_n = table.groupBy("n").agg((F.sum(times) if times else F.count("*")).alias("m")).orderBy(F.desc("n")).limit(most + 1).toArrow()  # a word each at least
    n, m = by_n["n"].to_numpy(), by_n["m"].to_numpy()
    order = np.argsort(-n)
    fits = np.cumsum(m[order]) <= most
    return int(n[order][fits][-1]) if fits.any() else (int(n.max()) + 1 if len(n) else 1)


def sorted_words(table: DataFrame, *columns: str) -> tuple[np.ndarray, ...]:
    """Columns of a table of bounded size, ordered by word."""
    found = table.select("word", *columns).toArrow()
    word = found["word"].to_numpy().view(np.uint64)
    order = np.argsort(word)
    return word[order], *[found[c].to_numpy()[order] for c in columns]


def place_in(known: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where tokens stand in a sorted array, and whether they do."""
    if not len(known):
        return np.zeros(len(found), np.int64), np.zeros(len(found), dtype=bool)
    if len(known) > 4_096 and len(found) > 4_096:  # a search in order stays in the cache
        order = np.argsort(found)
        at = np.empty(len(found), np.int64)
        at[order] = np.searchsorted(known, found[order])
    else:
        at = np.searchsorted(known, found)
    at = np.minimum(at, len(known) - 1)
    return at, known[at] == found


def classes_of(known: np.ndarray, found: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of each token and of the one before it; before a text stands an end."""
    kinds, which = kinds_of(found)
    at, is_class = place_in(known, kinds)
    own = np.where(is_class, at, len(known))[which]
    at, is_class = place_in(known, np.array([END], dtype=np.uint64))
    before = np.concatenate([[0], own[:-1]])
    before[first[:-1]] = at[0] if is_class[0] else len(known)
    return own, before


def contexts_of(found: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The token before each token; before a text stands an end."""
    before = np.concatenate([[END], found[:-1]])
    before[first[:-1]] = END
    return before


def pair_keys(before: np.ndarray, found: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + found)


@dataclass
class Model:
    """What scoring needs at hand; ``rare`` is the whole table (word, n, log_rare) for tokens beyond the lookup."""

    classes: np.ndarray
    log_p: np.ndarray  # log10 of class given class before
    lookup: np.ndarray
    lookup_n: np.ndarray
    lookup_log: np.ndarray  # log10 within the rare class
    log_unknown: float
    n: int
    v: int
    back: np.ndarray | None = None  # log10 of the weight that each class as a context leaves to the word restaurant
    pair_keys: np.ndarray | None = None
    pair_log: np.ndarray | None = None  # log10 of what a pair's customers add

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1) / (self.n + self.v + 1))


def seat_rare(table: DataFrame, n: int, v: int) -> tuple[DataFrame, float]:
    """Rows (word, n, log_rare) of rare tokens, and log10 of an unknown one, both averaged over the samples."""
    facts = table.agg(F.count("*").alias("types"), F.coalesce(F.sum("n"), F.lit(0)).alias("customers"),
                      F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")).first()
    d = discount(once=facts["once"], twice=facts["twice"])
    share = 1 / (v + 1)
    state, total, means = None, None, []

    def sweep(step: int, total: float | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                word, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                if step == 0:
                    # the number of tables follows from the dishes: each has one at least
                    weight = np.full(len(n), (STRENGTH + d * facts["types"]) * share)
                    seating, seen = Seating.even(n, start_tables(n, weight)), np.zeros(len(n), np.int64)
                else:
                    lists = batch.column(2)
                    seating = Seating(n, lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64))
                    rng = np.random.default_rng([step, int(word[0]) & 0x7FFFFFFF]) if len(word) else np.random.default_rng(step)
                    seating = seating.sweep(np.zeros(len(n), np.int64), np.array([total]), np.full(len(n), share), d, rng)
                    seen = batch.column(3).to_numpy() + (seating.tables if step > BURN_IN else 0)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), batch.column(1),
                    pa.ListArray.from_arrays(pa.array(seating.first.astype(np.int32)), pa.array(seating.sizes)), pa.array(seen)],
                    names=["word", "n", "sizes", "seen"])
        return run

    for step in range(BURN_IN + SAMPLES + 1):
        source = table.select("word", "n") if state is None else state
        state = stored(source.mapInArrow(sweep(step, total), "word long, n long, sizes array<long>, seen long"))
        total = float(state.agg(F.sum(F.size("sizes"))).first()[0] or 0)
        if step > BURN_IN:
            means.append(total)
    mean = float(np.mean(means))
    parent = (STRENGTH + d * mean) * share
    whole = STRENGTH + float(facts["customers"])
    scored = state.select("word", "n", F.log10((F.col("n") - d * F.col("seen") / SAMPLES + parent) / whole).alias("log_rare"))
    return scored, float(np.log10(parent / whole))


def class_cells(docs: DataFrame, classes: np.ndarray) -> DataFrame:
    """Rows (u, w, n) of all pairs of a token's class and the class of the one after it."""
    k = len(classes) + 1
    known = docs.sparkSession.sparkContext.broadcast(classes)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []

        def rows():
            key, where = np.unique(np.concatenate([a for a, _ in held]), return_inverse=True)
            n = np.bincount(where, np.concatenate([b for _, b in held])).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(key // k), pa.array(key % k), pa.array(n)], names=["u", "w", "n"])

        for batch in batches:
            own, before = classes_of(known.value, *tokens(batch.column(0)))
            held.append(np.unique(before * k + own, return_counts=True))
            if sum(len(a) for a, _ in held) > 4_000_000:
                yield rows()
                held = []
        if held:
            yield rows()

    return docs.mapInArrow(pairs, "u long, w long, n long")


def seat_classes(cells: DataFrame, k: int, rare_row: np.ndarray | None = None) -> np.ndarray:
    """log10 of each of ``k`` classes given each class before it, averaged over the samples, from counts (u, w, n) of their pairs, which may repeat.

    ``rare_row`` are the customers of the row *rare*, if not all tokens.
    """
    spark = cells.sparkSession
    cells = cells.groupBy("u", "w").agg(F.sum("n").alias("n"))
    if rare_row is not None:
        row = spark.createDataFrame([(k - 1, int(c), int(rare_row[c])) for c in np.flatnonzero(rare_row)], "u long, w long, n long")
        cells = cells.where(F.col("u") < k - 1).union(row)
    # a restaurant has at most CLASSES + 1 dishes
    def dishes(table: pa.Table) -> pa.Table:
        cell = table["u"].to_numpy() * k + table["w"].to_numpy()
        order = np.argsort(cell)
        u, starts = np.unique(cell[order] // k, return_index=True)
        lists = pa.StructArray.from_arrays([pa.array(cell[order] % k), pa.array(table["n"].to_numpy()[order])], ["w", "n"])
        return pa.table([pa.array(u), pa.ListArray.from_arrays(pa.array(np.append(starts, len(cell)).astype(np.int32)), lists)], names=["u", "dishes"])

    blocks = cells.select(F.pmod("u", F.lit(16)).alias("block"), "u", "w", "n")
    state = stored(blocks.groupBy("block").applyInArrow(dishes, "u long, dishes array<struct<w:long,n:long>>"))
    flat = state.select(F.explode("dishes").alias("x"))
    facts = flat.agg(F.count_if(F.col("x.n") == 1).alias("once"), F.count_if(F.col("x.n") == 2).alias("twice")).first()
    d = discount(once=facts["once"], twice=facts["twice"])
    seen = flat.groupBy("x.w").agg(F.count("*").alias("n")).toArrow()
    customers = np.zeros(k, np.int64)
    customers[seen["w"].to_numpy()] = seen["n"].to_numpy()
    parent = Seating.even(customers, np.minimum(customers, 1))
    uniform = np.full(k, 1 / k)
    parents: list[np.ndarray] = []

    def probabilities(seating: Seating) -> np.ndarray:
        total = float(seating.tables.sum())
        mass = (seating.counts - PARENT_DISCOUNT * seating.tables) + (STRENGTH + PARENT_DISCOUNT * total) / k
        return mass / (STRENGTH + seating.counts.sum())

    schema = "u long, dishes array<struct<w:long,n:long>>, sizes array<long>, tables array<long>, seen array<long>, totals array<long>"

    def sweep(step: int, p: np.ndarray):
        def one(u: int, w: np.ndarray, n: np.ndarray, sizes, tables, seen, totals):
            if step == 0:
                seating = Seating.even(n, start_tables(n, (STRENGTH + d * len(n)) * p[w]))
                return seating, np.zeros(len(n), np.int64), []
            seating = Seating(n, sizes, np.concatenate([[0], np.cumsum(tables)]))
            seating = seating.sweep(np.zeros(len(n), np.int64), np.array([tables.sum()]), p[w], d, np.random.default_rng([step, u]))
            if step > BURN_IN:
                seen, totals = seen + seating.tables, [*totals, int(seating.tables.sum())]
            return seating, seen, list(totals)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for i, u in enumerate(batch.column(0).to_pylist()):
                    dishes = batch.column(1)[i].values
                    w, n = dishes.field("w").to_numpy(), dishes.field("n").to_numpy()
                    rest = [batch.column(c)[i].values.to_numpy() for c in range(2, 6)] if step else [None] * 4
                    seating, seen, totals = one(u, w, n, *rest)
                    out.append((batch.column(1)[i:i + 1], seating.sizes, seating.tables, seen, totals))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), batch.column(1), *[pa.array([o[c] for o in out], pa.list_(pa.int64())) for c in range(1, 5)]],
                    names=["u", "dishes", "sizes", "tables", "seen", "totals"])
        return run

    for step in range(BURN_IN + SAMPLES + 1):
        p = probabilities(parent)
        last, state = state, stored(state.mapInArrow(sweep(step, p), schema))
        dropped(last)
        if step > BURN_IN:
            parents.append(p)
        own = state.select(F.explode(F.arrays_zip(F.col("dishes.w").alias("w"), F.col("tables").alias("t"))).alias("x"))
        sums = own.groupBy("x.w").agg(F.sum("x.t").alias("t")).toArrow()
        customers = np.zeros(k, np.int64)
        customers[sums["w"].to_numpy()] = sums["t"].to_numpy()
        # the parent is small, and it is seated here
        rng, one_room = np.random.default_rng(step), np.zeros(k, np.int64)
        if step == 0:
            weight = (STRENGTH + PARENT_DISCOUNT * np.count_nonzero(customers)) * uniform
            parent = Seating.even(customers, start_tables(customers, weight))
        else:
            parent = parent.follow(customers, one_room, np.array([parent.tables.sum()]), uniform, PARENT_DISCOUNT, rng)
        parent = parent.sweep(one_room, np.array([parent.tables.sum()]), uniform, PARENT_DISCOUNT, rng)
    shared = spark.sparkContext.broadcast((np.stack(parents), probabilities(parent)))

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parents, _ = shared.value
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                dishes = batch.column(1)[i].values
                w, n = dishes.field("w").to_numpy(), dishes.field("n").to_numpy()
                seen, totals = (batch.column(c)[i].values.to_numpy().astype(float) for c in (4, 5))
                row = ((STRENGTH + d * totals)[:, None] * parents).sum(axis=0) / SAMPLES
                row[w] += n - d * seen / SAMPLES
                out.append(np.log10(row / (STRENGTH + n.sum())).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["u", "row"])

    log_p = np.log10(np.tile(np.mean(parents, axis=0), (k, 1))).astype(np.float32)  # restaurants without customers
    made = state.mapInArrow(dense, "u long, row binary").toArrow()
    for u, row in zip(made["u"].to_pylist(), made["row"].to_pylist()):
        log_p[u] = np.frombuffer(row, "<f4")
    dropped(state)
    return log_p


def learn(docs: DataFrame, text: str = "text") -> tuple[Model, DataFrame]:
    """The model of all texts, and the table (word, n, log_rare) of all tokens."""
    own = bounded(docs.sparkSession) and docs.select(F.col(f"`{text}`").alias("text"))
    table = stored(counted(own))
    facts = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    floor = commonest(table, CLASSES)
    classes, class_n = sorted_words(table.where(F.col("n") >= floor), "n")
    rare, log_unknown = seat_rare(table.where(F.col("n") < floor), facts["n"], facts["v"])
    rare = stored(rare)
    words_, n, log = sorted_words(rare.where(F.col("n") >= commonest(rare, LOOKUP)), "n", "log_rare")
    lookup = np.concatenate([classes, words_])
    order = np.argsort(lookup)
    model = Model(classes, seat_classes(class_cells(own, classes), len(classes) + 1), lookup[order], np.concatenate([class_n, n])[order],
                  np.concatenate([np.zeros(len(classes)), log])[order], log_unknown, facts["n"], facts["v"])
    return model, rare


def counted_pairs(docs: DataFrame, classes: np.ndarray) -> DataFrame:
    """Rows (u, w, n, a, c) of all pairs of a token and the one after it but those of two classes; ``a`` and ``c`` are their classes."""
    k = len(classes)
    known = docs.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merged(parts):
            u, w, n, a, c = (np.concatenate(x) for x in zip(*parts))
            _, at, where = np.unique(pair_keys(u, w), return_index=True, return_inverse=True)
            return u[at], w[at], np.bincount(where, n).astype(np.int64), a[at], c[at]

        def rows(u, w, n, a, c):
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(w.view(np.int64)), pa.array(n), pa.array(a), pa.array(c)],
                                              names=["u", "w", "n", "a", "c"])

        held, waiting = [], 0
        for batch in batches:
            found, first = tokens(batch.column(0))
            own, before = classes_of(known.value, found, first)
            some = np.flatnonzero((own == k) | (before == k))
            u, w = contexts_of(found, first)[some], found[some]
            held.append(merged([(u, w, np.ones(len(some)), before[some].astype(np.int32), own[some].astype(np.int32))]))
            waiting += len(held[-1][0])
            if waiting > 2_000_000:
                held = [merged(held)]
                waiting = len(held[0][0])
                if waiting > 1_000_000:
                    yield rows(*held.pop())
                    waiting = 0
        if held:
            yield rows(*merged(held))

    return docs.mapInArrow(run, "u long, w long, n long, a int, c int").groupBy("u", "w").agg(
        F.sum("n").alias("n"), F.first("a").alias("a"), F.first("c").alias("c"))


class Near:
    """Probabilities and tables of rare tokens beside their pairs.

    Pairs whose rare tokens are among the ``LOOKUP`` commonest find them in broadcast arrays where they are used; the others, marked
    once, are joined with the rows of the other tokens, so no join has a hot key.
    """

    def __init__(self, words_: DataFrame, k: int):
        self.k, self.floor = k, commonest(words_, LOOKUP)
        self.words, = sorted_words(words_.where(F.col("n") >= self.floor))

    def marked(self, pairs: DataFrame) -> DataFrame:
        """Pairs with ``far``: whether one of their tokens has to be joined."""
        k, known = self.k, pairs.sparkSession.sparkContext.broadcast(self.words)

        def start():
            def run(u: pa.Array, w: pa.Array, a: pa.Array, c: pa.Array):
                (_, has_u), (_, has_w) = (place_in(known.value, x.to_numpy().view(np.uint64)) for x in (u, w))
                return (pa.array(((a.to_numpy() == k) & ~has_u) | ((c.to_numpy() == k) & ~has_w)),)
            return run

        return with_columns(pairs, ["u", "w", "a", "c"], [T.StructField("far", T.BooleanType())], start)

    def beside(self, pairs: DataFrame, words_: DataFrame):
        """Marked pairs with ``p`` and ``t`` where they were joined from rows (word, n, p, t), and what gives both for columns of a batch of them."""
        k = self.k
        word, p, t = sorted_words(words_.where(F.col("n") >= self.floor).select("word", "p", F.col("t").cast("double").alias("t")), "p", "t")
        known = pairs.sparkSession.sparkContext.broadcast((word, p, t))
        others = words_.where(F.col("n") < self.floor)
        far = pairs.where("far")
        for key, value in (("w", "p"), ("u", "t")):
            far = far.join(others.select(F.col("word").alias(key), F.col(value).cast("double").alias(value)), key, "left")
        near = pairs.where("NOT far").withColumns({"p": F.lit(None).cast("double"), "t": F.lit(None).cast("double")})

        def values(u, w, a, c, p, t):
            word, near_p, near_t = known.value
            out = []
            for token, is_rare, joined, near in ((w, c == k, p, near_p), (u, a == k, t, near_t)):
                at, has = place_in(word, token.view(np.uint64))
                out.append(np.where(is_rare, np.where(has, near[at] if len(word) else 0.0, joined), 1.0))
            return out

        return far.select(*pairs.columns, "p", "t").unionByName(near), values


def seat_pairs(again: DataFrame, by: pa.Table, once: int, twice: int, table: DataFrame, k: int, v: int):
    """Seats the restaurants of pairs and the word restaurant together.

    ``again`` are the marked pairs seen more than once, ``by`` how many pairs of each two classes there are (kinds), how many were seen once (ones)
    and their customers (n), ``once`` and ``twice`` how many pairs were seen so often. Gives rows (u, w, n, a, c, far, tables) of ``again`` with
    their mean tables, rows (word, n, p, t) of rare tokens with their mean probability and the mean tables after them, but of those seen once,
    their probability, that of an unknown token, customers and mean tables of classes as contexts, the last customers of the row *rare*, the
    discount, and the finder of tokens beside pairs.
    """
    d = discount(once=once, twice=twice)
    share = 1 / (v + 1)

    def roles(rows: DataFrame, *sums: str) -> DataFrame:
        """Sums by rare token, as the one that follows (w_) and as the context (u_)."""
        zero = [F.lit(0).cast("long")] * len(sums)
        own = [F.col(x) for x in sums]
        names = [*[f"w_{x}" for x in sums], *[f"u_{x}" for x in sums]]
        both = rows.where(F.col("c") == k).select(F.col("w").alias("word"), *[x.alias(m) for x, m in zip([*own, *zero], names)]).unionByName(
            rows.where(F.col("a") == k).select(F.col("u").alias("word"), *[x.alias(m) for x, m in zip([*zero, *own], names)]))
        return both.groupBy("word").agg(*[F.sum(m).alias(m) for m in names])

    def by_class(a: np.ndarray, c: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tables of each class as a context, and customers of the row *rare*."""
        return np.bincount(a[a < k], t[a < k], k), np.bincount(c[a == k], t[a == k], k + 1)

    def columns(rows: pa.Table, *names: str) -> list[np.ndarray]:
        return [rows[x].to_numpy() for x in names]

    # What is seen once has one table whatever is drawn: only words and pairs seen more often are seated.
    more = stored(table.where("n > 1").select("word", "n").join(
        roles(again.select("u", "w", "a", "c", "n", F.lit(1).cast("long").alias("kinds")), "n", "kinds"), "word", "left").fillna(0))
    # a token stands in as many pairs as it is counted, on either side; the others of its pairs were seen once
    words_ = more.select("word", "n", (F.col("n") - F.col("w_n")).alias("w_ones"), (F.col("n") - F.col("u_n")).alias("u_ones"),
                         (F.col("n") - F.col("w_n") + F.col("w_kinds")).alias("w_kinds"), (F.col("n") - F.col("u_n") + F.col("u_kinds")).alias("u_kinds"))
    ones, kinds = by_class(*columns(by, "a", "c", "ones")), by_class(*columns(by, "a", "c", "kinds"))
    class_n, _ = by_class(*columns(by, "a", "c", "n"))
    alone = table.where("n = 1").count()
    few = words_.agg(F.count_if(F.col("w_kinds") == 1).alias("once"), F.count_if(F.col("w_kinds") == 2).alias("twice"), F.count("*").alias("types")).first()
    d_word = discount(once=few["once"] + alone, twice=few["twice"])
    types = few["types"] + alone

    def seat_words(step: int, total: float):
        """Seats the word restaurant on from its last seating, as its customers, the tables below, have changed."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                word, customers = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                rng = np.random.default_rng([step, int(word[0]) & 0x7FFFFFFF]) if len(word) else np.random.default_rng(step)
                one_room, p = np.zeros(len(word), np.int64), np.full(len(word), share)
                if step == 0:
                    seating = Seating.even(customers, start_tables(customers, (STRENGTH + d_word * total) * p))
                else:
                    last = lists_seating(batch.column(6))
                    seating = last.follow(customers, one_room, np.array([total]), p, d_word, rng)
                    seating = seating.sweep(one_room, np.array([total + len(seating.sizes) - len(last.sizes)]), p, d_word, rng)
                yield pa.RecordBatch.from_arrays([*batch.columns[:6], seating_lists(seating)], names=[*names, "sizes"])
        names = ["word", "n", "customers", "t", "sum_p", "sum_t"]
        return run

    def seat(step: int, class_t: np.ndarray, row: np.ndarray, values):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                u, w, n, a, c = (batch.column(i).to_numpy() for i in range(5))
                p, total = values(u, w, a, c, *(batch.column(i).to_numpy(zero_copy_only=False) for i in (8, 9)))
                p = p * np.where(a == k, row[c], 1.0)
                total = np.where(a == k, total, np.append(class_t, 0.0)[a])
                if step == 0:
                    seating, seen = Seating.even(n, start_tables(n, (STRENGTH + d * total) * p)), np.zeros(len(n), np.int64)
                else:
                    seating = lists_seating(batch.column(6))
                    rng = np.random.default_rng([step, int(u[0]) & 0x7FFFFFFF]) if len(u) else np.random.default_rng(step)
                    _, at, restaurant = np.unique(u, return_index=True, return_inverse=True)
                    seating = seating.sweep(restaurant, total[at], p, d, rng)
                    seen = batch.column(7).to_numpy() + (seating.tables if step > BURN_IN else 0)
                yield pa.RecordBatch.from_arrays([*batch.columns[:6], seating_lists(seating), pa.array(seen)],
                                                 names=["u", "w", "n", "a", "c", "far", "sizes", "seen"])
        return run

    near = Near(words_, k)
    state = near.marked(again).select("u", "w", "n", "a", "c", "far", F.array().cast("array<long>").alias("sizes"), F.lit(0).cast("long").alias("seen"))
    class_t, row = kinds
    now = words_.select("word", "n", F.col("w_kinds").alias("customers"), F.col("u_kinds").alias("t"), F.lit(0.0).alias("sum_p"), F.lit(0).cast("long").alias("sum_t"), F.array().cast("array<long>").alias("sizes"))
    word_tables = float(types)  # those of words seen once are always theirs alone
    unknown, p_ones, class_sum = [], [], np.zeros(k)
    gone: list[DataFrame] = []  # of the sweep before
    for step in range(BURN_IN + SAMPLES + 1):
        seated_words = stored(now.mapInArrow(seat_words(step, word_tables), "word long, n long, customers long, t long, sum_p double, sum_t long, sizes array<long>"))
        now = seated_words.withColumn("s", F.size("sizes").cast("long"))
        sums = now.agg(F.coalesce(F.sum("customers"), F.lit(0)).alias("c"), F.coalesce(F.sum("s"), F.lit(0)).alias("s")).first()
        word_tables = float(sums["s"] + alone)
        mass, whole = (STRENGTH + d_word * word_tables) * share, STRENGTH + sums["c"] + alone
        p_once = (1 - d_word + mass) / whole
        now = now.withColumn("p", (F.col("customers") - d_word * F.col("s") + mass) / whole)
        smooth = (row + STRENGTH / (k + 1)) / (row.sum() + STRENGTH)
        placed, values = near.beside(state, now)
        state = stored(placed.select("u", "w", "n", "a", "c", "far", "sizes", "seen", "p", "t").mapInArrow(
            seat(step, class_t, smooth, values), "u long, w long, n long, a int, c int, far boolean, sizes array<long>, seen long"))
        dropped(*gone)
        gone = [seated_words, state]
        tables = state.select("u", "w", "a", "c", F.size("sizes").cast("long").alias("t"))
        seated = by_class(*columns(tables.groupBy("a", "c").agg(F.sum("t").alias("t")).toArrow(), "a", "c", "t"))
        class_t, row = ones[0] + seated[0], ones[1] + seated[1]
        sampled = step > BURN_IN
        if sampled:
            unknown.append(mass / whole)
            p_ones.append(p_once)
            class_sum += class_t
        new = words_.join(roles(tables, "t"), "word", "left").select(
            "word", "n", (F.col("w_ones") + F.coalesce("w_t", F.lit(0))).alias("customers"), (F.col("u_ones") + F.coalesce("u_t", F.lit(0))).alias("new_t"))
        now = new.join(now.select("word", "p", "sum_p", "sum_t", "sizes"), "word").select(
            "word", "n", "customers", F.col("new_t").alias("t"), (F.col("sum_p") + F.col("p") * float(sampled)).alias("sum_p"),
            (F.col("sum_t") + F.col("new_t") * int(sampled)).cast("long").alias("sum_t"), "sizes")
    found = stored(now.select("word", "n", (F.col("sum_p") / SAMPLES).alias("p"), (F.col("sum_t") / SAMPLES).alias("t")))
    dropped(more, seated_words)
    means = state.select("u", "w", "n", "a", "c", "far", (F.col("seen") / SAMPLES).alias("tables"))
    return means, found, float(np.mean(p_ones)), float(np.mean(unknown)), class_n, class_sum / SAMPLES, row.astype(np.int64), d, near


def pair_adds(some: DataFrame, found: DataFrame, near: Near, after_rare: np.ndarray, left: np.ndarray, d: float, once: float) -> DataFrame:
    """Rows (key, n, log_add) of marked pairs (u, w, n, a, c, far, tables): log10 of what their own customers add.

    Tokens that aren't among the rows were seen once: they have the probability ``once`` and one table after them.
    """
    k = near.k
    placed, values = near.beside(some, found)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, w, n, a, c = (batch.column(i).to_numpy() for i in range(5))
            tables, p, t = (batch.column(i).to_numpy(zero_copy_only=False) for i in (5, 6, 7))
            p, t = values(u, w, a, c, np.where(np.isnan(p), once, p), np.where(np.isnan(t), 1.0, t))
            p = p * np.where(a == k, after_rare[c], 1.0)
            weight = np.where(a == k, STRENGTH + d * t, np.append(left, 1.0)[a])
            yield pa.RecordBatch.from_arrays([pa.array(pair_keys(u.view(np.uint64), w.view(np.uint64)).view(np.int64)), pa.array(n),
                                              pa.array(np.log10(1 + (n - d * tables) / (weight * p)).astype(np.float32))], names=["key", "n", "log_add"])

    columns = placed.select("u", "w", "n", "a", "c", "tables", "p", "t")
    return columns.mapInArrow(added, "key long, n long, log_add float")


def learn_whole(docs: DataFrame, text: str = "text") -> tuple[Model, DataFrame, DataFrame]:
    """The model of all texts, the table (word, n, log_rare, log_back) of rare tokens, and the table (key, n, log_add) of all pairs with one."""
    own = bounded(docs.sparkSession) and docs.select(F.col(f"`{text}`").alias("text"))
    table = stored(counted(own))
    facts = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    floor = commonest(table, CLASSES)
    classes, class_n = sorted_words(table.where(F.col("n") >= floor), "n")
    k = len(classes)
    pairs = stored(counted_pairs(own, classes))
    by = pairs.groupBy("a", "c").agg(F.count_if(F.col("n") == 1).alias("ones"), F.sum("n").alias("n"), F.count("*").alias("kinds")).toArrow()
    facts_2 = pairs.agg(F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")).first()
    means, found, once, unknown, rare_n, class_t, row, d, near = seat_pairs(
        pairs.where("n > 1"), by, facts_2["once"], facts_2["twice"], table.where(F.col("n") < floor), k, facts["v"])
    log_p = seat_classes(class_cells(own, classes), k + 1, row)
    after_rare = 10.0 ** log_p[k].astype(float)
    left = STRENGTH + d * class_t
    means = means.unionByName(near.marked(pairs.where("n = 1")).withColumn("tables", F.lit(1.0)))

    def whole(some: DataFrame) -> DataFrame:
        return pair_adds(some, found, near, after_rare, left, d, once)

    # every rare token is the context of as many tokens as it stands there
    all_words = found.unionByName(table.where(f"n = 1 AND n < {floor}").select("word", "n", F.lit(once).alias("p"), F.lit(1.0).alias("t")))
    rare = stored(all_words.select("word", "n", F.log10("p").alias("log_rare"), F.log10((STRENGTH + d * F.col("t")) / (STRENGTH + F.col("n"))).alias("log_back")))
    words_, n, log, back = sorted_words(rare.where(F.col("n") >= commonest(rare, LOOKUP)), "n", "log_rare", "log_back")
    lookup = np.concatenate([classes, words_])
    order = np.argsort(lookup)
    keys, log_add = sorted_words(whole(means.where(F.col("n") >= commonest(pairs, PAIRS))).withColumnRenamed("key", "word"), "log_add")
    model = Model(classes, log_p, lookup[order], np.concatenate([class_n, n])[order], np.concatenate([np.zeros(k), log + back])[order],
                  float(np.log10(unknown)), facts["n"], facts["v"], np.log10(left / (STRENGTH + rare_n)), keys, log_add)
    return model, rare, whole(means)


def dealt_in_shards(docs: DataFrame, text: str, keep: list[str], learned: Column) -> tuple[DataFrame, int]:
    """Rows (kept, text, learned, shard), and how many shards there are; a shard has about ``SHARD_BYTES`` of text and follows from a row's values alone, so every pass deals alike."""
    facts = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(f"`{text}`"))), F.lit(0)).alias("bytes"), F.count("*").alias("rows")).first()
    shards = 1 + (facts["bytes"] + 64 * facts["rows"]) // SHARD_BYTES
    told = [F.col(f"`{f.name}`") for f in docs.schema.fields if f.name in {*keep, text} and isinstance(f.dataType, T.AtomicType)]
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), F.col(f"`{text}`").cast("string").alias("text"),
                       F.coalesce(learned, F.lit(False)).alias("learned"), F.pmod(F.xxhash64(*told), F.lit(shards)).cast("int").alias("shard")), shards


def told_cells(key: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of keys that stand at codes 2 * shard + learned: where each distinct key first stands, the keys, their numbers in learned texts, and
    the (key, shard) that a shard has to be told: a key seen once is known in the learned text that has it."""
    order = np.argsort(key)
    key, code = key[order], code[order]
    new = np.append(True, key[1:] != key[:-1])[:len(key)]
    starts, at = np.flatnonzero(new), np.cumsum(new) - 1
    learned = (code & 1).astype(np.int64)
    n = np.add.reduceat(learned, starts) if len(starts) else np.zeros(0, np.int64)
    tell = (n[at] > 1) | ((n[at] == 1) & (learned == 0))
    both = np.sort((at[tell] << 32) | (code[tell] >> 1))
    both = both[np.append(True, both[1:] != both[:-1])[:len(both)]]
    return order[starts], key[starts], n, both >> 32, both & 0xFFFFFFFF


def table_ratios(d: float) -> np.ndarray:
    """At [c, t]: the ways to seat c customers at t + 1 tables over those at t, for at most ``DRAWN`` customers."""
    ways = np.zeros((DRAWN + 1, DRAWN + 2))
    ways[1, 1] = 1
    t = np.arange(1, DRAWN + 1)
    for c in range(1, DRAWN):
        ways[c + 1, 1:-1] = (c - d * t) * ways[c, 1:-1] + ways[c, :-2]
    return ways[:, 1:] / np.where(ways[:, :-1] > 0, ways[:, :-1], 1.0)


def draw_tables(c: np.ndarray, others: np.ndarray, parent: np.ndarray, d: float, ratios: np.ndarray, rng: np.random.Generator,
                strength: float = STRENGTH) -> np.ndarray:
    """The number of tables of dishes with 1 to ``DRAWN`` customers, drawn given the ``others`` of their restaurants, all customers at once."""
    tables = np.ones(len(c), np.int64)
    order = np.argsort(c.astype(np.uint8), kind="stable")
    bounds = np.searchsorted(c[order], np.arange(DRAWN + 2))
    for n in range(2, DRAWN + 1):
        here = order[bounds[n]:bounds[n + 1]]
        if not len(here):
            continue
        weight = (strength + d * others[here])[:, None] + d * np.arange(1, n)
        weight *= parent[here][:, None] * ratios[n, 1:n]
        upto = np.cumsum(np.cumprod(weight, axis=1), axis=1) + 1
        draw = rng.random(len(here)) * upto[:, -1]
        tables[here] += (draw >= 1) + (draw[:, None] >= upto[:, :-1]).sum(axis=1)
    return tables


def pair_places(docs: DataFrame, classes: np.ndarray, parts: int) -> DataFrame:
    """Rows (part, home, side, far, code) of arrays: the pairs with a rare token as they stand in the texts, by the part of their home.

    Home is the rare token, of two the first, and ``far`` the second. ``side`` tells the other's class: a class before the home, ``AFTER``
    and a class after it, or ``RARE``. ``code`` is 2 * shard + learned. Parts from ``parts`` on hold pairs of a class and what follows, with their numbers.
    """
    k = len(classes)
    known = docs.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cells, waiting = [], [], 0

        def rows():
            home, side, far, code = (np.concatenate(x) for x in zip(*held))
            part = part_of(home, parts)
            order, bounds = by_part(part, parts)
            both = order[side[order] == RARE]
            far_bounds = np.append(0, np.cumsum(np.bincount(part[both], minlength=parts)))
            yield [pa.array(np.arange(parts, dtype=np.int32)), blobs(home[order], bounds), blobs(side[order], bounds), blobs(far[both], far_bounds), blobs(code[order], bounds)]
            cell, n = np.unique(np.concatenate(cells), return_counts=True)
            n = n.astype(np.int32)
            bounds = np.searchsorted(cell, np.arange(CELL_PARTS + 1) * (k // CELL_PARTS + 1) * (k + 1))
            none = blobs(np.zeros(0, np.uint16), np.zeros(CELL_PARTS + 1, np.int64))
            yield [pa.array(np.arange(parts, parts + CELL_PARTS, dtype=np.int32)), blobs(cell, bounds), none, none, blobs(n, bounds)]

        def flushed():
            for columns in rows():
                yield pa.RecordBatch.from_arrays(columns, names=["part", "home", "side", "far", "code"])

        for batch in batches:
            found, first = tokens(batch.column(0))
            own, before = classes_of(known.value, found, first)
            learned = batch.column(1).to_numpy(zero_copy_only=False)
            code = np.repeat((2 * batch.column(2).to_numpy() + learned).astype(np.int32), np.diff(first))
            some = np.flatnonzero((own == k) | (before == k))
            u, w, a, c = contexts_of(found, first)[some], found[some], before[some], own[some]
            held.append((np.where(a < k, w, u), np.where(a < k, a, np.where(c < k, AFTER + c, RARE)).astype(np.uint16), w, code[some]))
            cells.append((before * (k + 1) + own)[(code & 1 == 1) & (before < k)])
            waiting += len(found)
            if waiting > 3_500_000:
                yield from flushed()
                held, cells, waiting = [], [], 0
        if held:
            yield from flushed()

    return docs.select("text", "learned", "shard").mapInArrow(run, "part int, home binary, side binary, far binary, code binary")


#: What the tables of the passes over parts hold: a part's state, or what is sent to another part's word, or numbers for the driver.
PASSED = "part int, word long, sender int, n long, m long, raw double, stat array<double>, data binary, places binary"
AFTER, RARE, CELL_PARTS = 1 << 14, 1 << 15, 16


def packed(**arrays: np.ndarray) -> bytes:
    """Arrays by name as bytes; integers that fit are stored in four bytes."""
    def short(x: np.ndarray) -> np.ndarray:
        return x.astype(np.int32) if x.dtype == np.int64 and (not len(x) or -1 << 31 <= x.min() and x.max() < 1 << 31) else x
    return pickle.dumps({name: short(x) for name, x in arrays.items()}, protocol=5)


def passed_rows(rows: int, **columns) -> pa.Table:
    """Rows of ``PASSED``; columns not given are null."""
    fields = [("part", pa.int32()), ("word", pa.int64()), ("sender", pa.int32()), ("n", pa.int64()), ("m", pa.int64()), ("raw", pa.float64()),
              ("stat", pa.list_(pa.float64())), ("data", pa.binary()), ("places", pa.binary())]
    return pa.table([pa.array(columns[f], kind) if f in columns else pa.nulls(rows, kind) for f, kind in fields], names=[f for f, _ in fields])


def state_of(table: pa.Table) -> tuple[dict[str, np.ndarray], pa.Table]:
    """A part's state, as arrays that aren't to be changed, and what was sent to it."""
    own = table["data"].is_valid()
    data = table["data"].filter(own)
    return pickle.loads(data[0].as_buffer()), table.drop_columns(["data"]).filter(pa.compute.invert(own))


def state_rows(state: dict[str, np.ndarray], part: int, stat: np.ndarray | list[float]) -> pa.Table:
    return passed_rows(1, part=[part], stat=[np.asarray(stat, float)], data=[packed(**state)])


def counted_parts(places: DataFrame, classes: np.ndarray, parts: int, lookup_floor: int) -> DataFrame:
    """Rows of ``PASSED``: each part's words and pairs seen more than once, with the shards to be told of them; what pairs of two rare tokens
    give the second; rows of class cells, with part -2. A part's numbers: for each side, its pairs seen once, all its pairs and their customers;
    pairs seen twice."""
    k = len(classes)
    known = places.sparkSession.sparkContext.broadcast(classes)

    def run(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()

        def column(name: str, kind) -> np.ndarray:
            return np.frombuffer(b"".join(table[name].to_pylist()), kind)

        if part >= parts:
            cell, where = kinds_of(column("home", np.int64))
            n = np.bincount(where, column("code", np.int32), len(cell)).astype(np.int64)
            return passed_rows(len(cell), part=np.full(len(cell), -2, np.int32), sender=(cell // (k + 1)).astype(np.int32), word=cell % (k + 1), n=n)
        home, side, code = column("home", np.uint64), column("side", np.uint16).astype(np.int64), column("code", np.int32).astype(np.int64)
        far = np.zeros(len(home), np.uint64)
        far[side == RARE] = column("far", np.uint64)
        classes = np.append(known.value, np.uint64(0))
        u = np.where(side < AFTER, classes[np.minimum(side, k)], home)
        w = np.where(side < AFTER, home, np.where(side < RARE, classes[np.clip(side - AFTER, 0, k)], far))
        at, key, n, cell, shard = told_cells(pair_keys(u, w), code)
        numbers = [np.bincount(np.where(side[at] < AFTER, side[at], np.where(side[at] < RARE, k + side[at] - AFTER, 2 * k))[n > 0], x[n > 0], 2 * k + 1)
                   for x in (n == 1, n > 0, n)]
        again = np.flatnonzero(n > 1)
        alone = n[cell] == 1
        place_of = np.cumsum(n > 1) - 1
        # a rare token stands once as a context for every time it stands in a text, and its home is here
        first = np.flatnonzero(side >= AFTER)
        _, word, word_n, word_cell, word_shard = told_cells(home[first], code[first])
        beyond = word_n[word_cell] < lookup_floor
        one = beyond & (word_n[word_cell] == 1)
        more = word_n > 1
        word_of = np.cumsum(more) - 1
        places = packed(pair=place_of[cell[~alone]].astype(np.int32), shard=shard[~alone].astype(np.int32), once=key[cell[alone]], once_shard=shard[alone].astype(np.int32),
                        word=word_of[word_cell[beyond & ~one]].astype(np.int32), word_shard=word_shard[beyond & ~one].astype(np.int32),
                        word_once=word[word_cell[one]], word_once_shard=word_shard[one].astype(np.int32), key=key[again])
        word, word_n = word[more], word_n[more]
        at, n = at[again], n[again]
        side, far, home = side[at], far[at], np.searchsorted(word, home[at])
        rare, other = kinds_of(far[side == RARE])  # ``other``: which of these a pair of two rare tokens has second
        before, after = side < AFTER, side >= AFTER
        state = dict(
            word=word, word_n=word_n, side=side.astype(np.uint16), home=home.astype(np.int32), n=n.astype(np.int32), other=other.astype(np.int32), rare=rare,
            w_ones=word_n - np.bincount(home[before], n[before], len(word)).astype(np.int64), w_kinds=np.bincount(home[before], minlength=len(word)),
            u_ones=word_n - np.bincount(home[after], n[after], len(word)).astype(np.int64))
        sent = passed_rows(len(rare), part=part_of(rare, parts).astype(np.int32), word=rare.view(np.int64), sender=np.full(len(rare), part, np.int32),
                           n=np.bincount(other, n[side == RARE], len(rare)).astype(np.int64), m=np.bincount(other, minlength=len(rare)))
        own = passed_rows(1, part=[part], stat=[np.concatenate([*numbers, [(n == 2).sum()]])], data=[packed(**state)], places=[places])
        times = np.unique(n, return_counts=True)  # how many pairs were seen so often, as part -3
        return pa.concat_tables([own, sent, passed_rows(len(times[0]), part=np.full(len(times[0]), -3, np.int32), n=times[0], m=times[1])])

    # as many tasks as parts, so that a task's share doesn't grow with the texts
    return stored(places.repartition(parts, "part").groupBy("part").applyInArrow(run, PASSED), dictionary=False)


def summed(passed: DataFrame, size: int) -> np.ndarray:
    """The sum of all parts' ``size`` numbers."""
    def run(table: pa.Table) -> pa.Table:
        return pa.table([pa.array([np.sum([np.asarray(x) for x in table["stat"].to_pylist()], axis=0)], pa.list_(pa.float64()))], names=["stat"])

    some = passed.where("stat IS NOT NULL").select(F.pmod("part", F.lit(8)).alias("part"), "stat")
    rows = some.groupBy("part").applyInArrow(run, "stat array<double>").collect()
    return np.sum([np.zeros(size), *[r["stat"] for r in rows]], axis=0)


class Parts:
    """The restaurants of pairs and the word restaurant, seated together part by part.

    A part holds rare tokens and the pairs whose home they are; what a pair of two rare tokens and its second need of each other is sent.
    """

    def __init__(self, counted: DataFrame, k: int, parts: int, alone: int, v: int):
        self.table, self.k, self.parts, self.alone, self.share = counted, k, parts, alone, 1 / (v + 1)
        numbers = summed(counted, 3 * (2 * k + 1) + 1)
        self.ones, kinds, customers = (numbers[i * (2 * k + 1):(i + 1) * (2 * k + 1)] for i in range(3))
        self.rare_n = customers[:k].astype(np.int64)
        self.d = discount(once=self.ones.sum(), twice=numbers[-1])
        self.class_t, self.row = kinds[:k], kinds[k:]

    def passed(self, run, size: int) -> np.ndarray:
        """Replace each part's state by what ``run`` makes of it and of what was sent to it; gives the sum of the parts' ``size`` numbers."""
        def one(table: pa.Table) -> pa.Table:
            state, sent = state_of(table)
            return run(table["part"][0].as_py(), state, sent)

        last = self.table
        self.table = stored(last.where("part >= 0").select(*[F.col(c) for c in last.columns if c not in ("stat", "places")]).groupBy("part").applyInArrow(one, PASSED), dictionary=False)
        if last is not self.counted:
            dropped(last)
        return summed(self.table, size)

    def seat(self) -> None:
        """All sweeps; leaves the mean probabilities of what is in no table, and those of the others in the states."""
        k, parts, d, share = self.k, self.parts, self.d, self.share
        self.counted = self.table
        ratios = table_ratios(d)

        def begin(part: int, s: dict, sent: pa.Table) -> pa.Table:
            at = np.searchsorted(s["word"], sent["word"].to_numpy().view(np.uint64))
            n, m = (np.bincount(at, sent[c].to_numpy(), len(s["word"])).astype(np.int64) for c in ("n", "m"))
            s["w_ones"] = s["w_ones"] - n
            s["asks"], s["asked_by"] = at.astype(np.int32), sent["sender"].to_numpy()
            kinds = s.pop("w_kinds") + m + s["w_ones"]
            s["customers"] = kinds
            return state_rows(s, part, [len(kinds), (kinds == 1).sum(), (kinds == 2).sum()])

        types, once, twice = self.passed(begin, 3)
        d_word = discount(once=once + self.alone, twice=twice)
        word_ratios = table_ratios(d_word)
        alone, sampled = self.alone, range(BURN_IN + 1, BURN_IN + SAMPLES + 1)

        def seat_words(step: int, total: float):
            def run(part: int, s: dict, sent: pa.Table) -> pa.Table:
                rng = np.random.default_rng([step, 1, part])
                p = np.full(len(s["word"]), share)
                if step == 0:
                    customers = s["customers"].astype(np.int64)
                    tables = start_tables(customers, (STRENGTH + d_word * total) * p)
                    large = customers > DRAWN
                    seating = Seating.even(customers[large], tables[large])
                else:
                    at = np.searchsorted(s["word"], sent["word"].to_numpy().view(np.uint64))
                    before = s["side"] < AFTER
                    customers = s["w_ones"] + np.bincount(at, sent["n"].to_numpy(), len(p)).astype(np.int64) + np.bincount(
                        s["home"][before], s["tables"][before], len(p)).astype(np.int64)
                    last, large = s["word_tables"].astype(np.int64), customers > DRAWN
                    tables = np.ones(len(p), np.int64)
                    few = np.flatnonzero(~large)
                    tables[few] = draw_tables(customers[few], total - last[few], p[few], d_word, word_ratios, rng)
                    seating = grown(s["customers"].astype(np.int64), last, s["word_sizes"], large)
                    one_room, m = np.zeros(int(large.sum()), np.int64), len(seating.sizes)
                    seating = seating.follow(customers[large], one_room, np.array([total]), p[large], d_word, rng)
                    seating = seating.sweep(one_room, np.array([total + len(seating.sizes) - m]), p[large], d_word, rng)
                    tables[large] = seating.tables
                s |= dict(customers=customers, word_tables=tables, word_sizes=seating.sizes)
                raw = (customers - d_word * tables)[s["asks"]]
                asked = s["asks"]
                replies = passed_rows(len(asked), part=s["asked_by"], word=s["word"][asked].view(np.int64), raw=raw)
                return pa.concat_tables([state_rows(s, part, [customers.sum(), tables.sum()]), replies])
            return run

        def grown(customers: np.ndarray, tables: np.ndarray, sizes: np.ndarray, large: np.ndarray) -> Seating:
            """The seating of the ``large`` dishes before they change; of those that had few customers only the number of tables is kept."""
            even = Seating.even(customers[large], tables[large])
            held = np.repeat(customers[large] > DRAWN, tables[large])
            even.sizes[held] = sizes[np.repeat(large[customers > DRAWN], tables[customers > DRAWN])]
            return even

        def seat_pairs(step: int, class_t: np.ndarray, row: np.ndarray, mass: float, whole: float):
            def run(part: int, s: dict, sent: pa.Table) -> pa.Table:
                rng = np.random.default_rng([step, 2, part])
                n, side, home = s["n"].astype(np.int64), s["side"].astype(np.int64), s["home"]
                p_word = (s["customers"] - d_word * s["word_tables"] + mass) / whole
                before, after, both = side < AFTER, side >= AFTER, side == RARE
                if step == 0:
                    u_t = s["u_ones"] + np.bincount(home[after], minlength=len(p_word))
                else:
                    u_t = s["u_ones"] + np.bincount(home[after], s["tables"][after], len(p_word))
                total = np.where(before, np.append(class_t, 0.0)[np.minimum(side, k)], u_t[home])
                p = np.where(before, p_word[home], row[np.where(both, k, np.clip(side - AFTER, 0, k))])
                raw = np.zeros(len(s["rare"]))
                raw[np.searchsorted(s["rare"], sent["word"].to_numpy().view(np.uint64))] = sent["raw"].to_numpy()
                p[both] *= (raw[s["other"]] + mass) / whole
                large = n > DRAWN
                if step == 0:
                    tables = start_tables(n, (STRENGTH + d * total) * p)
                    seating = Seating.even(n[large], tables[large])
                    s |= dict(seen=np.zeros(len(n), np.int32), sum_p=np.zeros(len(p_word)), sum_t=np.zeros(len(p_word), np.int64))
                else:
                    tables = np.ones(len(n), np.int64)
                    few = np.flatnonzero(~large)
                    tables[few] = draw_tables(n[few], total[few] - s["tables"][few], p[few], d, ratios, rng)
                    room = np.where(before, side, k + home)[large]
                    _, at, room = np.unique(room, return_index=True, return_inverse=True)
                    held = Seating(n[large], s["sizes"].astype(np.int64), np.append(0, np.cumsum(s["tables"][large])).astype(np.int64))
                    seating = held.sweep(room, total[large][at], p[large], d, rng)
                    tables[large] = seating.tables
                u_t = s["u_ones"] + np.bincount(home[after], tables[after], len(p_word)).astype(np.int64)
                s |= dict(tables=tables.astype(np.int32), sizes=seating.sizes)
                if step in sampled:
                    s |= dict(seen=s["seen"] + s["tables"], sum_p=s["sum_p"] + p_word, sum_t=s["sum_t"] + u_t)
                given = np.bincount(s["other"], tables[both], len(s["rare"])).astype(np.int64)
                out = passed_rows(len(given), part=part_of(s["rare"], parts).astype(np.int32), word=s["rare"].view(np.int64), n=given)
                numbers = np.bincount(np.where(before, side, np.where(both, 2 * k, k + side - AFTER)), tables, 2 * k + 1)
                return pa.concat_tables([state_rows(s, part, numbers), out])
            return run

        def tell(part: int, s: dict, sent: pa.Table) -> pa.Table:
            asked = s["asks"]
            replies = passed_rows(len(asked), part=s["asked_by"], word=s["word"][asked].view(np.int64), raw=s["sum_p"][asked] / SAMPLES)
            return pa.concat_tables([state_rows(s, part, []), replies])

        word_tables = float(types + alone)  # those of words seen once are always theirs alone
        once, unknown, class_sum = [], [], np.zeros(k)
        for step in range(BURN_IN + SAMPLES + 1):
            customers, seated = self.passed(seat_words(step, word_tables), 2)
            word_tables = float(seated + alone)
            mass, whole = (STRENGTH + d_word * word_tables) * share, STRENGTH + customers + alone
            smooth = (self.row + STRENGTH / (k + 1)) / (self.row.sum() + STRENGTH)
            numbers = self.ones + self.passed(seat_pairs(step, self.class_t, smooth, mass, whole), 2 * k + 1)
            self.class_t, self.row = numbers[:k], numbers[k:]
            if step in sampled:
                unknown.append(mass / whole)
                once.append((1 - d_word + mass) / whole)
                class_sum += self.class_t
        self.passed(tell, 0)
        self.once, self.unknown, self.class_sum = float(np.mean(once)), float(np.mean(unknown)), class_sum / SAMPLES

    def told(self, after_rare: np.ndarray, left: np.ndarray, lookup_floor: int, pair_floor: int) -> DataFrame:
        """Rows (shard, key, log_add, word, n, p, t) of arrays: what a shard is told of pairs and words; what all are told has shard -1.

        Pairs and words seen once have no number: NaN.
        """
        k, d, once = self.k, self.d, self.once
        names = ["shard", "key", "log_add", "word", "n", "p", "t"]

        def run(table: pa.Table, places: pa.Table) -> pa.Table:
            s, sent = state_of(table)
            at = pickle.loads(places["places"][0].as_py())
            n, side, home = s["n"].astype(np.int64), s["side"].astype(np.int64), s["home"]
            before, both = side < AFTER, side == RARE
            p_word, t_word = s["sum_p"] / SAMPLES, s["sum_t"] / SAMPLES
            p = np.where(before, p_word[home], after_rare[np.where(both, k, np.clip(side - AFTER, 0, k))])
            raw = np.zeros(len(s["rare"]))
            raw[np.searchsorted(s["rare"], sent["word"].to_numpy().view(np.uint64))] = sent["raw"].to_numpy()
            p[both] *= raw[s["other"]]
            weight = np.where(before, np.append(left, 0.0)[np.minimum(side, k)], STRENGTH + d * t_word[home])
            add = np.log10(1 + (n - d * s["seen"] / SAMPLES) / (weight * p)).astype(np.float32)
            all_pairs, all_words = np.flatnonzero(n >= pair_floor), np.flatnonzero(s["word_n"] >= lookup_floor)
            some = n[at["pair"]] < pair_floor
            pair, word = at["pair"][some], at["word"]
            shard = np.concatenate([at["shard"][some], at["once_shard"], np.full(len(all_pairs), -1, np.int32)])
            key = np.concatenate([at["key"][pair], at["once"], at["key"][all_pairs]])
            log_add = np.concatenate([add[pair], np.full(len(at["once"]), np.nan, np.float32), add[all_pairs]])
            word_shard = np.concatenate([at["word_shard"], at["word_once_shard"], np.full(len(all_words), -1, np.int32)])
            words_ = np.concatenate([s["word"][word], at["word_once"], s["word"][all_words]])
            alone = np.ones(len(at["word_once"]))
            values = [np.concatenate([x[word], alone * y, x[all_words]]) for x, y in ((s["word_n"].astype(float), 1.0), (p_word, once), (t_word, 1.0))]
            shards = np.unique(np.concatenate([shard, word_shard]))
            out = [pa.array(shards)]
            for where, arrays in ((shard, (key, log_add)), (word_shard, (words_, *values))):
                order = np.argsort(where, kind="stable")
                bounds = np.searchsorted(where[order], np.append(shards, np.iinfo(np.int32).max))
                for x in arrays:
                    out.append(pa.Array.from_buffers(pa.binary(), len(shards), [None, pa.py_buffer((bounds * x.itemsize).astype(np.int32)), pa.py_buffer(x[order])]))
            return pa.table(out, names=names)

        states = self.table.where("part >= 0").select("part", "word", "raw", "data")
        own = self.counted.where("places IS NOT NULL").select("part", "places")
        return stored(states.groupBy("part").cogroup(own.groupBy("part")).applyInArrow(
            run, "shard int, key binary, log_add binary, word binary, n binary, p binary, t binary"), dictionary=False)


def unpacked(told: pa.Table, *columns: str) -> list[np.ndarray]:
    """Arrays of the columns of ``Parts.told``, ordered by the first."""
    kinds = {"key": np.uint64, "word": np.uint64, "log_add": np.float32, "n": float, "p": float, "t": float}
    out = [np.frombuffer(b"".join(told[c].to_pylist()), kinds[c]) for c in columns]
    order = np.argsort(out[0])
    return [x[order] for x in out]


def learn_and_score(docs: DataFrame, learned: Column, keep: list[str], text: str = "text") -> tuple[DataFrame, int]:
    """``score`` of all texts by the model of ``learn_whole`` of those where ``learned``, and how many tokens were learned.

    A table of all pairs is made nowhere: shards of texts are told which of their pairs were seen more than once, so a text's other pairs
    were seen once if it was learned, and what such a pair adds follows from its two tokens. Texts, parts of pairs and shards exchange arrays.
    """
    keep = [c for c in keep if c.lower() not in ("n_tokens", "n_known", "base_score", "score")]
    spark = bounded(docs.sparkSession)
    with shuffles_dropped(spark):
        dealt, shards = dealt_in_shards(docs, text, keep, learned)
        table = stored(counted(dealt.where("learned").select("text"), max(64, shards // 8)))
        facts = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
        floor = commonest(table, CLASSES)
        classes, class_n = sorted_words(table.where(F.col("n") >= floor), "n")
        k = len(classes)
        rare = table.where(F.col("n") < floor)
        lookup_floor = max(2, commonest(rare, LOOKUP))
        alone = rare.where("n = 1").count()
        parts = max(MIN_PARTS, 1 + facts["n"] // 1_500_000)
        counted_ = counted_parts(pair_places(dealt, classes, parts), classes, parts, lookup_floor)
        dropped(table)
        pair_floor = max(2, commonest(counted_.where("part = -3").groupBy("n").agg(F.sum("m").alias("m")), PAIRS, "m"))
        all_parts = Parts(counted_, k, parts, alone, facts["v"])
        all_parts.seat()
        log_p = seat_classes(counted_.where("part = -2").select(F.col("sender").cast("long").alias("u"), F.col("word").alias("w"), "n"), k + 1, all_parts.row.astype(np.int64))
        d, once, unknown = all_parts.d, all_parts.once, all_parts.unknown
        after_rare = 10.0 ** log_p[k].astype(float)
        left = STRENGTH + d * all_parts.class_sum
        told = all_parts.told(after_rare, left, lookup_floor, pair_floor)
        dropped(counted_, all_parts.table)
        everywhere = told.where("shard < 0").toArrow()
    common, common_add = unpacked(everywhere, "key", "log_add")
    word, n, p, t = unpacked(everywhere, "word", "n", "p", "t")
    back = np.log10(left / (STRENGTH + all_parts.rare_n))
    shared = spark.sparkContext.broadcast((classes, class_n, common, common_add, word, n, p, t))

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        classes, class_n, common, common_add, *lookup = shared.value
        found, first = tokens(docs["text"].combine_chunks())
        own, before = classes_of(classes, found, first)
        rows = docs.num_rows
        owner = np.repeat(np.arange(rows), np.diff(first))
        is_learned = docs["learned"].to_numpy()[owner]
        kinds, which = kinds_of(found)
        n, p, t, is_told = (np.zeros(len(kinds)) for _ in range(4))
        for words_, *values in ((classes, class_n), lookup, unpacked(told, "word", "n", "p", "t")):
            at, has = place_in(words_, kinds)
            is_told[has] = 1
            for out, value in zip((n, p, t), values):
                out[has] = value[at[has]]
        n, p, t = n[which], p[which], t[which]
        alone = np.flatnonzero((is_told[which] == 0) & is_learned)  # a learned token that a shard isn't told of
        n[alone], p[alone], t[alone] = 1.0, once, 1.0
        base = np.log10((n + 1) / (facts["n"] + facts["v"] + 1))
        log = log_p[before, own].astype(float)
        after, under, is_known = own == k, before == k, n > 0
        some = np.flatnonzero(after)
        log[some] += np.log10(np.where(is_known[some], p[some], unknown)) + np.append(back, 0.0)[before[some]]
        context = np.arange(len(found)) - 1
        context[first[:-1]] = first[1:] - 1  # the end that stands before a text is like its own
        some = np.flatnonzero(under)
        some = some[is_known[context[some]]]
        log[some] += np.log10((STRENGTH + d * t[context[some]]) / (STRENGTH + n[context[some]]))
        some = np.flatnonzero(after | under)
        add, pairs = np.full(len(some), np.nan), pair_keys(contexts_of(found, first)[some], found[some])
        key, log_add = unpacked(told, "key", "log_add")
        at, is_told = place_in(key, pairs)
        add[is_told] = log_add[at[is_told]]
        others = np.flatnonzero(~is_told)
        at, has = place_in(common, pairs[others])
        add[others[has]] = common_add[at[has]]
        one = np.isnan(add) & (is_told | is_learned[some])
        one, some_one = np.flatnonzero(one), some[one]
        weight = np.where(under[some_one], STRENGTH + d * t[context[some_one]], np.append(left, 1.0)[before[some_one]])
        add[one] = np.log10(1 + (1 - d) / (weight * np.where(after[some_one], p[some_one], 1.0) * np.where(under[some_one], after_rare[own[some_one]], 1.0)))
        log[some] += np.nan_to_num(add)
        sums = [np.diff(first), np.bincount(owner, is_known, rows).astype(np.int64), np.bincount(owner, base, rows), np.bincount(owner, log, rows)]
        return pa.table([docs["kept"], *[pa.array(x) for x in sums]], names=["kept", "n_tokens", "n_known", "base_score", "score"])

    schema = T.StructType([dealt.schema["kept"], T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
                           T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    scored = dealt.groupBy("shard").cogroup(told.where("shard >= 0").groupBy("shard")).applyInArrow(run, schema)
    return scored.select("kept.*", "n_tokens", "n_known", "base_score", "score"), facts["n"]


def score(docs: DataFrame, model: Model, rare: DataFrame, keep: list[str], text: str = "text", pairs: DataFrame | None = None) -> DataFrame:
    """Columns ``keep`` with n_tokens, n_known, base_score and score (log10 of the text's probability), one row per input row.

    Of ``keep``, columns named like these four (in any case) are replaced. ``pairs`` belong to a model of ``learn_whole``.
    """
    keep = [c for c in keep if c.lower() not in ("n_tokens", "n_known", "base_score", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        m = shared.value
        k = len(m.classes)

        def run(texts: pa.Array):
            found, first = tokens(texts)
            n = len(texts)
            owner = np.repeat(np.arange(n), np.diff(first))
            own, before = classes_of(m.classes, found, first)
            at, known = place_in(m.lookup, found)
            is_rare = own == k
            log = m.log_p[before, own].astype(float)
            if len(m.lookup):
                log += np.where(known & is_rare, m.lookup_log[at], 0.0)
                base = np.where(known, m.base(m.lookup_n[at]), 0.0)
            else:
                base = np.zeros(len(found))
            if model_has_pairs:
                log += np.where((before < k) & is_rare, np.append(m.back, 0.0)[before], 0.0)
                some = np.flatnonzero(is_rare | (before == k))
                keys = pair_keys(contexts_of(found, first)[some], found[some])
                at, held = place_in(m.pair_keys, keys)
                if len(m.pair_keys):
                    log[some] += np.where(held, m.pair_log[at], 0.0)
                far = distinct(keys[~held], owner[some[~held]], n)
            else:
                far = distinct(found[:0], owner[:0], n)
            return (pa.array(np.diff(first)), pa.array(np.bincount(owner, known, n).astype(np.int64)), pa.array(np.bincount(owner, base, n)),
                    pa.array(np.bincount(owner, log, n)), distinct(found[~known], owner[~known], n), far)

        return run

    model_has_pairs = pairs is not None

    def distinct(key: np.ndarray, text: np.ndarray, n: int) -> pa.Array:
        """The distinct keys of each of ``n`` texts and how often they stand there."""
        order = np.lexsort((key, text))
        key, text = key[order], text[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
        starts = np.flatnonzero(new)
        times = np.diff(np.append(starts, len(order)))
        offsets = pa.array(np.searchsorted(text[starts], np.arange(n + 1)).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(key[starts].view(np.int64)), pa.array(times)], ["word", "times"]))

    rest_type = T.ArrayType(T.StructType([T.StructField("word", T.LongType()), T.StructField("times", T.LongType())]))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), F.col(f"`{text}`").alias("text"))
    read = with_columns(own, ["text"], [
        T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()),
        T.StructField("score", T.DoubleType()), T.StructField("rest", rest_type), T.StructField("far", rest_type)], start, drop=["text"])
    read = stored(read.withColumn("row", F.monotonically_increasing_id()))

    def base(count: Column) -> Column:
        return F.log10((count + 1) / F.lit(float(model.n + model.v + 1)))

    count = F.coalesce("n", F.lit(0))
    log = F.coalesce(F.col("log_rare") + F.col("log_back") if pairs is not None else F.col("log_rare"), F.lit(model.log_unknown))
    parts = read.select("row", F.inline("rest")).join(rare, "word", "left").select(
        "row", F.when(count > 0, F.col("times")).otherwise(0).alias("known"), (F.col("times") * base(count)).alias("base"),
        (F.col("times") * log).alias("log"))
    if pairs is not None:
        parts = parts.unionByName(read.select("row", F.inline("far")).join(pairs.select(F.col("key").alias("word"), "log_add"), "word").select(
            "row", F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("base"), (F.col("times") * F.col("log_add")).alias("log")))
    more = parts.groupBy("row").agg(F.sum("known").alias("m_known"), F.sum("base").alias("m_base"), F.sum("log").alias("m_score"))
    whole = read.drop("rest", "far").join(more, "row", "left")
    return whole.select("kept.*", "n_tokens", (F.col("n_known") + F.coalesce("m_known", F.lit(0))).alias("n_known"),
                        (F.col("base_score") + F.coalesce("m_base", F.lit(0.0))).alias("base_score"),
                        (F.col("score") + F.coalesce("m_score", F.lit(0.0))).alias("score"))
