"""Near-duplicate documents by SuperMinHash: signatures, banding, exact verification on full sets, and grouping.

1. Every text gets its shingle set's size, a 128-bit digest of the set, and a signature; equal sets collapse to one node,
   the least id that has the set.
2. Nodes that share a band of four slots are candidates. At the threshold of 0.8 a pair shares none of 32 bands once in
   some twenty million times.
3. In each bucket all nodes are compared with one pivot, the node with most company over all its buckets. Pairs whose
   signatures agree in too few slots are dropped (five standard deviations below the threshold), the others are verified
   on the full sets.
4. Where a bucket still holds several components, pairs across components are compared by signature, in blocks of
   bounded size, each pair in the first bucket it shares; those that pass are verified on the full sets. So no link is
   lost to the choice of pivots, and a group of many copies costs one comparison a member.
5. Links are grouped by connected components.

Cases: null ids and texts without words are linked with nothing; a text of fewer words than a shingle is one shingle;
equal texts are in one component; rows that share an id are one node, so their texts' components are joined; the result
has one row per input row; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import bounded, with_columns
from .components import components
from .stored import stored
from .superminhash import BANDS, SLOTS, bands, shingles, short, signatures
from .words import mix

#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Slots that must agree before a pair is verified: 0.8 less five standard deviations of an estimate from 128 slots.
LEAST_SLOTS = int(SLOTS * (0.8 - 5 * (0.8 * 0.2 / SLOTS) ** 0.5))
#: Nodes of a block when a bucket is compared within itself.
BLOCK = 1024
#: Up to so many ids are broadcast to pick texts; beyond, texts and ids are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def digests(elements: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set, independent of order."""
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(elements ^ np.uint64(salt)), dtype=np.uint64)])
        out.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
    return out[0], out[1]


def binary(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    rows = np.ascontiguousarray(rows)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * (rows.shape[1] * rows.itemsize)
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def matrix(column: pa.Array) -> np.ndarray:
    """Signatures back from binary values of equal length."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), SLOTS)


def profiles(docs: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """Rows (doc_id, n_shingles, k1, k2, signature) of all documents."""

    def run(texts: pa.Array):
        elements, first = shingles(texts, size)
        k1, k2 = digests(elements, first)
        return pa.array(np.diff(first)), pa.array(k1), pa.array(k2), binary(short(signatures(elements, first)))

    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return with_columns(own, ["text"], [
        T.StructField("n_shingles", T.LongType()), T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()),
        T.StructField("signature", T.BinaryType())], lambda: run, drop=["text"])


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Consecutive rows with equal first ``keys`` columns (integers), one table a group."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch]).combine_chunks()
        change = np.zeros(max(table.num_rows - 1, 0), dtype=bool)
        for i in range(keys):
            value = table.column(i).to_numpy()
            change |= value[1:] != value[:-1]
        starts = [0, *(np.flatnonzero(change) + 1).tolist()]
        for a, b in zip(starts[:-1], starts[1:]):
            yield table.slice(a, b - a)
        held = table.slice(starts[-1])
    if held is not None and held.num_rows:
        yield held


def by_group(df: DataFrame, keys: Sequence[str], f: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``f`` over each group of bounded size; groups are dealt by their keys and read in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, len(keys)):
            made = f(group)
            if made is not None and made.num_rows:
                yield made

    bounded(df.sparkSession)
    rest = [c for c in df.columns if c not in keys]
    return df.select(*keys, *rest).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def agreeing(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures agree in enough slots."""
    def run(left: pa.Array, right: pa.Array):
        return (pa.array((matrix(left) == matrix(right)).sum(axis=1).astype(np.int32)),)

    own = nodes.select("node", "signature")
    joined = (pairs.join(own.withColumnsRenamed({"node": "a", "signature": "left"}), "a")
              .join(own.withColumnsRenamed({"node": "b", "signature": "right"}), "b"))
    counted = with_columns(joined, ["left", "right"], [T.StructField("same", T.IntegerType())], lambda: run,
                           drop=["left", "right"])
    return counted.where(F.col("same") >= LEAST_SLOTS).select("a", "b")


def full_sets(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """Rows (node, elements) with the sorted shingle set of each wanted node, made anew from the texts."""
    few = wanted.count() <= BROADCAST_IDS
    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("node"), F.col(f"`{text}`").alias("text"))
    picked = own.join(F.broadcast(wanted) if few else wanted, "node")

    def run(texts: pa.Array):
        elements, first = shingles(texts, size)
        k1, k2 = digests(elements, first)
        sets = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [
            None, pa.py_buffer(first.astype(np.int64) * 8), pa.py_buffer(elements)])
        return pa.array(k1), pa.array(k2), sets

    made = with_columns(picked.withColumnsRenamed({"k1": "w1", "k2": "w2"}), ["text"], [
        T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("elements", T.BinaryType())],
        lambda: run, drop=["text"])
    return made.where("k1 = w1 AND k2 = w2").select("node", "elements")  # another row with this id may have another set


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets reach the threshold."""
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold."""
    def run(left: pa.Array, right: pa.Array):
        return (pa.array([linked(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64))
                          for a, b in zip(left.to_pylist(), right.to_pylist())]),)

    joined = (pairs.join(sets.withColumnsRenamed({"node": "a", "elements": "left"}), "a")
              .join(sets.withColumnsRenamed({"node": "b", "elements": "right"}), "b"))
    told = with_columns(joined, ["left", "right"], [T.StructField("ok", T.BooleanType())], lambda: run, drop=["left", "right"])
    return told.where("ok").select("a", "b").distinct()


def pairs_across(table: pa.Table) -> pa.RecordBatch | None:
    """Per node of a block: its partners of other components that pass by signature and share no earlier bucket."""
    bucket, i, j = (table.column(c)[0].as_py() for c in ("bucket", "i", "j"))
    node, component, part = (table.column(c).to_numpy() for c in ("node", "component", "part"))
    sign = matrix(table.column("signature").combine_chunks())
    # two blocks meet here: pairs inside a block belong to the group where i = j
    left = np.flatnonzero(part == i)
    right = left if i == j else np.flatnonzero(part == j)
    own = bands(sign)
    found: dict[int, list[int]] = {}
    for x in left.tolist():
        other = right[(component[right] != component[x]) & ((node[right] > node[x]) if i == j else True)]
        if not len(other):
            continue
        other = other[(sign[other] == sign[x]).sum(axis=1) >= LEAST_SLOTS]
        if not len(other):
            continue
        first = (own[other] == own[x]).argmax(axis=1)
        other = other[own[x][first] == bucket]
        if len(other):
            found.setdefault(x, []).extend(node[other].tolist())
            for y in other.tolist():
                found.setdefault(y, [])
    if not found:
        return None
    rows = list(found)
    return pa.RecordBatch.from_arrays([
        pa.array([bucket] * len(rows)), pa.array([i] * len(rows), pa.int32()), pa.array([j] * len(rows), pa.int32()),
        pa.array(node[rows]), pa.array(component[rows]), pa.array([found[r] for r in rows], pa.list_(pa.int64()))],
        names=["bucket", "i", "j", "node", "component", "partners"])


def links_across(table: pa.Table) -> pa.RecordBatch | None:
    """Verified links of a block; a pair whose components have met by an earlier link of the block is passed over."""
    node = table.column("node").to_pylist()
    sets = {n: np.frombuffer(e, np.uint64) for n, e in zip(node, table.column("elements").to_pylist())}
    component = dict(zip(node, table.column("component").to_pylist()))
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while c in parent:
            c = parent[c]
        return c

    out: list[tuple[int, int]] = []
    for x, partners in zip(node, table.column("partners").to_pylist()):
        for y in partners:
            a, b = root(component[x]), root(component[y])
            if a != b and linked(sets[x], sets[y]):
                parent[max(a, b)] = min(a, b)
                out.append((x, y))
    if not out:
        return None
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out]), pa.array([y for _, y in out])], names=["a", "b"])


def bucket_rows(nodes: DataFrame) -> DataFrame:
    """Rows (bucket, node), one for each band."""
    def run(signature: pa.Array):
        flat = pa.array(bands(matrix(signature)).reshape(-1))
        return (pa.ListArray.from_arrays(pa.array(np.arange(len(signature) + 1, dtype=np.int32) * BANDS), flat),)

    made = with_columns(nodes.select("node", "signature"), ["signature"],
                        [T.StructField("buckets", T.ArrayType(T.LongType()))], lambda: run, drop=["signature"])
    return made.select("node", F.explode("buckets").alias("bucket"))


def link(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one per input row."""
    profile = stored(profiles(docs, doc_id, text, size))
    able = profile.where("n_shingles > 0 AND doc_id IS NOT NULL")
    nodes = stored(able.groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.first("signature").alias("signature")))
    # An id with several texts: its sets' nodes are one.
    several = able.groupBy("doc_id").agg(F.min("k1").alias("a"), F.max("k1").alias("b")).where("a <> b").select("doc_id")
    shared = able.join(several, "doc_id").join(nodes.select("k1", "k2", "node"), ["k1", "k2"]).select("doc_id", "node").distinct()
    shared = shared.join(shared.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").select("a", F.col("node").alias("b"))

    rows = bucket_rows(nodes)
    full = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = stored(rows.join(full, "bucket"))
    company = members.groupBy("node").agg(F.sum(F.col("n") - 1).alias("company"))
    pivots = members.join(company, "node").groupBy("bucket").agg(
        F.max(F.struct("company", (-F.col("node")).alias("minus"))).alias("top"))
    stars = members.join(pivots, "bucket").select("node", (-F.col("top.minus")).alias("pivot")).where("node <> pivot")
    pairs = stored(agreeing(stars.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct(), nodes))

    keys = nodes.select("node", "k1", "k2")
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = stored(full_sets(docs, keys.join(ends, "node"), doc_id, text, size))
    links = stored(verified(pairs, sets).unionByName(shared))
    found = components(links)

    placed = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")).drop("n")
    open_ = placed.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b"),
                                         F.count("*").alias("n")).where("a <> b")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    across = (placed.join(open_.select("bucket", blocks.alias("blocks")), "bucket")
              .withColumn("part", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .join(nodes.select("node", "signature"), "node")
              .select("bucket", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node",
                      "component", "signature"))
    passed = stored(by_group(across, ["bucket", "i", "j"], pairs_across,
                             "bucket long, i int, j int, node long, component long, partners array<long>"))
    more = stored(full_sets(docs, keys.join(passed.select("node").distinct(), "node"), doc_id, text, size))
    crossed = by_group(passed.join(more, "node"), ["bucket", "i", "j"], links_across, "a long, b long")
    found = components(links.unionByName(stored(crossed)))

    placed = nodes.join(found, "node", "left").select("k1", "k2", F.coalesce("component", "node").alias("component_id"))
    return (profile.join(placed, ["k1", "k2"], "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
            .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))
