"""Near-duplicates against all pairs, components against a union-find, signatures against their estimate."""

import random
import re

import numpy as np
import pytest
from helpers_llm import lowered

from emberline.llm import near, superminhash
from emberline.llm.components import components


def brute(rows, size):
    """Rows (id, text) to (set size, component) in order; ids may repeat or be null."""
    sets = []
    for _, text in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", lowered(text)) if w]
        sets.append({tuple(words[j:j + size]) for j in range(len(words) - size + 1)} if len(words) >= size else ({tuple(words)} if words else set()))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            a, b = sets[x], sets[y]
            same_id = rows[x][0] == rows[y][0]
            if rows[x][0] is not None and rows[y][0] is not None and a and b and (
                    same_id or (len(a) * 100 >= 80 * len(b) and len(b) * 100 >= 80 * len(a) and 100 * len(a & b) >= 80 * len(a | b))):
                parent[root(x)] = root(y)
    least = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            least[root(x)] = min(least.get(root(x), i), i)
    return sorted(((i, len(s), None if i is None else (least[root(x)] if s else i)) for x, ((i, _), s) in enumerate(zip(rows, sets))), key=str)


def ours(df, size):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near.link(df, size=size).collect()), key=str)


@pytest.mark.parametrize("size", [2, 5])
def test_tables_equal_all_pairs(spark, many, size):
    rows = [(r["doc_id"], r["text"]) for r in many.collect()]
    assert ours(many, size) == brute(rows, size)


def test_a_large_loose_group_loses_no_link(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 16)  # buckets are compared in several blocks
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(60)] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(words)))
    rows += [(200 + i, rows[3][1]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert ours(df, 2) == brute(rows, 2)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()] + [(7, "another text of the same id"), (20, "Another TEXT of the same id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert ours(df, 2) == brute(rows, 2)
    assert near.link(odd_docs).count() == odd_docs.count() and near.link(no_docs).count() == 0
    assert {r["doc_id"] for r in near.link(odd_docs).where("NOT kept").collect()} == set()


def test_signatures_estimate_with_less_spread_than_independent_hashes():
    rng = np.random.default_rng(0)
    found = []
    for _ in range(300):
        union = rng.integers(0, 2 ** 63, 36, dtype=np.uint64)
        sets = np.concatenate([union[:32], union[4:]])
        signature = superminhash.signatures(sets, np.array([0, 32, 64]))
        found.append((signature[0] == signature[1]).mean())
    j = 28 / 36
    assert abs(np.mean(found) - j) < 0.01 and np.std(found) < 0.85 * np.sqrt(j * (1 - j) / superminhash.SLOTS)


def test_ranks_are_permutations_and_small_sets_fill_all_slots():
    keys = superminhash.mix(np.arange(1, 50, dtype=np.uint64))
    order = np.stack([superminhash.place(keys, j) for j in range(superminhash.SLOTS)], axis=1)
    assert all(len(set(row)) == superminhash.SLOTS for row in order.tolist())
    signature = superminhash.signatures(keys[:3], np.array([0, 1, 3, 3]))
    assert (signature[:2] < np.iinfo(np.uint32).max).all() and (signature[2] == np.iinfo(np.uint32).max).all()


def test_components_equal_union_find(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(50)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    edges += [(7, 7), (None, 3), (100, 101)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "a long, b long")
    assert {(r["node"], r["component"]) for r in components(df).collect()} == {(n, root(n)) for n in parent}
    assert components(df.where("false")).count() == 0
