"""Suffix-array decontamination against a search for every window."""

import random
import re

import pyarrow as pa
from helpers_llm import lowered

from emberline.llm import suffixes


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def brute(texts, items, size=10):
    windows = {}
    for name, text in items:
        words = words_of(text)
        k = min(size, len(words))
        for j in range(len(words) - k + 1 if words else 0):
            windows.setdefault(tuple(words[j:j + k]), set()).add(name)
    out = []
    for text in texts:
        words, hit, names = words_of(text), set(), set()
        for k in {len(w) for w in windows}:
            for j in range(len(words) - k + 1):
                if (found := windows.get(tuple(words[j:j + k]))):
                    hit.update(range(j, j + k))
                    names |= found
        out.append((len(words), len(hit), sorted(names)))
    return out


def ours(texts, items):
    test = suffixes.TestItems([i for i, _ in items], pa.array([t or "" for _, t in items], pa.string()), suffixes.WINDOW)
    found, hits, pairs, _ = suffixes.search(pa.array(texts, pa.string()), test)
    names = [[] for _ in texts]
    for row, item in pairs.tolist():
        names[row].append(test.names[item])
    spans = suffixes.spans_of(hits, found.first).to_pylist()
    return [(int(n), sum(s["end"] - s["start"] for s in row), sorted(own)) for n, row, own in zip(found.counts, spans, names)]


def test_random_texts_equal_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        letters = "a b c d é".split()[:rng.randint(1, 5)]
        texts = [" ".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(0, 8))] + [None, ""]
        items = [(str(rng.randint(0, 9)), " ".join(rng.choice(letters + ["z"]) for _ in range(rng.randint(0, 25)))) for _ in range(rng.randint(0, 5))]
        assert ours(texts, items) == brute(texts, items)


def test_tables_equal_brute_force(spark, many, sf, monkeypatch):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    rows = {r["doc_id"]: r for r in suffixes.mark(many, items).collect()}
    texts = [(r["doc_id"], r["text"]) for r in many.collect()]
    wanted = brute([t for _, t in texts], [(str(r["item_id"]), r["text"]) for r in items.collect()])
    for (doc_id, _), (n, hit, names) in zip(texts, wanted):
        row = rows[doc_id]
        assert (row["n_words"], sum(e - s for s, e in row["hit_spans"]), row["hit_items"]) == (n, hit, names)
        assert (row["longest_match"] >= 10) == bool(hit)
    assert any(r["hit_items"] for r in rows.values())
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", 2000)  # several broadcasts give the same hits
    several = suffixes.mark(many, items)
    assert {r["doc_id"]: (r["hit_spans"], r["hit_items"], r["longest_match"]) for r in several.collect()} == {
        k: (r["hit_spans"], r["hit_items"], r["longest_match"]) for k, r in rows.items()}


def test_location_and_length_of_the_longest_match(spark):
    item = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, "x y " + " ".join(f"W{i}" for i in range(5, 27)) + " z")], "doc_id long, text string")
    row = suffixes.mark(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).first()
    assert [tuple(s) for s in row["hit_spans"]] == [(2, 24)] and row["longest_match"] == 22


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "cat sat on the mat the cat sat on the mat"), (None, "a"), (3, None), (4, ""), (5, "word")],
                                  "item_id long, text string")
    rows = suffixes.mark(odd_docs, items).collect()
    assert len(rows) == odd_docs.count()
    assert [r["hit_items"] for r in rows if r["doc_id"] == 5] == [["5"], ["5"]]
    assert [r["hit_items"] for r in rows if r["doc_id"] == 4] == [["null"]]
    assert [r["n_words"] for r in rows if r["doc_id"] in (2, 3)] == [0, 0]
    left = suffixes.decontaminate(odd_docs, items)
    assert left.columns == odd_docs.columns and {r["doc_id"] for r in left.collect()} == {2, 3, None, 7, 8}
    assert suffixes.mark(no_docs, items).count() == 0
    assert all(not r["hit_spans"] for r in suffixes.mark(odd_docs, items.where("false")).collect())
