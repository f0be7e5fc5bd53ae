"""Importance resampling against sums over plain n-grams."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from emberline.llm import crc, queries, resample

LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall((text or "").translate(LETTERS))
    return words, [" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10_000


def brute(docs, target, percent=5, least=20):
    s, t = Counter(), Counter()
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            counts.update(map(bucket, features(text)[1]))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (S + 10000) / ((s[b] + 1.0) * (T + 10000)))) for b in range(10_000)]
    rows = []
    for doc_id, text in docs:
        words, own = features(text)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in own)
        rows.append([doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[:percent * len(able) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def drawn(spark, docs, target, **params):
    rows = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, line string, bucket int")
    return sorted((tuple(r) for r in resample.resample(rows, spark.createDataFrame([(x,) for x in target], "text string"), **params).collect()), key=str)


def test_query_equals_brute_force_on_the_given_tables(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = sorted((tuple(r) for r in queries.QUERIES["op13_segment_resampling"](spark, sf).collect()), key=str)
    assert got == brute(docs, target) and any(r[4] for r in got)


def test_nulls_lines_ties_and_long_words(spark):
    rng = np.random.default_rng(1)
    words = ["a", "B", "éa", "x1", "word", "ſ", "w" * 47, "w" * 48, "w" * 49, "v" * 300, "-", "日本", "İ"]
    lines = [" ".join(rng.choice(words, rng.integers(0, 9))) for _ in range(30)]
    docs = [(i, "\n".join(rng.choice(lines, rng.integers(0, 12)))) for i in range(120)]
    docs += [(None, None), (None, "\n"), (3, docs[3][1]), (3, docs[3][1]), (900, ""), (901, "\n\n--\n"), (902, "z" * 100_000), (None, "a b " * 40)]
    target = ["word a x1\nb word a", None, "", "日本 日本"]
    assert drawn(spark, docs, target, percent=30) == brute(docs, target, 30)
    assert drawn(spark, docs, [], percent=100, least_words=0) == brute(docs, [], 100, 0)


def test_empty_tables(spark):
    assert drawn(spark, [], ["a b"]) == [] and drawn(spark, [(1, "one")], []) == brute([(1, "one")], [])


def test_equal_scores_go_to_the_smaller_id(spark):
    rows = spark.createDataFrame([(i, 7) for i in range(5_000)] + [(i, 9) for i in range(5_000, 5_010)], "doc_id long, score long")
    got = {r["doc_id"]: r["rank"] for r in resample.ranked(rows.repartition(13), 100).collect()}
    assert {k: v for k, v in got.items() if v} == {5_000 + i: i + 1 for i in range(10)} | {i: i + 11 for i in range(90)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=120), min_size=1, max_size=12))
def test_checksums_of_parts_and_of_joined_parts(parts):
    data = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    sizes = np.array([len(p) for p in parts])
    registers = crc.registers(data, ends - sizes, ends)
    assert crc.checksum(registers, sizes).tolist() == [zlib.crc32(p) for p in parts]
    whole, n = registers[:1], sizes[:1]
    for r, k in zip(registers[1:], sizes[1:]):
        whole, n = crc.moved(whole, np.array([k])) ^ r, n + k
    assert crc.checksum(whole, n).tolist() == [zlib.crc32(b"".join(parts))]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aB0\n -é", max_size=40)), max_size=8))
def test_weights_of_a_batch(texts):
    gain = (np.arange(10_000) * 37) % 1001 - 500
    words, n, weight = resample.weigh(resample.cut(pa.array(texts, pa.string())), gain)
    own = [features(t) for t in texts]
    assert words.tolist() == [len(w) for w, _ in own] and n.tolist() == [len(f) for _, f in own]
    assert weight.tolist() == [sum(int(gain[bucket(x)]) for x in f) for _, f in own]
