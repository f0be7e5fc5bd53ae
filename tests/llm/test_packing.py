"""Encoding of batches against the tokenizers library; packing against its contract and a plain BM25."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from emberline.llm import packing, pieces, queries

FILE = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(FILE)


@pytest.fixture(scope="module")
def library():
    return LIBRARY


def agree(library, texts, encoder=None):
    ids, counts = (encoder or pieces.encoder(FILE, pieces.classes(FILE))).encode(texts)
    got = [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])] if texts else []
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert got == want


@settings(max_examples=250, deadline=None)
@given(st.lists(st.one_of(st.text("'stremvdl aA1. \n\t ́é日", max_size=30), st.text(max_size=30)), min_size=1, max_size=6))
def test_ids_are_the_library_s(texts):
    agree(LIBRARY, texts)


def test_every_code_point_beside_others(library):
    points = [chr(i) for i in range(0x3000) if not 0xD800 <= i < 0xE000] + [chr(i) for i in range(0x3000, 0x20000, 7) if not 0xD800 <= i < 0xE000]
    agree(library, ["".join(f"a{c} {c}1{c}{c}.\n{c}'s" for c in points[i:i + 500]) for i in range(0, len(points), 500)])


def test_special_tokens_long_pieces_and_full_slots(library, sf, spark):
    agree(library, ["", "<|endoftext|>", "a<|endoftext|> b", "x" * 5_000, " " * 3_000 + "y", "'ll've're'd", "it's 'sun '"])
    texts = [r[0] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    crowded = pieces.PieceEncoder(FILE, pieces.classes(FILE))
    for a in range(0, len(texts), 25):
        crowded.filled = pieces.ARENA + 1 if a % 100 == 0 else crowded.filled  # the arena starts anew now and then
        agree(library, texts[a:a + 25], crowded)


def packed(spark, table, **params):
    docs = spark.createDataFrame([(*r, "x", 1) for r in table], "doc_id long, text string, start string, n int")
    return packing.pack(docs, FILE, **params).collect()


def check(rows, want, window):
    """Every id in one piece, sequences gapless, padding only where nothing is padded: all lengths are powers of two."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r["length"] > 0 and len(r["ids"]) == 4 * r["length"]
        docs[r["doc_id"], r["doc_tokens"]].append(r)
        sequences[r["sequence_id"]].append(r)
    got = Counter()
    for (doc_id, n), own in docs.items():
        starts = Counter(r["start"] for r in own)
        ids = {(r["start"], r["length"], bytes(r["ids"])) for r in own}
        copies = starts[0]
        if copies == 1:
            own.sort(key=lambda r: r["start"])
            assert [r["start"] for r in own] == np.cumsum([0, *[r["length"] for r in own]])[:-1].tolist()
            got[doc_id, b"".join(bytes(r["ids"]) for r in own)] += 1
        else:
            assert sum(r["length"] for r in own) == copies * n and ids
            got[doc_id, None] += copies
    for own in sequences.values():
        own.sort(key=lambda r: r["offset"])
        ends = np.cumsum([r["length"] for r in own])
        assert [r["offset"] for r in own] == [0, *ends[:-1].tolist()]
        assert ends[-1] <= window and ends[-1] & (ends[-1] - 1) == 0
    counted = Counter()
    for (doc_id, ids), n in want.items():
        counted[(doc_id, ids) if (doc_id, ids) in got else (doc_id, None)] += n
    assert got == counted
    return sequences


def wanted(library, table):
    return Counter((i, np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, t in table)


def test_pieces_cover_the_given_table(spark, sf, library):
    table = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sequences = check(packing.pack(docs, FILE, shard_tokens=20_000, partition_tokens=60_000).collect(), wanted(library, table), 2_048)
    full = sum(s[-1]["offset"] + s[-1]["length"] == 2_048 for s in sequences.values())
    assert full > 0.7 * len(sequences)
    rows = {(r["doc_id"], r["start"]): r for r in queries.QUERIES["op12_retrieval_packing"](spark, sf).collect()}
    ids = {k: v for k, v in ((i, b) for i, b in wanted(library, table))}
    for (doc_id, start), r in rows.items():
        assert r["ids_crc32"] == zlib.crc32(ids[doc_id][4 * start:4 * (start + r["length"])])
        assert 4 * r["doc_tokens"] == len(ids[doc_id])


def test_nulls_repeats_empty_and_long_texts(spark, library):
    table = [(None, None), (None, ""), (5, "word " * 9_000), (6, "twice"), (6, "twice"), (7, ""), (8, "<|endoftext|>")]
    check(packed(spark, table, window=256), wanted(library, table), 256)
    assert packed(spark, []) == []


@pytest.mark.parametrize("texts", [[None], [""], ["one two three"], [None, "", "one two three", "one two three four", "one two one"]])
def test_seeds_whose_terms_weigh_nothing(spark, library, texts):
    """Texts without terms, or with terms that more than half of the documents hold, fill windows in their order."""
    table = [(i, texts[i % len(texts)]) for i in range(900)]
    sequences = check(packed(spark, table, window=256), wanted(library, table), 256)
    assert sum(s[-1]["offset"] + s[-1]["length"] == 256 for s in sequences.values()) > 2
    if len(texts) == 1:
        ids = [r["doc_id"] for _, s in sorted(sequences.items()) for r in s]
        assert ids == sorted(ids)


def test_neighbours_share_a_window(spark, library):
    """Documents of three matters, dealt at random: windows hold one matter, but for the last of each."""
    rng = np.random.default_rng(2)
    matters = [["tiger", "lion", "savanna", "zebra"], ["engine", "piston", "diesel", "gear"], ["violin", "opera", "sonata", "flute"]]
    table = [(i, " ".join(rng.choice(matters[i % 3], 30))) for i in rng.permutation(600).tolist()]
    sequences = check(packed(spark, table, window=512), wanted(library, table), 512)
    pure = sum(len({r["doc_id"] % 3 for r in s}) == 1 for s in sequences.values())
    assert pure >= 0.8 * len(sequences)


def test_scores_of_no_terms_are_real_zeros():
    index = packing.Index([np.array(d, "<u2") for d in ([1], [3, 2, 1], [1])], np.array([0, 0, 1.0, 2.0]), 2.0)
    assert index.scores(0).dtype == index.scores(1).dtype == np.float64
    assert index.scores(0).tolist() == [0, 0, 0] and index.scores(1)[1] > 0


def test_scores_are_bm25():
    rng = np.random.default_rng(6)
    docs = [rng.integers(0, 40, n).astype("<u2") for n in (30, 5, 60, 1, 30)]
    idf = np.maximum(rng.normal(1, 1, 40), 0)
    index = packing.Index(docs, idf, 20.0)
    for q, query in enumerate(docs):
        want = [sum(idf[t] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / 20.0)) for t in set(query.tolist()) if (tf := d.tolist().count(t)))
                for d in docs]
        assert all(map(math.isclose, index.scores(q), want))
