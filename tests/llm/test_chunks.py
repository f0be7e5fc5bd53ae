"""Chunk fingerprints and successors by id."""

import random

import pyarrow as pa
import pytest

from emberline.llm import chunks, ranges


def plain_cut(data: bytes):
    """Chunks by the rule, byte by byte."""
    out, start = [], 0
    while start < len(data):
        h, end = 0, min(start + chunks.LARGEST, len(data))
        for i in range(max(0, start - 16), end):
            h = (2 * h + int(chunks.GEAR[data[i]])) & 0xFFFF
            size = i + 1 - start
            bits = chunks.STRICT if size < chunks.NORMAL else chunks.LOOSE
            if size >= chunks.SMALLEST and h >> (16 - bits) == 0:
                end = i + 1
                break
        out.append((start, end))
        start = end
    return out


def test_boundaries_equal_the_rule():
    rng = random.Random(1)
    for _ in range(50):
        texts = ["".join(rng.choice("abcdé \n") for _ in range(rng.choice((0, 3, 40, 900)))) for _ in range(4)]
        data, offsets = chunks.utf8(pa.array(texts))
        starts, ends, owner = chunks.cut(data, offsets)
        for i, text in enumerate(texts):
            mine = sorted((a - offsets[i], b - offsets[i]) for a, b, o in zip(starts, ends, owner) if o == i)
            assert mine == plain_cut(text.encode())


def test_insertions_move_few_chunks(many):
    texts = [r["text"] for r in many.select("text").collect() if len(r["text"]) > 1000][:40]
    own, moved = chunks.Sets.of(pa.array(texts)), chunks.Sets.of(pa.array([t[:500] + "INSERTED" + t[500:] for t in texts]))
    lost = (1 - own.contained(moved)) * own.weight()  # bytes of the chunks around the insertion
    assert lost.max() <= 6 * chunks.LARGEST and lost.mean() <= 2 * chunks.LARGEST
    assert (own.likeness(own) == 1).all()
    others = chunks.Sets.of(pa.array(texts[1:] + texts[:1]))
    assert own.likeness(others).mean() < 0.1


def test_containment_is_weighted_by_length(many):
    text = next(r["text"] for r in many.select("text").collect() if len(r["text"]) > 4000)
    part, whole = chunks.Sets.of(pa.array([text[:2000]])), chunks.Sets.of(pa.array([text]))
    assert part.contained(whole)[0] > 0.95 and whole.contained(part)[0] < 0.6 and part.likeness(whole)[0] == whole.contained(part)[0]


def test_empty_and_short_texts():
    own = chunks.Sets.of(pa.array([None, "", "ab", "ab"]))
    assert own.strings().to_pylist()[:2] == ["", ""] and len(own.strings()[2].as_py()) == 10
    assert own.likeness(chunks.Sets.of(pa.array(["", "x", "ab", "ac"]))).tolist() == [1, 0, 1, 0]


@pytest.mark.parametrize("size", [2, 40, 1000])
def test_successors(spark, many, size):
    rows = {r["doc_id"]: r["text"] for r in many.collect()}
    order = sorted(rows)
    found = ranges.with_next(many, shard_documents=size).collect()
    assert sorted((r["doc_id"], r["text"], r["next_text"]) for r in found) == [
        (i, rows[i], rows[order[(k + 1) % len(order)]]) for k, i in enumerate(order)]


def test_successors_of_odd_rows(spark, odd_docs, no_docs):
    rows = sorted(((r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "") for r in odd_docs.collect()))
    for size in (1, 3, 100):
        found = ranges.with_next(odd_docs, shard_documents=size).collect()
        assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"], r["next_text"]) for r in found) == sorted(
            (*row, rows[(k + 1) % len(rows)][1]) for k, row in enumerate(rows))
    assert ranges.with_next(no_docs).count() == 0
    one = ranges.with_next(odd_docs.where("doc_id = 4")).first()
    assert one["next_text"] == one["text"]
    assert chunks.fingerprint(odd_docs).count() == odd_docs.count() and chunks.fingerprint(no_docs).count() == 0
