"""Byte-pair transducer and token shards against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from emberline.llm import bpe, tokens_out

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def texts(many):
    own = [r[0] for r in many.select("text").collect()]
    rng = random.Random(1)
    hard = ["", "a" * 3000, "ab" * 2000 + " x", " " * 1500, "=" * 1500, "-_" * 600, "ÃÂ" * 1500, "  \n\n\t x", "I'm don't 'LL !'s",
            "<|endoftext|>hi <|startoftext|> <|endoftext|>", "a\x1cb\x85c\xa0d e", "ΑΣ Σ é İ ǅ ŉ ª½", "\x0b\x0c\r\n"]
    hard += ["".join(rng.choice("aeiounrsthl") for _ in range(rng.randint(300, 2000))) for _ in range(30)]
    return own + hard


def test_ids_and_text_equal_the_library(texts):
    library, own, back = Tokenizer.from_file(BYTES), bpe.encoder(BYTES), bpe.Decoder(BYTES)
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        coded = own.encode(text)
        assert np.frombuffer(coded, "<u4").tolist() == ids
        assert back.decode(coded, step=3) == library.decode(ids, skip_special_tokens=False)


def test_stream_equals_whole_piece_and_holds_little():
    merges = bpe.load(BYTES)
    rng = random.Random(2)
    for _ in range(30):
        data = "".join(rng.choice("erstinga") for _ in range(rng.randint(1, 4000))).encode()
        size = rng.randint(1, 50)
        assert list(merges.stream((data[a:a + size] for a in range(0, len(data), size)), block=rng.choice((1, 7, 256)))) == merges.merge(data)
    seen = []

    class Counted(bpe.Merges):
        def merge(self, data):
            seen.append(len(data))
            return super().merge(data)

    assert sum(len(merges.bytes[t]) for t in Counted(BYTES).stream([b"the" * 20_000])) == 60_000
    assert max(seen) <= 2 * bpe.BLOCK + merges.lookahead + max(map(len, merges.bytes.values()))


def test_unfinished_characters_wait():
    back = bpe.Decoder(BYTES)
    merges = bpe.load(BYTES)
    ids = np.array([merges.single[b] for b in "é🎉".encode()])
    assert [back.feed(ids[i:i + 1]) for i in range(len(ids))] == ["", "é", "", "", "", "🎉"]


def test_transducer_keeps_rows_and_columns(odd_docs, no_docs):
    coded = bpe.decode(bpe.encode(odd_docs, BYTES), BYTES)
    rows = coded.collect()
    assert len(rows) == odd_docs.count() and {"score", "source", "spans"} <= set(coded.columns)
    assert all(r["decoded"] == (r["text"] or "") and len(r["ids"]) == 4 * r["n_tokens"] for r in rows)
    assert bpe.decode(bpe.encode(no_docs, BYTES), BYTES).count() == 0


def test_latin_pieces_equal_the_library_for_every_character():
    own, library = tokens_out.WordEncoder(WORDS), Tokenizer.from_file(WORDS)
    texts = [f"a{chr(c)}b {chr(c)} {chr(c)}{chr(c)}'s{chr(c)} 'LL{chr(c)}t" for c in [*range(1, 0x250), 0x2028, 0x3000, 0x300, 0x3A3, 0x212A]]
    assert [x.tolist() for x in own.encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_shards_hold_all_ids_in_order(spark, many, folder):
    files = tokens_out.write(many, WORDS, f"{folder}/many", end=1, shard_documents=40)
    assert len(files.manifest) > 3 and sum(r["documents"] for r in files.manifest) == many.count()
    library = Tokenizer.from_file(WORDS)
    start, rows = 0, {r["doc_id"]: r for r in tokens_out.read(spark, files).collect()}
    for doc_id, text in sorted((r["doc_id"], r["text"]) for r in many.collect()):
        ids = [*library.encode(text, add_special_tokens=False).ids, 1]
        row = rows[doc_id]
        assert (row["start"], row["n_tokens"], np.frombuffer(row["ids"], "<u4").tolist()) == (start, len(ids), ids)
        start += len(ids)
    shard = files.open(files.manifest[1])
    wanted = int(shard.index["id"][3])
    assert shard.find(wanted)[0].tobytes() == rows[wanted]["ids"] and shard.find(-5) == []
    with pytest.raises(ValueError):
        tokens_out.Shard(files.open(files.manifest[0])._at(0, 10 ** 9), b"another")


def test_dictionary_is_used_and_hashed(spark, sf, folder):
    docs = spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/documents.parquet")
    files = tokens_out.write(docs, WORDS, f"{folder}/dictionary", end=1)
    plain = sum(r["tokens"] for r in files.manifest) * 2
    assert files.dictionary and sum(r["bytes"] for r in files.manifest) < plain
    assert files.open(files.manifest[0])._at(12, 32) == hashlib.sha256(files.dictionary).digest()


def test_shards_of_odd_and_no_documents(spark, odd_docs, no_docs, folder):
    files = tokens_out.write(odd_docs, WORDS, f"{folder}/odd", end=1, shard_documents=2)
    rows = sorted(tokens_out.read(spark, files).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, 1, 2, 3, 4, 5, 5, 7, 8, 9]
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in rows[2:4]] == [[1], [1]]
    assert tokens_out.read(spark, tokens_out.write(no_docs, WORDS, f"{folder}/none", end=1)).count() == 0
