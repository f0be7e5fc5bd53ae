"""Token ids as compressed shard files with one shared zstandard dictionary.

A dictionary is trained on the serialized ids of a bounded sample of documents. Every document is then compressed on its
own with it, so one document is read with two small reads: its entry in the shard's index, then its frame.

Shard file (all integers little-endian)::

    magic "EMTK0001" | ids' width in bytes, 4 bytes | SHA-256 of the dictionary, 32 bytes
    frames, one after the other
    index: one entry a document, five 64-bit integers: id, offset and length of the frame, first token, tokens
    number of documents, 8 bytes | offset of the index, 8 bytes

``first token`` counts from the start of the shard; the manifest holds the tokens before each shard. Documents are dealt
to shards by ranges of their id, so the shards in order hold all ids ascending; equal ids are ordered by their
tokens, null ids come first and are stored as the smallest integer.

Documents are encoded where they are read and only frames are shuffled. Files are written under a name of the attempt and
then renamed, so a task may run twice; the manifest names the files that count.

Cases: a null or empty text is a document of the end token alone; repeated rows are repeated documents; an empty table
gives no shards, and reading them back gives no rows; other columns are not stored.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .batches import bounded
from .bpe import byte_alphabet
from .pieces import PieceTable
from .ranges import NULL_ID, bounds_of

MAGIC = b"EMTK0001"
HEAD = struct.Struct("<8sI32s")
ENTRY = np.dtype([("id", "<i8"), ("offset", "<i8"), ("length", "<i8"), ("start", "<i8"), ("tokens", "<i8")])
TAIL = struct.Struct("<qq")

#: Documents whose ids train the dictionary, and how many ids of each; this bounds the only sample taken.
DICTIONARY_DOCUMENTS, DICTIONARY_TOKENS, DICTIONARY_BYTES = 1_000, 4_096, 32_768
#: Documents of a shard, about; a shard of more frame bytes than the second figure is written in parts.
SHARD_DOCUMENTS, SHARD_BYTES = 8_192, 64 << 20
LEVEL = 3
#: Distinct words of other texts a worker remembers.
REMEMBERED = 250_000

# Fixed value: texts of tab, line ends, and printable Latin up to Extended-B but I with dot.
LATIN = "[\t\n\r\x20-\x7e\xa1-\u012f\u0131-\u024f]*"

_MANIFEST = T.StructType([T.StructField(n, t) for n, t in (
    ("file", T.StringType()), ("documents", T.LongType()), ("tokens", T.LongType()), ("bytes", T.LongType()))])


class LatinPieces(PieceTable):
    """Lower-cased Latin texts, cut as the tokenizer cuts them; white space is a piece without ids."""

    def __init__(self, model, signs: list[str]):
        super().__init__()
        self.model, self.signs = model, signs
        letters, numbers = regex.compile(r"\p{L}").match, regex.compile(r"\p{N}").match
        # classes of Latin code points and their small letters: white space 0, letters 1, digits 2, other signs 3
        self.kinds = np.array([0 if chr(i).isspace() else 1 if letters(chr(i)) else 2 if numbers(chr(i)) else 3 for i in range(0x2D00)], dtype=np.uint8)

    def starts(self, codes: np.ndarray, edges: np.ndarray) -> np.ndarray:
        n = len(codes)
        kind = self.kinds[codes]
        begins = np.zeros(n + 1, dtype=bool)
        begins[edges] = begins[n] = True
        out = begins[:n] | (kind == 2)  # every digit stands alone
        out[1:] |= kind[1:] != kind[:-1]
        at = np.flatnonzero(out & (codes == 0x27))  # an apostrophe that no other sign leads
        at = at[~begins[at + 1]]
        first = codes[at + 1]
        short = at[np.isin(first, [ord(c) for c in "stmd"])]
        long = at[np.isin(first, [ord(c) for c in "rvl"])]
        long = long[~begins[long + 2]]
        pair = codes[long + 1].astype(np.int64) << 16 | codes[long + 2]
        long = long[np.isin(pair, [ord(a) << 16 | ord(b) for a, b in ("re", "ve", "ll")])]
        for places, size in ((short, 2), (long, 3)):
            out[places + 1] = False
            after = places + size
            out[after[after < n]] = True
        return np.flatnonzero(out)

    def piece(self, text: str) -> list[int]:
        if text.isspace():
            return []
        # lower-cased and cut already: only the merges are left to do
        return [t.id for t in self.model.tokenize(text if text.isascii() else "".join([self.signs[b] for b in text.encode()]))]


class WordEncoder:
    """Encodes by pieces that the tokenizer's own rules keep apart, remembering pieces met before.

    Texts of Latin letters are cut as the tokenizer cuts them after lower-casing, since there Python and the library
    agree on case, classes and composed forms. All other texts are cut at ASCII white space only, which the
    library drops and never merges across; special tokens hold none, so they stay whole.
    """

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.library = Tokenizer.from_file(file)
        self.library.no_truncation()
        self.library.no_padding()
        self.latin = regex.compile(LATIN).fullmatch
        self.special = regex.compile("|".join(regex.escape(t.content) for t in self.library.get_added_tokens_decoder().values())
                                     or "(?!)").search
        self.pieces = LatinPieces(self.library.model, [sign for sign, _ in sorted(byte_alphabet().items(), key=lambda x: x[1])])
        self.new: dict[str, bytes] = {}

    def plain(self, text: str) -> bool:
        return self.latin(text) is not None and not ("<" in text and self.special(text))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        plain = [self.plain(t) for t in texts]
        ids, counts = self.pieces.encode_plain([t.lower() if p else "" for t, p in zip(texts, plain)])
        out = np.split(ids.astype("<u4", copy=False), np.cumsum(counts)[:-1]) if texts else []
        for i, p in enumerate(plain):
            if not p:
                out[i] = self._by_words(texts[i])
        return out

    def _by_words(self, text: str) -> np.ndarray:
        words, new = text.replace("\n", " ").replace("\r", " ").replace("\t", " ").split(" "), self.new
        unseen = list(set(words).difference(new))
        for a in range(0, len(unseen), 10_000):
            some = unseen[a:a + 10_000]
            coded = self.library.encode_batch_fast(some, add_special_tokens=False)
            new.update((w, np.array(c.ids, dtype="<u4").tobytes()) for w, c in zip(some, coded))
        out = np.frombuffer(b"".join(map(new.__getitem__, words)), dtype="<u4")
        if len(new) > REMEMBERED:
            new.clear()
        return out


@lru_cache(maxsize=2)
def encoder(file: str) -> WordEncoder:
    return WordEncoder(file)


def width_of(file: str) -> int:
    return 2 if Tokenizer.from_file(file).get_vocab_size(True) <= 1 << 16 else 4


def train_dictionary(docs: DataFrame, file: str, width: int, end: int, doc_id: str, text: str) -> bytes:
    """A dictionary from the documents whose ids hash lowest; empty where there is too little to learn from."""
    n = docs.count()
    share = max(1, int((1 << 32) * min(1.0, 2 * DICTIONARY_DOCUMENTS / max(n, 1))))
    h = F.pmod(F.xxhash64(doc_id), F.lit(1 << 32))
    some = docs.select(h.alias("h"), F.coalesce(F.substring(text, 1, 8 * DICTIONARY_TOKENS), F.lit("")).alias("t")).where(F.col("h") < share)
    texts = [r["t"] for r in some.orderBy("h", "t").limit(DICTIONARY_DOCUMENTS).collect()]
    samples = [serialize(np.append(i, np.uint32(end)), width) for i in encoder(file).encode(texts)]
    samples = [s[:width * DICTIONARY_TOKENS] for s in samples if len(s) >= 16]
    if sum(map(len, samples)) < 4 * DICTIONARY_BYTES or len(samples) < 16:
        return b""
    return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()


def serialize(ids: np.ndarray, width: int) -> bytes:
    return ids.astype(f"<u{width}").tobytes()


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if data:
        data.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_dict_id=False)
    return zstandard.ZstdCompressor(level=LEVEL)


def decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    """Arrow's file system of a folder that Spark names, and the path in it."""
    uri = path.replace("s3a://", "s3://", 1)
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pa.fs.FileSystem.from_uri(uri)


def shard_bytes(rows: list[tuple[int, int, bytes]], width: int, dictionary_hash: bytes) -> bytes:
    """A shard file of (id, number of tokens, frame)."""
    index = np.zeros(len(rows), dtype=ENTRY)
    lengths = np.array([len(frame) for _, _, frame in rows], dtype=np.int64)
    tokens = np.array([n for _, n, _ in rows], dtype=np.int64)
    index["id"] = [i for i, _, _ in rows]
    index["length"], index["tokens"] = lengths, tokens
    index["offset"] = HEAD.size + np.cumsum(lengths) - lengths
    index["start"] = np.cumsum(tokens) - tokens
    frames = b"".join(frame for _, _, frame in rows)
    return HEAD.pack(MAGIC, width, dictionary_hash) + frames + index.tobytes() + TAIL.pack(len(rows), HEAD.size + len(frames))


class Shard:
    """A shard's bytes, or a file of which only what is asked for is read."""

    def __init__(self, source: bytes | pa.NativeFile, dictionary: bytes):
        self.file = pa.BufferReader(source) if isinstance(source, bytes) else source
        size = self.file.size()
        magic, self.width, expected = HEAD.unpack(self._at(0, HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        if expected != hashlib.sha256(dictionary).digest():
            raise ValueError("the shard was written with another dictionary")
        n, offset = TAIL.unpack(self._at(size - TAIL.size, TAIL.size))
        self.index = np.frombuffer(self._at(offset, n * ENTRY.itemsize), ENTRY)
        self.frames = decompressor(dictionary)

    def _at(self, offset: int, length: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(length)

    def ids(self, place: int) -> np.ndarray:
        """Token ids of the document at a place of the shard."""
        entry = self.index[place]
        frame = self._at(int(entry["offset"]), int(entry["length"]))
        return np.frombuffer(self.frames.decompress(frame), f"<u{self.width}").astype("<u4")

    def find(self, doc_id: int) -> list[np.ndarray]:
        """Token ids of each document with this id."""
        low, high = np.searchsorted(self.index["id"], doc_id), np.searchsorted(self.index["id"], doc_id, "right")
        return [self.ids(i) for i in range(low, high)]


@dataclass(frozen=True)
class TokenFiles:
    """Where the shards are, and what reads them: the manifest's rows (one a shard) and the dictionary."""

    folder: str
    dictionary: bytes
    manifest: list

    def open(self, shard) -> Shard:
        fs, path = file_system(f"{self.folder}/{shard['file']}")
        return Shard(fs.open_input_file(path), self.dictionary)


def write(docs: DataFrame, file: str, folder: str, end: int, doc_id: str = "doc_id", text: str = "text",
          shard_documents: int = SHARD_DOCUMENTS) -> TokenFiles:
    """Encode, compress and write all documents; ``folder`` is on a file system that every node reaches."""
    spark = bounded(docs.sparkSession)
    sc = spark.sparkContext
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    width = width_of(file)
    dictionary = train_dictionary(docs, file, width, end, "id", "text")
    digest = hashlib.sha256(dictionary).digest()
    fs, path = file_system(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/dictionary") as out:
        out.write(dictionary)
    bounds = bounds_of(docs, "id", shard_documents)
    shared = sc.broadcast((dictionary, bounds))

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary, bounds = shared.value
        compress, encode = compressor(dictionary).compress, encoder(file).encode
        for batch in batches:
            ids = batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            coded = [np.append(c, np.uint32(end)) for c in encode([t or "" for t in batch.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.searchsorted(bounds, ids, "right").astype(np.int32)), pa.array(ids),
                pa.array([len(c) for c in coded], pa.int64()),
                pa.array([compress(serialize(c, width)) for c in coded], pa.binary())],
                names=["shard", "id", "n", "frame"])

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = file_system(folder)

        def flush(shard: int, part: int, rows: list) -> pa.RecordBatch:
            name, data = f"shard-{shard:08d}-{part:04d}.tok", shard_bytes(rows, width, digest)
            attempt = f"{path}/_{name}.{uuid.uuid4().hex}"
            with fs.open_output_stream(attempt) as out:
                out.write(data)
            fs.move(attempt, f"{path}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in (
                (name, pa.string()), (len(rows), pa.int64()), (sum(n for _, n, _ in rows), pa.int64()),
                (len(data), pa.int64()))], names=_MANIFEST.names)

        shard, part, rows, held = None, 0, [], 0
        for batch in batches:
            for own, *row in zip(*[c.to_pylist() for c in batch.columns]):
                if rows and (own != shard or held > SHARD_BYTES):
                    yield flush(shard, part, rows)
                    part, rows, held = part + 1, [], 0
                if own != shard:
                    shard, part = own, 0
                rows.append(row)
                held += len(row[2])
        if rows:
            yield flush(shard, part, rows)

    coded = docs.mapInArrow(frames, "shard int, id long, n long, frame binary")
    dealt = coded.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", "id", "frame")
    manifest = sorted(dealt.mapInArrow(files, _MANIFEST).collect(), key=lambda r: r["file"])
    return TokenFiles(folder, dictionary, manifest)


def read(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """Rows of all shards: ``doc_id``, ``start`` (tokens of all documents before it), ``n_tokens``, ``ids`` (binary)."""
    schema = "doc_id long, start long, n_tokens long, ids binary"
    if not files.manifest:
        return bounded(spark).createDataFrame([], schema)
    tokens = np.array([r["tokens"] for r in files.manifest], dtype=np.int64)
    names = np.array([r["file"] for r in files.manifest])
    shared = bounded(spark).sparkContext.broadcast((files.dictionary, names, np.cumsum(tokens) - tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary, names, before = shared.value
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard = Shard(content.as_py(), dictionary)
                base = before[np.searchsorted(names, name)]
                for a in range(0, len(shard.index), 512):
                    some = shard.index[a:a + 512]
                    ids = some["id"]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(ids, mask=ids == NULL_ID), pa.array(some["start"] + base), pa.array(some["tokens"]),
                        pa.array([shard.ids(a + i).tobytes() for i in range(len(some))], pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids"])

    found = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.tok").load(files.folder)
    listed = spark.createDataFrame([(n,) for n in names.tolist()], "name string")
    return (found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
            .join(F.broadcast(listed), "name", "left_semi").mapInArrow(run, schema))
