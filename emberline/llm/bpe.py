"""Byte-pair encoding as a streaming transducer with bounded lookahead, and decoding as a byte-to-text state machine.

**Sufficient lookahead.** A boundary of the tokens of a prefix may vanish when more text arrives only through a chain of
rules of falling rank: a rule (x, y) needs y to its right; whether y is there depends on a rule (q, w) of lower rank whose
left side q ends y; and so on. The longest total length of the right sides along such a chain, computed from the merge
list alone, is how far ahead of a boundary the transducer must have read before the boundary is final. Behind it tokens
are emitted and their bytes forgotten, so memory is the block plus the lookahead, however long a piece is.

**Decoding** feeds token bytes to an incremental UTF-8 decoder, which holds at most an unfinished character.

Cases: a null or empty text has no tokens; a row's other columns pass through; input columns named like an output are
replaced; repeated rows give repeated rows; an unknown byte cannot occur (all 256 bytes are tokens, checked on loading);
ids outside the vocabulary fail on decoding, null ids decode to an empty text.
"""

from __future__ import annotations

import codecs
import heapq
import json
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .batches import with_columns

#: Pieces are cut off at this many bytes beyond the lookahead before tokens are emitted.
BLOCK = 256
#: Encoded pieces a worker remembers, in two generations.
REMEMBERED = 200_000

# Fixed value: the pattern of the byte-level pre-tokenizer.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: itself where printable in Latin-1, else the next code point from 256 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Vocabulary and ranked merges of a byte-level BPE file."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        ids = spec["model"]["vocab"]
        self.bytes: dict[int, bytes] = {i: bytes(alphabet[c] for c in t) for t, i in ids.items()}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes |= {i: t.encode() for t, i in self.added.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rules = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.single = [ids[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])]
        self.lookahead = self._lookahead()

    def _lookahead(self) -> int:
        """The longest reach of a chain of rules of falling rank (see the module's text)."""
        size = {i: len(b) for i, b in self.bytes.items()}
        ends: dict[int, set[int]] = {i: {i} for i in size}  # tokens that may end a token while it is built
        reach: dict[int, int] = {}
        longest = 0
        for (x, y), (_, made) in sorted(self.rules.items(), key=lambda r: r[1][0]):
            far = size[y] + max(reach.get(q, 0) for q in ends[y])
            reach[x] = max(reach.get(x, 0), far)
            ends[made] |= ends[y]
            longest = max(longest, far)
        return longest

    def merge(self, data: bytes) -> list[int]:
        """Tokens of a piece held whole: the lowest rank merges first, the leftmost among equals."""
        tokens = [self.single[b] for b in data]
        rules = self.rules
        if len(tokens) <= 24:
            while len(tokens) > 1:
                best, at = None, -1
                for i in range(len(tokens) - 1):
                    rule = rules.get((tokens[i], tokens[i + 1]))
                    if rule is not None and (best is None or rule[0] < best[0]):
                        best, at = rule, i
                if best is None:
                    break
                tokens[at:at + 2] = [best[1]]
            return tokens
        n = len(tokens)
        following, preceding = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r[0], i, tokens[i], tokens[i + 1]) for i in range(n - 1)
                if (r := rules.get((tokens[i], tokens[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = following[i]
            if j < 0 or tokens[i] != a or tokens[j] != b:
                continue
            tokens[i], tokens[j] = rules[a, b][1], -1
            following[i] = following[j]
            if following[j] >= 0:
                preceding[following[j]] = i
            for left, right in ((preceding[i], i), (i, following[i])):
                if left >= 0 and right >= 0 and (r := rules.get((tokens[left], tokens[right]))) is not None:
                    heapq.heappush(heap, (r[0], left, tokens[left], tokens[right]))
        return [t for t in tokens if t >= 0]

    def stream(self, chunks: Iterable[bytes], block: int = BLOCK) -> Iterator[int]:
        """Tokens of one piece that arrives in chunks, each emitted once its right end is ``lookahead`` bytes behind."""
        held = b""
        for chunk in chunks:
            for at in range(0, len(chunk), block):
                held += chunk[at:at + block]
                if len(held) < block + self.lookahead:
                    continue
                done = 0
                for token in self.merge(held):
                    if done + len(self.bytes[token]) + self.lookahead > len(held):
                        break
                    done += len(self.bytes[token])
                    yield token
                held = held[done:]
        yield from self.merge(held)


class Encoder:
    """Texts to token ids, little-endian unsigned 32-bit, with a bounded memory of pieces met before."""

    def __init__(self, file: str):
        self.merges = load(file)
        self.pieces = regex.compile(PIECES)
        added = sorted(self.merges.added, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def piece(self, text: str) -> bytes:
        found = self.old.get(text)
        if found is None:
            data = text.encode()
            ids = list(self.merges.stream([data])) if len(data) > BLOCK else self.merges.merge(data)
            found = struct.pack(f"<{len(ids)}I", *ids)
            if len(data) > BLOCK:
                return found
        if len(self.new) >= REMEMBERED // 2:
            self.old, self.new = self.new, {}
        self.new[text] = found
        return found

    def plain(self, text: str) -> bytes:
        known, piece = self.new, self.piece
        try:
            return b"".join(map(known.__getitem__, pieces := self.pieces.findall(text)))
        except KeyError:
            return b"".join([self.new.get(p) or piece(p) for p in pieces])

    def encode(self, text: str) -> bytes:
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        parts = self.special.split(text)
        return b"".join(struct.pack("<I", self.merges.added[p]) if i % 2 else self.plain(p) for i, p in enumerate(parts))


class Decoder:
    """Token ids to text, piece by piece; between calls it holds the bytes of at most one unfinished character."""

    def __init__(self, file: str):
        self.bytes = load(file).bytes
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: np.ndarray, final: bool = False) -> str:
        return self.state.decode(b"".join(map(self.bytes.__getitem__, ids.tolist())), final)

    def decode(self, ids: bytes | None, step: int = 65_536) -> str:
        tokens = np.frombuffer(ids or b"", "<u4")
        self.state.reset()
        return "".join(self.feed(tokens[a:a + step]) for a in range(0, len(tokens), step)) + self.feed(tokens[:0], True)


@lru_cache(maxsize=2)
def load(file: str) -> Merges:
    return Merges(file)


@lru_cache(maxsize=2)
def encoder(file: str) -> Encoder:
    return Encoder(file)


def encode(df: DataFrame, file: str, text: str = "text", ids: str = "ids", n_tokens: str = "n_tokens") -> DataFrame:
    """Adds ``ids`` (binary, little-endian unsigned 32-bit) and ``n_tokens``; ``file`` must be at that path on all nodes."""

    def start():
        encode_one = encoder(file).encode

        def run(texts: pa.Array):
            made = [encode_one(t) if t else b"" for t in texts.to_pylist()]
            return pa.array(made, pa.binary()), pa.array([len(m) // 4 for m in made], pa.int64())

        return run

    return with_columns(df, [text], [T.StructField(ids, T.BinaryType()), T.StructField(n_tokens, T.LongType())], start)


def decode(df: DataFrame, file: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds ``decoded``, the text of the tokens in ``ids``."""

    def start():
        decoder = Decoder(file)
        return lambda column: (pa.array([decoder.decode(i) for i in column.to_pylist()], pa.string()),)

    return with_columns(df, [ids], [T.StructField(decoded, T.StringType())], start)


def encode_and_decode(df: DataFrame, file: str, text: str = "text", ids: str = "ids", n_tokens: str = "n_tokens",
                      decoded: str = "decoded") -> DataFrame:
    """Both in one pass, so a task needs one Python worker: adds ``ids``, ``n_tokens`` and ``decoded``."""

    def start():
        encode_one, decoder = encoder(file).encode, Decoder(file)

        def run(texts: pa.Array):
            made = [encode_one(t) if t else b"" for t in texts.to_pylist()]
            return (pa.array(made, pa.binary()), pa.array([len(m) // 4 for m in made], pa.int64()),
                    pa.array([decoder.decode(m) for m in made], pa.string()))

        return run

    adds = [T.StructField(ids, T.BinaryType()), T.StructField(n_tokens, T.LongType()), T.StructField(decoded, T.StringType())]
    return with_columns(df, [text], adds, start)
