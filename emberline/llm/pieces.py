"""Byte-level BPE of whole batches of texts: pieces are cut and looked up with NumPy, new pieces go to the tokenizers library.

The tokenizer's pattern splits by classes of characters: contractions after an apostrophe, runs of letters, of digits or of
other signs with one blank before them, and white space. Here every character of a batch gets its class from a table and the
pattern's rules become comparisons of neighbours. A piece is known by a 64-bit hash of its characters; its ids stand in an
arena, found through a table of slots. A slot that holds another piece, or none, is a miss: distinct missing pieces of a batch
are encoded by the library and take their slots over, so memory is bounded and results don't depend on it.

Texts that hold the string of a special token go to the library whole. ``PieceTable`` is the part that does not depend on the
tokenizer; other encoders cut and encode pieces their own way.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from tokenizers import Tokenizer

from .bpe import byte_alphabet
from .words import Prefix

SPACE, LETTER, NUMBER, OTHER = range(4)
SLOT_BITS = 20
#: Ids the arena holds before it starts anew.
ARENA = 1 << 23


@lru_cache(maxsize=1)
def classes(file: str) -> np.ndarray:
    """The class of every code point, as the library tells it: what runs on between two letters, digits or signs is one too.

    Takes seconds, so the driver makes it and tasks get it. Planes that Unicode leaves empty are other signs.
    """
    cut = Tokenizer.from_file(file).pre_tokenizer.pre_tokenize_str
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    for a in [*range(0, 0x40000, 0x800), *range(0xE0000, 0xE1000, 0x800)]:
        if 0xD800 <= a < 0xE000:  # surrogates stand in no text
            continue
        text = "".join([f"a{c}a1{c}1.{c}." for c in map(chr, range(a, a + 0x800))])
        starts = np.zeros(len(text), dtype=bool)
        starts[[at for _, (at, _) in cut(text)]] = True
        runs_on = ~(starts.reshape(-1, 9)[:, [1, 4, 7]] | starts.reshape(-1, 9)[:, [2, 5, 8]])
        out[a:a + 0x800] = np.where(runs_on[:, 0], LETTER, np.where(runs_on[:, 1], NUMBER, np.where(runs_on[:, 2], OTHER, SPACE)))
    return out


def starts_of_pieces(codes: np.ndarray, edges: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Where pieces start, in the code points of texts that stand one after another and begin at ``edges``."""
    n = len(codes)
    kind = table[codes]
    begins = np.zeros(n + 1, dtype=bool)
    begins[edges] = True
    begins[n] = True  # a text's end is where the next one begins
    fresh = begins[:n].copy()
    fresh[1:] |= kind[1:] != kind[:-1]
    white = kind == SPACE
    blank = np.zeros(n, dtype=bool)  # a blank before, in the same text
    blank[1:] = (codes[:-1] == 0x20) & ~begins[1:n]
    out = fresh & (white | ~blank)
    out[:-1] |= white[:-1] & ~white[1:] & ~begins[1:n]  # the last white sign before something else stands apart or goes with it
    at = np.flatnonzero(out & (codes == 0x27))
    at = at[at + 1 < n]
    at = at[~begins[at + 1]]
    first = codes[at + 1]
    short = at[np.isin(first, [ord(c) for c in "stmd"])]
    long = at[np.isin(first, [ord(c) for c in "rvl"])]
    long = long[long + 2 < n]
    long = long[~begins[long + 2]]
    a, b = codes[long + 1], codes[long + 2]
    long = long[((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))]
    for places, size in ((short, 2), (long, 3)):
        out[places + 1] = False
        after = places + size
        out[after[after < n]] = True
    return np.flatnonzero(out)


class PieceTable:
    """Ids of texts whose pieces are encoded one by one; ids of pieces met before are remembered in bounded memory."""

    def __init__(self):
        self.empty()

    def starts(self, codes: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Where pieces start in the code points of texts that begin at ``edges``; the first starts at 0, and texts part pieces."""
        raise NotImplementedError

    def piece(self, text: str) -> list[int]:
        raise NotImplementedError

    def empty(self) -> None:
        self.keys = np.zeros(1 << SLOT_BITS, dtype=np.uint64)
        self.at = np.zeros(1 << SLOT_BITS, dtype=np.int64)
        self.size = np.zeros(1 << SLOT_BITS, dtype=np.int64)
        self.arena = np.zeros(1 << 20, dtype=np.uint32)
        self.filled = 0

    def _learn(self, h: np.ndarray, first: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Puts the ids of new pieces into the arena; where they stand, and how many."""
        ids = [self.piece(t) for t in first]
        size = np.array([len(i) for i in ids], dtype=np.int64)
        at = self.filled + np.cumsum(size) - size
        self.filled += int(size.sum())
        while self.filled > len(self.arena):
            self.arena = np.concatenate([self.arena, np.zeros_like(self.arena)])
        self.arena[self.filled - int(size.sum()):self.filled] = np.fromiter((x for i in ids for x in i), np.uint32, int(size.sum()))
        slot = h >> np.uint64(64 - SLOT_BITS)
        self.keys[slot], self.at[slot], self.size[slot] = h, at, size
        # of pieces with one slot in common the last stays, in all three tables alike
        return at, size

    def encode_plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each has."""
        if self.filled > ARENA:
            self.empty()
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        whole = "".join(texts)
        codes = np.frombuffer(whole.encode("utf-32-le"), dtype=np.uint32)
        ends = np.cumsum(lengths)
        if len(codes) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        edges = ends - lengths
        starts = self.starts(codes, edges)
        stops = np.append(starts[1:], len(codes))
        h = Prefix(codes).slices(starts, stops) | np.uint64(1)
        slot = h >> np.uint64(64 - SLOT_BITS)
        at, size = self.at[slot], self.size[slot]
        missing = np.flatnonzero(self.keys[slot] != h)
        if len(missing):
            new, first, which = np.unique(h[missing], return_index=True, return_inverse=True)
            place = missing[first]
            learnt = self._learn(new, [whole[a:b] for a, b in zip(starts[place].tolist(), stops[place].tolist())])
            at[missing], size[missing] = learnt[0][which], learnt[1][which]
        before = np.cumsum(size) - size
        total = int(before[-1] + size[-1])
        ids = self.arena[np.repeat(at - before, size) + np.arange(total)]
        upto = np.append(before, total)[np.searchsorted(starts, np.append(edges, len(codes)))]
        return ids, np.diff(upto)


class PieceEncoder(PieceTable):
    """Ids of texts under a byte-level BPE file, with no special tokens added."""

    def __init__(self, file: str, table: np.ndarray):
        super().__init__()
        self.table = table
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        with open(file, encoding="utf-8") as f:
            cut = json.load(f)["pre_tokenizer"]
        if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
            raise ValueError("the file's pre-tokenizer is not the plain byte-level one")
        self.library = Tokenizer.from_file(file)
        self.library.no_truncation()
        self.library.no_padding()
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, special)) or "(?!)").search
        self.signs = [sign for sign, _ in sorted(byte_alphabet().items(), key=lambda x: x[1])]

    def starts(self, codes: np.ndarray, edges: np.ndarray) -> np.ndarray:
        return starts_of_pieces(codes, edges, self.table)

    def piece(self, text: str) -> list[int]:
        return [t.id for t in self.library.model.tokenize("".join([self.signs[b] for b in text.encode()]))]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each has; texts with special tokens' strings go to the library."""
        own = {i: self.library.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts) if self.special(t)}
        ids, counts = self.encode_plain(["" if i in own else t for i, t in enumerate(texts)])
        if not own:
            return ids, counts
        parts = np.split(ids, np.cumsum(counts)[:-1])
        rest = [np.array(own[i], dtype=np.uint32) if i in own else p for i, p in enumerate(parts)]
        return np.concatenate(rest), np.array([len(r) for r in rest], dtype=np.int64)


_made: dict[str, PieceEncoder] = {}


def encoder(file: str, table: np.ndarray) -> PieceEncoder:
    """One encoder a worker, with what it remembers; ``table`` is ``classes`` of the file."""
    if file not in _made:
        _made.clear()
        _made[file] = PieceEncoder(file, table)
    return _made[file]


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids with ``end`` after each text's, and the counts with it."""
    out = np.full(len(ids) + len(counts), end, dtype=ids.dtype)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
    return out, counts + 1


def binary(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Numbers, cut by ``counts``, as little-endian bytes of each row."""
    offsets = np.concatenate([[0], np.cumsum(counts)]) * values.dtype.itemsize
    data = np.ascontiguousarray(values.astype(values.dtype.newbyteorder("<")))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
