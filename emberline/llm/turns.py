"""Repair of conversations' structure by a dynamic program over grammar-compressed sequences.

A conversation becomes a string of symbols, one a row: what its role begins with, and its fault. The cheapest edits that give
``(s?(ua)+)?`` come from an automaton of four states: a row is a 4 x 4 matrix of (cost, audit), and matrices multiply in the
(min, +) algebra, where ties go to the audit that sorts first.

**Grammar.** Re-Pair replaces the commonest pair of neighbouring symbols by a new one until none is common, over all distinct
strings of a batch of conversations at once. Each rule's matrix is computed once, from those of its two sides, and serves every
conversation that holds it; rules of the same expansion keep their matrix from batch to batch. A string is then a few products
of a vector with its rules' matrices.

**Audits** are ropes: a rule's audit joins those of its sides, so equal parts exist once. Two audits of one cost over the same
rows are never prefixes of each other (both hold a letter a row, and the rest are insertions, which cost), so the least of the
joined is the join of the least, and rules may be evaluated without their surroundings.

**Plan.** Rows that repeat an earlier role and text are found by an aggregate of 128-bit digests, which combines before its
shuffle; only texts that recur at different turns come out of it, and adaptive execution splits that join where one text is hot.
Then one shuffle by conversation, sorted. A task walks its sorted rows and holds a byte a row of a batch of conversations; texts
wait in a spool that goes to a deleted temporary file beyond 32 MB. A digest of a whole conversation is sequential by
definition, so a hot conversation is one sorted stream in one task, in memory of a few bytes a row; its symbols are cut in blocks.

Cases: null roles and texts are one space; null turns come first; rows of one turn go by role, then text, and equal
rows stand together; a null conversation id is a conversation; a conversation whose rows are all ``gone`` has zeros, an empty audit
and the digest of nothing; empty tables give empty tables; columns not named are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .batches import bounded

# What edits cost, white space, and the ends of whole sentences.
DELETE, REROLE, INSERT, UNFINISHED = 4, 3, 3, 3
BLANKS = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")

#: States after the rows read so far: nothing yet, a system turn, a user's turn, an answer.
START, SYSTEM, USER, ANSWER = range(4)
#: Faults, in order of precedence.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
#: The symbol of a row that must go; others are 1 + role's class + 4 if truncated.
MUST_GO = 0
INITIALS = {"s": 0, "u": 1, "a": 2}

#: A pair becomes a rule where it occurs this often: a matrix costs as much as four steps of a vector, and more to keep.
RULE_USES = 8
#: Symbols of one grammar, and rows and bytes of the conversations that wait for one.
BLOCK, BATCH_ROWS, SPOOL_BYTES = 16_384, 16_384, 32 << 20
#: Matrices kept from batch to batch.
KEPT_RULES = 20_000


# ---- Audits ------------------------------------------------------------------

class Rope:
    """Two texts in a row; one object for the same two sides."""

    __slots__ = ("left", "right", "size")

    def __init__(self, left: "str | Rope", right: "str | Rope", size: int):
        self.left, self.right, self.size = left, right, size


def size(text: "str | Rope") -> int:
    return text.size if isinstance(text, Rope) else len(text)


def join(a: "str | Rope", b: "str | Rope") -> "str | Rope":
    n = size(a) + size(b)
    if n <= 64:
        return flat(a) + flat(b)
    return a if size(b) == 0 else b if size(a) == 0 else Rope(a, b, n)


def leaves(text: "str | Rope") -> Iterator[str]:
    left = [text]
    while left:
        top = left.pop()
        if isinstance(top, Rope):
            left += [top.right, top.left]
        else:
            yield top


def flat(text: "str | Rope") -> str:
    return text if isinstance(text, str) else "".join(leaves(text))


def before(a: "str | Rope", b: "str | Rope") -> bool:
    """Whether ``a`` sorts before ``b``; parts that are the same object are passed over."""
    x, y = [a], [b]
    while x and y:
        p, q = x.pop(), y.pop()
        if p is q:
            continue
        if isinstance(p, Rope) and size(p) >= size(q):
            x += [p.right, p.left]
            y.append(q)
        elif isinstance(q, Rope):
            y += [q.right, q.left]
            x.append(p)
        else:
            n = min(len(p), size(q))
            if p[:n] != q[:n]:
                return p[:n] < q[:n]
            if len(p) > n:
                x.append(p[n:])
            if len(q) > n:
                y.append(q[n:])
    return any(map(size, y)) and not any(map(size, x))


# ---- Matrices ----------------------------------------------------------------

#: (cost, audit) of the cheapest way between two states, or None.
Entry = tuple[int, "str | Rope"] | None


def least(a: Entry, b: Entry) -> Entry:
    if a is None or b is None:
        return a or b
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return b if before(b[1], a[1]) else a


def after(a: Entry, b: Entry) -> Entry:
    return None if a is None or b is None else (a[0] + b[0], join(a[1], b[1]))


def step(vector: list[Entry], matrix: list[list[Entry]]) -> list[Entry]:
    out: list[Entry] = [None] * 4
    for a, row in zip(vector, matrix):
        if a is not None:
            for j, b in enumerate(row):
                if b is not None:
                    out[j] = least(out[j], after(a, b))
    return out


def times(a: list[list[Entry]], b: list[list[Entry]]) -> list[list[Entry]]:
    return [step(row, b) for row in a]


def insertions() -> list[list[Entry]]:
    """Any number of inserted turns: each inserted turn moves on to a user's turn or its answer."""
    out: list[list[Entry]] = [[None] * 4 for _ in range(4)]
    for i in range(4):
        out[i][i] = (0, "")
    for i in (START, SYSTEM):
        out[i][USER], out[i][ANSWER] = (INSERT, "I"), (2 * INSERT, "II")
    out[USER][ANSWER], out[ANSWER][USER] = (INSERT, "I"), (INSERT, "I")
    return out


def row_matrix(symbol: int) -> list[list[Entry]]:
    """One row's edits, after any insertions before it."""
    out: list[list[Entry]] = [[None] * 4 for _ in range(4)]
    for i in range(4):
        out[i][i] = (DELETE, "D")
    if symbol != MUST_GO:
        role, extra = (symbol - 1) % 4, UNFINISHED * (symbol > 4)
        for i, j in ((START, USER), (SYSTEM, USER), (ANSWER, USER), (USER, ANSWER)):
            out[i][j] = least(out[i][j], (REROLE + extra, "R"))
            if role == INITIALS["ua"[j == ANSWER]]:
                out[i][j] = least(out[i][j], (extra, "K"))
        if role == INITIALS["s"]:
            out[START][SYSTEM] = (extra, "K")
    return times(insertions(), out)


# ---- Grammar -----------------------------------------------------------------

def re_pair(strings: list[np.ndarray], terminals: int, uses: int = RULE_USES) -> tuple[list[np.ndarray], list[tuple[int, int]]]:
    """Strings over terminals and rules; rule ``i`` is the symbol ``terminals + i`` and stands for a pair of earlier symbols."""
    apart = np.full(1, -1, dtype=np.int64)
    text = np.concatenate([x for s in strings for x in (s.astype(np.int64), apart)]) if strings else apart[:0]
    rules: list[tuple[int, int]] = []
    while len(text) > 1:
        wide = terminals + len(rules)
        pairs = np.where((text[:-1] >= 0) & (text[1:] >= 0), text[:-1] * wide + text[1:], -1)
        found, counts = np.unique(pairs[pairs >= 0], return_counts=True)
        if len(found) == 0 or counts.max() < uses:
            break
        pair = found[counts.argmax()]
        at = np.flatnonzero(pairs == pair)
        if len(at) > 1:  # of overlapping pairs of one symbol every second is taken
            fresh = np.diff(at, prepend=-2) != 1
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(fresh, place, 0))) % 2 == 0]
        if len(at) < uses:
            break
        rules.append((int(pair // wide), int(pair % wide)))
        text[at] = wide
        text = np.delete(text, at + 1)
    ends = np.flatnonzero(text < 0)
    return [s[:-1] for s in np.split(text, ends + 1)[:len(strings)]], rules


class Repairer:
    """Cheapest edits of symbol strings; matrices are shared by all strings it is asked about."""

    TERMINALS = 9

    def __init__(self):
        self.rows = [row_matrix(s) for s in range(self.TERMINALS)]
        self.kept: dict[bytes, list[list[Entry]]] = {}
        self.tail = insertions()

    def edits(self, strings: list[bytes]) -> dict[bytes, tuple[int, str]]:
        """Cost and audit of each distinct string."""
        distinct = list(dict.fromkeys(strings))
        pieces = [(s, a) for s in distinct for a in range(0, len(s), BLOCK)]
        ways: dict[bytes, list[list[list[Entry]]]] = {s: [] for s in distinct}
        batch: list[tuple[bytes, int]] = []
        held = 0
        for s, a in pieces:
            batch.append((s, a))
            held += min(BLOCK, len(s) - a)
            if held >= BLOCK:
                self._add(batch, ways)
                batch, held = [], 0
        self._add(batch, ways)
        return {s: self._cheapest(ways[s]) for s in distinct}

    def _add(self, batch: list[tuple[bytes, int]], ways: dict[bytes, list]) -> None:
        """Appends to each string the matrices of its next block, made from one grammar of the batch."""
        short, rules = re_pair([np.frombuffer(s, np.uint8)[a:a + BLOCK] for s, a in batch], self.TERMINALS)
        matrices, spelt = list(self.rows), [bytes([t]) for t in range(self.TERMINALS)]
        if len(self.kept) > KEPT_RULES:
            self.kept = {}
        for x, y in rules:
            whole = spelt[x] + spelt[y]
            if whole not in self.kept:
                self.kept[whole] = times(matrices[x], matrices[y])
            matrices.append(self.kept[whole])
            spelt.append(whole)
        for (s, _), symbols in zip(batch, short):
            ways[s] += [matrices[x] for x in symbols.tolist()]

    def _cheapest(self, matrices: list[list[list[Entry]]]) -> tuple[int, str]:
        vector: list[Entry] = [(0, ""), None, None, None]
        for matrix in matrices:
            vector = step(vector, matrix)
        vector = step(vector, self.tail)
        cost, audit = least(vector[START], vector[ANSWER])
        return cost, flat(audit)


def apply_edits(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """Repaired (role, text) of a conversation's rows: the letters say which role each rewritten or new turn gets."""
    state = START
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter != "K":
            role = "assistant" if state == USER else "user"
        state = SYSTEM if role[:1] == "s" else USER if role[:1] == "u" else ANSWER
        yield role, text


# ---- Spark -------------------------------------------------------------------

def symbol(role: str, fault: int) -> int:
    return MUST_GO if fault in (BLANK, DUPLICATE) else 1 + INITIALS.get(role[:1], 3) + (4 if fault == TRUNCATED else 0)


@dataclass
class Seen:
    """What a walk keeps of one conversation."""

    conv: object
    low: int | None = None
    high: int | None = None
    turns: int = 0
    faults: list[int] = field(default_factory=lambda: [0] * 4)
    illegal: int = 0
    symbols: bytearray = field(default_factory=bytearray)
    last: tuple | None = None

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if self.last is not None:
            self.illegal += self.last[1][:1] + role[:1] not in ("su", "ua", "au")
            if fault != BLANK and self.last == (turn, role, text):
                fault = DUPLICATE
        if turn is not None and (self.last is None or turn != self.last[0]):
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        self.faults[fault] += 1
        self.symbols.append(symbol(role, fault))
        self.last = (turn, role, text)

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


class Spool:
    """Roles and texts of rows in order, in memory or in a nameless temporary file."""

    HEAD = struct.Struct("<II")

    def __init__(self):
        self.file, self.bytes = tempfile.SpooledTemporaryFile(SPOOL_BYTES), 0

    def add(self, role: str, text: str) -> None:
        r, t = role.encode(), text.encode()
        self.bytes += self.file.write(self.HEAD.pack(len(r), len(t)) + r + t)

    def rows(self) -> Iterator[tuple[str, str]]:
        self.file.seek(0)
        while head := self.file.read(self.HEAD.size):
            r, t = self.HEAD.unpack(head)
            yield self.file.read(r).decode(), self.file.read(t).decode()


def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Seen, int, str, Iterator[tuple[str, str]]]]:
    """Conversations of a sorted partition with their cost, audit and repaired turns (to be read before the next comes)."""
    repairer, pending, spool = Repairer(), [], Spool()

    def told():
        edits = repairer.edits([bytes(c.symbols) for c in pending])
        rows = spool.rows()
        for c in pending:
            cost, audit = edits[bytes(c.symbols)]
            n = len(c.symbols)
            own = (next(rows) for _ in range(n))
            yield c, cost, audit, apply_edits(audit, own)
            for _ in own:  # what the reader left
                pass

    held = 0
    for batch in batches:
        for conv, gone, turn, role, text, fault in zip(*[c.to_pylist() for c in batch.columns]):
            if not pending or conv != pending[-1].conv:
                if held >= BATCH_ROWS or spool.bytes >= SPOOL_BYTES:
                    yield from told()
                    pending, spool, held = [], Spool(), 0
                pending.append(Seen(conv))
            if not gone:
                pending[-1].add(turn, role, text, fault)
                spool.add(role, text)
                held += 1
    if pending:
        yield from told()


def sorted_rows(turns: DataFrame, conv_id: str, turn: str, role: str, text: str, gone: Column | None) -> DataFrame:
    """Rows with the faults that Spark can tell, one conversation after the other, in order of turn, role and text."""
    rows = turns.select(
        F.col(f"`{conv_id}`").alias("conv"), (F.lit(False) if gone is None else F.coalesce(gone, F.lit(False))).alias("gone"),
        F.col(f"`{turn}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role}`").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(" ")).alias("text"))
    rows = rows.withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit(1), "role", "text")})
    firsts = (
        rows.where(~F.col("gone")).groupBy("conv", "h1", "h2")
        .agg(F.max(F.col("turn").isNull()).alias("null_first"), F.min("turn").alias("first"), F.max("turn").alias("last"))
        .where((F.col("null_first") & F.col("first").isNotNull()) | (F.col("first") < F.col("last"))).drop("last")
        .withColumnsRenamed({"conv": "conv_", "h1": "h1_", "h2": "h2_"})
    )
    same = F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("h1") == F.col("h1_")) & (F.col("h2") == F.col("h2_"))
    later = F.coalesce(F.when(F.col("null_first"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("first")), F.lit(False))
    end = F.rtrim("text", F.lit(BLANKS))
    fault = (F.when(end == "", BLANK).when(later, DUPLICATE).when(~F.substring(end, -1, 1).isin(*ENDS), TRUNCATED).otherwise(SOUND))
    marked = rows.join(firsts, same, "left").select(
        "conv", "gone", F.when(~F.col("gone"), F.col("turn")).alias("turn"), F.when(~F.col("gone"), F.col("role")).alias("role"),
        F.when(~F.col("gone"), F.col("text")).alias("text"), fault.alias("fault"))
    return marked.repartition("conv").sortWithinPartitions("conv", "gone", F.col("turn").asc_nulls_first(), "role", "text")


def repair(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           gone: Column | None = None) -> DataFrame:
    """One row a conversation: its faults, the cheapest edits, and the digest of the repaired turns.

    Columns: the conversation's id, ``gaps`` (turn numbers missing between the least and the greatest), ``blank``, ``duplicate``,
    ``truncated``, ``illegal`` (neighbours in an order no conversation has), ``cost``, ``audit`` (letters of the edits in order),
    ``repaired_sha256`` (of ``role:text`` of the repaired turns, joined by newlines). Rows that are ``gone`` only name their conversation.
    """
    bounded(turns.sparkSession)
    rows = sorted_rows(turns, conv_id, turn, role, text, gone)
    kind = rows.schema["conv"].dataType
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = T.StructType([T.StructField(conv_id, kind), *[T.StructField(n, T.LongType()) for n in numbers],
                           T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out))
            kinds = [arrow, *[pa.int64()] * len(numbers), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=schema.names)

        letters = 0
        for c, cost, audit, repaired in walk(batches):
            digest, joint = hashlib.sha256(), b""
            for r, t in repaired:
                digest.update(joint + f"{r}:{t}".encode())
                joint = b"\n"
            _, blank, duplicate, truncated = c.faults
            out.append((c.conv, c.gaps, blank, duplicate, truncated, c.illegal, cost, audit, digest.hexdigest()))
            letters += len(audit)
            if len(out) >= 4_096 or letters >= 4 << 20:
                yield flush()
                out, letters = [], 0
        if out:
            yield flush()

    return rows.mapInArrow(run, schema)


def repaired_turns(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                   gone: Column | None = None) -> DataFrame:
    """The repaired conversations, one row a turn: id, ``place`` from 0, role and text."""
    bounded(turns.sparkSession)
    rows = sorted_rows(turns, conv_id, turn, role, text, gone)
    kind = rows.schema["conv"].dataType
    schema = T.StructType([T.StructField(conv_id, kind), T.StructField("place", T.LongType()), T.StructField(role, T.StringType()),
                           T.StructField(text, T.StringType())])
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out), (arrow, pa.int64(), pa.string(), pa.string()))], names=schema.names)

        held = 0
        for c, _, _, repaired in walk(batches):
            for place, (r, t) in enumerate(repaired):
                out.append((c.conv, place, r, t))
                held += len(t)
                if len(out) >= 4_096 or held >= 2 << 20:
                    yield flush()
                    out, held = [], 0
        if out:
            yield flush()

    return rows.mapInArrow(run, schema)


def damage(turns: DataFrame) -> tuple[DataFrame, Column]:
    """Rows of ``conv_id, turn, role, text`` damaged by the checksum of ``conv_id:turn``, and which of them are gone.

    Remainders of 20: 0 drops the row, 1 empties its text, 2 takes the ends of its sentences, 3 repeats it, 4 makes it a user's.
    """
    named = F.concat(*[x for c in ("conv_id", "turn") for x in (F.coalesce(F.col(c).cast("string"), F.lit(" ")), F.lit(":"))][:3])
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(named) % 20).alias("kind"))
    rows = rows.withColumns({
        "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role")),
        "text": F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")),
        "copy": F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))})
    return rows.drop("copy"), F.col("kind") == 0
