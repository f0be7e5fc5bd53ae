"""Repair of conversations against a plain dynamic program and hand-made cases."""

import hashlib
import itertools
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from emberline.llm import queries, turns

BLANK = re.compile(r"[^\x20\x09-\x0D]")


def plain_edits(rows):
    """Cost, audit and turns of the cheapest edits: every state after every row, ways compared as (cost, audit)."""
    def inserted(ways):
        for _ in range(4):
            for state, (cost, audit, out) in list(ways.items()):
                goal, role = ("a", "assistant") if state == "u" else ("u", "user")
                new = (cost + 3, audit + "I", [*out, (role, "")])
                if goal not in ways or new[:2] < ways[goal][:2]:
                    ways[goal] = new
        return ways

    ways = inserted({"": (0, "", [])})
    for role, text, fault in rows:
        after = {}

        def offer(state, way):
            if state not in after or way[:2] < after[state][:2]:
                after[state] = way

        for state, (cost, audit, out) in ways.items():
            offer(state, (cost + 4, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            cost += 3 * (fault == "truncated")
            legal = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
            if role[:1] and role[:1] in legal:
                offer(role[:1], (cost, audit + "K", [*out, (role, text)]))
            offer("a" if state == "u" else "u", (cost + 3, audit + "R", [*out, ("assistant" if state == "u" else "user", text)]))
        ways = inserted(after)
    return min((way for state, way in ways.items() if state in ("", "a")), key=lambda w: w[:2])


def told(rows):
    """Faults of damaged rows in order."""
    seen, out = set(), []
    for role, text in rows:
        if not BLANK.search(text):
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if [c for c in text if BLANK.match(c)][-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def brute(table):
    """The query's rows from (conv_id, turn, role, text)."""
    convs = defaultdict(list)
    for conv, turn, role, text in table:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        rows = convs[conv]
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        rows += [] if kind == 0 else [(turn, role, text)] * (1 + (kind == 3))
    out = []
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults = told([r[1:] for r in rows])
        cost, audit, repaired = plain_edits([(r[1], r[2], f) for r, f in zip(rows, faults)])
        numbers = {r[0] for r in rows if r[0] is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out.append((conv, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, digest))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


SCHEMA = "conv_id long, turn long, role string, text string"


def repaired(spark, table):
    rows, gone = turns.damage(spark.createDataFrame(table, SCHEMA))
    return sorted((tuple(r) for r in turns.repair(rows, gone=gone).collect()), key=lambda r: (r[0] is not None, r[0] or 0))


ROLES = ["system", "user", "assistant", "tool", "", "User", None, "sys"]
TEXTS = ["Yes.", "No", "", " \t", None, "Yes.", "Why?", "\x0b.", "a. \n", ".", "é", "-"]


def test_query_equals_brute_force_on_the_given_table(spark, sf):
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    got = sorted(tuple(r) for r in queries.QUERIES["op11_turn_repair"](spark, sf).collect())
    assert got == brute([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]) and len(got) > 10


def test_nulls_ties_repeats_and_odd_roles(spark):
    rng = np.random.default_rng(3)
    table = []
    for conv in [None, *range(150)]:
        for _ in range(int(rng.integers(1, 12))):
            turn = None if rng.random() < 0.1 else int(rng.integers(0, 9))
            table.append((conv, turn, ROLES[rng.integers(len(ROLES))], TEXTS[rng.integers(len(TEXTS))]))
    assert repaired(spark, table) == brute(table)


def test_one_long_conversation_and_repeated_ones(spark):
    rng = np.random.default_rng(4)
    roles = ["user", "assistant"]
    table = [(7, t, roles[(t + (rng.random() < 0.1)) % 2], f"row {t % 900}{'.' * int(rng.random() < 0.9)}") for t in range(20_000)]
    table += [(100 + c, t, roles[t % 2], "Same.") for c in range(200) for t in range(4)]
    assert repaired(spark, table) == brute(table)


def test_all_rows_gone_and_empty_table(spark):
    gone = [(c, t) for c in range(40) for t in range(40) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    conv, turn = gone[0]
    assert repaired(spark, [(conv, turn, "user", "Hi.")]) == [
        (conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert repaired(spark, []) == []


def test_extra_columns_and_repaired_turns(spark):
    table = [(1, 0, "user", "Hi."), (1, 2, "user", "Again."), (1, 3, "assistant", "Yes"), (2, 0, "system", "Be kind.")]
    rows = spark.createDataFrame([(*r, "x", True) for r in table], SCHEMA + ", cost string, gone boolean")
    found = {r["conv_id"]: r for r in turns.repair(rows).collect()}
    assert (found[1]["cost"], found[1]["audit"], found[1]["gaps"]) == (6, "KIKK", 1)
    assert (found[2]["cost"], found[2]["audit"]) == (4, "D")
    out = sorted(tuple(r) for r in turns.repaired_turns(rows).collect())
    assert out == [(1, 0, "user", "Hi."), (1, 1, "assistant", ""), (1, 2, "user", "Again."), (1, 3, "assistant", "Yes")]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.binary(max_size=14).map(lambda b: bytes(x % 9 for x in b)), max_size=12))
def test_grammar_gives_the_plain_program_s_edits(strings):
    roles = ["system", "user", "assistant", "tool"]

    def rows(s):
        return [("user", "", "blank") if x == 0 else (roles[(x - 1) % 4], "t", "truncated" if x > 4 else "") for x in s]

    for s, edit in turns.Repairer().edits(strings).items():
        assert edit == plain_edits(rows(s))[:2]


@pytest.mark.parametrize("uses", [2, 8])
def test_re_pair_spells_what_it_was_given(uses):
    rng = np.random.default_rng(5)
    strings = [rng.integers(0, 3, n).astype(np.uint8) for n in (0, 1, 2, 500, 3, 77)] + [np.ones(33, np.uint8)]
    short, rules = turns.re_pair(strings, 3, uses)
    spelt = [[0], [1], [2]]
    for x, y in rules:
        spelt.append(spelt[x] + spelt[y])
    assert [[t for x in s for t in spelt[x]] for s in short] == [s.tolist() for s in strings]
    assert sum(map(len, short)) < 300 and max(x for r in rules for x in r) < len(spelt)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("DIKR", max_size=70), max_size=6), st.lists(st.text("DIKR", max_size=70), max_size=6))
def test_ropes_compare_as_texts(a, b):
    def rope(parts):
        out = ""
        for p in parts:
            out = turns.join(out, p)
        return out

    x, y = rope(a), rope(b)
    assert turns.flat(x) == "".join(a) and turns.before(x, y) == ("".join(a) < "".join(b))
