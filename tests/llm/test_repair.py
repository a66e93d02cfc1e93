"""Repair of conversations against plain dynamic programming, in pieces and whole, and its edge cases."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from marquee.llm import repair
from marquee.llm.queries import QUERIES

SPACES = " \t\n\x0b\x0c\r"


def least(turns: str) -> tuple[int, str]:
    """(cost, edits) by going through all states turn by turn, strings and all."""
    best = {0: (0, "")}

    def with_inserts(ways):
        ways = dict(ways)
        for _ in range(3):
            for state, (cost, edits) in list(ways.items()):
                to, way = (3 if state == 2 else 2), (cost + 5, edits + "I")
                ways[to] = min(ways.get(to, way), way)
        return ways

    for t in turns:
        after: dict[int, tuple[int, str]] = {}
        for state, (cost, edits) in with_inserts(best).items():
            ways = [(state, cost + 2, "D")]
            if t != "d":
                extra, small = (5 if t.isupper() else 0), t.lower()
                fits = {"s": state == 0, "u": state != 2, "a": state == 2, "x": False}[small]
                if fits:
                    ways.append(({"s": 1, "u": 2, "a": 3}[small], cost + extra, "K"))
                ways.append((3 if state == 2 else 2, cost + extra + 1, "R"))
            for to, paid, edit in ways:
                way = (paid, edits + edit)
                after[to] = min(after.get(to, way), way)
        best = after
    ended = with_inserts(best)
    return min(ended[s] for s in (0, 3) if s in ended)


def damaged(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(name.encode()) % 20
        if fault:
            role = "user" if fault == 4 else role
            text = "" if fault == 1 else "".join(c for c in text if c not in ".!?") if fault == 2 else text
            yield from [(conv, turn, role, text)] * (2 if fault == 3 else 1)


def expected(rows):
    """conversation -> (gaps, blank, duplicate, truncated, illegal, cost, audit, lines)"""
    found = {}
    for conv in {r[0] for r in rows}:
        key = lambda r: (r[1] is not None, r[1], r[2], hashlib.sha256(r[3].encode()).digest())
        turns = sorted((r for r in rows if r[0] == conv), key=key)
        letters, counts, seen = "", [0, 0, 0], set()
        for _, _, role, text in turns:
            bare, initial = text.strip(SPACES), role[:1] if role[:1] in ("s", "u", "a") else "x"
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            letters += "d" if fault in (0, 1) else initial.upper() if fault == 2 else initial
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        known = [r[1] for r in turns if r[1] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        cost, audit = least(letters)
        lines, state, left = [], 0, iter(turns)
        for edit in audit:
            turn = None if edit == "I" else next(left)
            if edit == "K":
                state = {"s": 1, "u": 2, "a": 3}[turn[2][0]]
                lines.append((turn[2], turn[3]))
            elif edit in "IR":
                state = 3 if state == 2 else 2
                lines.append(("assistant" if state == 3 else "user", turn[3] if turn else ""))
        found[conv] = (gaps, *counts, illegal, cost, audit, lines)
    return found


def held_against(got, want):
    assert len(got) == len(want)
    for r in got:
        *numbers, audit, lines = want[r[0]]
        digest = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in lines).encode()).hexdigest()
        assert tuple(r[1:]) == (*numbers, audit, digest), r[0]


def test_search_and_pieces():
    random.seed(3)
    for _ in range(800):
        turns = "".join(random.choice("dsuaxSUAXuauaua") for _ in range(random.randrange(0, 14)))
        assert repair.whole(turns) == least(turns)
        width = random.randrange(1, 5)
        cut = [turns[i : i + width] for i in range(0, len(turns), width)]
        found = [repair.piece(c) for c in cut]
        cost, ways, ending = repair.chain([f[0] for f in found], [f[1] for f in found])
        assert (cost, "".join(f[2][w] for f, w in zip(found, ways)) + ending) == least(turns)


@pytest.mark.parametrize("turns", ["u" * 300, "s" * 120, "uuaa" * 70, "U" * 200, "x" * 200])
def test_long_runs(turns):
    assert repair.Search(turns).cheapest() == least(turns)


def test_query(spark, tiny):
    rows = [tuple(r) for r in spark.read.parquet(f"{tiny}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = expected(list(damaged(rows)))
    nothing = (0, 0, 0, 0, 0, 0, "", [])
    held_against(QUERIES["op11_repair"](spark, tiny).collect(), {c: want.get(c, nothing) for c in {r[0] for r in rows}})


@pytest.mark.parametrize("per_piece", [1, 3, 256])
def test_edges(spark, per_piece):
    random.seed(5)
    said = ["Hello.", "yes", "No!", "", " \t", None, "Hello.", "x" * 30_000 + "?", "Ünï."]
    rows = [(c, t, random.choice(["user", "assistant", "system", "tool", "", None, "User"]), random.choice(said))
            for c in (1, 2, 3, None) for t in [*range(12), None, None, 5, 5, 40]]
    rows += [(7, t, "user", "same.") for t in range(40)] + [(8, 0, "user", "same.")] * 30
    rows += [(9, -(2**63), "user", "a."), (9, 2**63 - 1, "assistant", "b.")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    table = table.withColumns({c: F.lit(c) for c in ("id", "h", "step", "edits", "part", "n", "a")})
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    want = expected(plain)
    want[9] = (None, *want[9][1:])
    held_against(repair.repair_conversations(table, per_piece=per_piece).collect(), want)
    left = {}
    for r in sorted(repair.repaired_turns(table, per_piece=per_piece).collect(), key=lambda r: r.turn):
        left.setdefault(r.conv_id, []).append((r.role, r.text))
    assert left == {c: w[-1] for c, w in want.items() if w[-1]}
    held_against(repair.repair_conversations(repair.damage(table), per_piece=per_piece, ids=table).collect(), {
        c: w if (w := expected(list(damaged(rows))).get(c)) else (0, 0, 0, 0, 0, 0, "", []) for c in want if c != 9
    } | {9: _nine(rows)})


def _nine(rows):
    w = expected(list(damaged(rows))).get(9, (0, 0, 0, 0, 0, 0, "", []))
    return (w[0] if w[0] < 2**63 else None, *w[1:])


def test_empty_and_without_turns(spark):
    schema = "conv_id long, turn long, role string, text string"
    none = spark.createDataFrame([], schema)
    assert repair.repair_conversations(repair.damage(none)).collect() == []
    ids = spark.createDataFrame([(4,), (4,), (None,)], "conv_id long")
    got = repair.repair_conversations(none, ids=ids).collect()
    assert {tuple(r) for r in got} == {(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in (4, None)}
    assert len(got) == 2
