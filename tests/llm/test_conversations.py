"""Repair of conversations against a plain programme over rows and states, and that against all edits."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest

from quarry.llm import conversations as C

GOOD = re.compile(r"(s?(ua)+)?")


def plain_edits(rows):
    """(cost, edits) of (initial, fault) rows: the least over states, row by row."""
    ways = {0: (0, "")}

    def inserted(ways):
        for _ in range(3):
            for p, (cost, edits) in list(ways.items()):
                for i in "ua":
                    q = C.STEPS.get((p, i))
                    if q is not None and (q not in ways or (cost + 5, edits + "I") < ways[q]):
                        ways[q] = (cost + 5, edits + "I")
        return ways

    for initial, fault in rows:
        new = {}
        for p, (cost, edits) in inserted(ways).items():
            options = [(p, 2, "D")]
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                options += [(C.STEPS[p, i], more + (i != initial), "K" if i == initial else "R") for i in "sua" if (p, i) in C.STEPS and (i == initial or i != "s")]
            for q, c, e in options:
                if q not in new or (cost + c, edits + e) < new[q]:
                    new[q] = (cost + c, edits + e)
        ways = new
    ways = inserted(ways)
    return min(ways[q] for q in (0, 3) if q in ways)


def all_edits(rows):
    """The same by trying everything, with at most one insertion in each place."""
    best = None
    for inserts in itertools.product(["", "u", "a"], repeat=len(rows) + 1):
        for edits in itertools.product("DKua", repeat=len(rows)):
            roles, text, cost = inserts[0], "I" * len(inserts[0]), 5 * len(inserts[0])
            for (initial, fault), e, i in zip(rows, edits, inserts[1:], strict=True):
                if fault in ("blank", "duplicate") and e != "D":
                    break
                cost += 5 * len(i) + (2 if e == "D" else (0 if e == "K" else 1) + 5 * (fault == "truncated"))
                roles += {"D": "", "K": initial}.get(e, e) + i
                text += {"u": "R", "a": "R"}.get(e, e) + "I" * len(i)
            else:
                if GOOD.fullmatch(roles) and (best is None or (cost, text) < best):
                    best = cost, text
    return best


def plain(table):
    """Rows (conv_id, turn, role, text) to the result, conversation by conversation."""
    out, by_conv = {}, {}
    for conv, turn, role, text in table:
        rows = by_conv.setdefault(conv, [])
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        rows += [(turn, "user" if case == 4 else role, text)] * {0: 0, 3: 2}.get(case, 1)
    for conv, rows in by_conv.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        faults, seen = [], set()
        for _, role, text in rows:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
            seen.add((role, text))
        initials = [r[1][:1] if r[1][:1] in ("s", "u", "a") else "?" for r in rows]
        cost, audit = plain_edits(list(zip(initials, faults, strict=True)))
        turns = [r[0] for r in rows if r[0] is not None]
        lines, at, state = [], 0, 0
        for e in audit:
            if e != "I":
                _, role, text = rows[at]
                at += 1
            if e != "D":
                initial = role[:1] if e == "K" else "a" if state == 2 else "u"
                lines.append((role if e == "K" else C.NAMES[initial]) + ":" + ("" if e == "I" else text))
                state = C.STEPS[state, initial]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def test_plain_programme_finds_the_best_of_all_edits():
    rng = np.random.default_rng(1)
    for n in range(5):
        for _ in range(25 if n < 4 else 6):
            rows = [("sua?"[rng.integers(4)], [None, None, "blank", "truncated"][rng.integers(4)]) for _ in range(n)]
            assert plain_edits(rows) == all_edits(rows)


@pytest.mark.parametrize("pairs,rounds", [(256, 16), (3, 40), (1, 2)])
def test_grammar_gives_the_same_edits(pairs, rounds):
    rng = np.random.default_rng(2)
    faults = [None, "blank", "duplicate", "truncated"]
    sets = [[("sua?"[rng.choice(4, p=[0.1, 0.45, 0.4, 0.05])], int(rng.choice(4, p=[0.7, 0.1, 0.1, 0.1]))) for _ in range(rng.integers(0, 60))] for _ in range(80)]
    sets += [[("u", 0), ("a", 0)] * 100, [("u", 0)] * 77, [("?", 3)] * 40]
    texts = ["".join(C.GONE if f in (1, 2) else chr(65 + 4 * "sua?".index(i) + f) for i, f in s) for s in sets]
    found = []
    for _ in range(rounds):
        keys, n = np.unique(C.pair_keys(C.Grammar(found).compress(C._symbols(texts))), return_counts=True)
        top = sorted(((int(k), int(m)) for k, m in zip(keys, n, strict=True) if k >= 0 and m > 1), key=lambda x: (-x[1], x[0]))[:pairs]
        if not top:
            break
        found.append(C.choose_pairs(top))
    grammar = C.Grammar(found)
    short = grammar.compress(C._symbols(texts))
    assert len(short) < len(C._symbols(texts))
    for s, p in zip(sets, np.split(short, np.flatnonzero(short < 0) + 1)[:-1], strict=True):
        assert grammar.solve(p[:-1]) == plain_edits([(i, faults[f]) for i, f in s])


def _check(spark, table, **how):
    rows = spark.createDataFrame([(*r, 7) for r in table], "conv_id long, turn long, role string, text string, cost int").repartition(4)
    got = {r[0]: tuple(r)[1:] for r in C.repair(rows, **how).collect()}
    assert got == plain(table)
    return got


def test_nulls_ties_copies_and_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK_BITS", 3)
    rng = np.random.default_rng(4)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "User"], ["Yes.", "no", "", None, " \n", "Why? ", "é!\x0b", "What.\xa0", "Yes.", "a" * 5000 + "."]
    table = [(int(rng.integers(0, 60)), int(rng.integers(0, 9)), roles[rng.integers(7)], texts[rng.integers(10)]) for _ in range(400)]
    table += [(None, None if k % 3 else k, roles[k % 3], texts[k % 10]) for k in range(30)]
    table += [(100, k, ("user", "assistant")[k % 2], f"Row {k}.") for k in range(500)] + [(101, 5, "user", "Same.")] * 200
    table += [(102 + k, 0, "system", "Only.") for k in range(60)] + [(200, None, None, None)]
    got = _check(spark, table)
    assert any(v[6] == "" for v in got.values()) and len(got[100][6]) > 450


def test_the_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    got = _check(spark, [tuple(r) for r in rows])
    assert sum(v[5] > 0 for v in got.values()) > 40


def test_empty_table(spark):
    assert C.repair(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).collect() == []
