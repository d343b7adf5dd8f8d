"""Conversation repair against a plain version, with nulls, ties, repeated rows, long conversations cut into runs, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
from harness import compare, duck

from assayer.llm import alignment, queries, turns

SF = "/root/testdata/sf0.001"
COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def cheapest(initials, faults):
    """(cost, audit) over all edits, turn by turn."""
    n = len(initials)

    @lru_cache(None)
    def go(i, state, inserted):
        out = [(0, "")] if i == n and state in ("", "a") else []
        role = "a" if state == "u" else "u"

        def way(cost, edit, rest):
            out.append((cost + rest[0], edit + rest[1]))

        if inserted < 3:
            way(5, "I", go(i, role, inserted + 1))
        if i < n:
            way(2, "D", go(i + 1, state, 0))
            if faults[i] not in "bd":
                late = 5 if faults[i] == "t" else 0
                if initials[i] == role or (initials[i] == "s" and state == ""):
                    way(late, "K", go(i + 1, initials[i], 0))
                way(late + 1, "R", go(i + 1, role, 0))
        return min(out, default=(1 << 60, ""))

    for i in range(n, 0, -1):  # from the end, so the recursion stays flat
        for state in ("", "s", "u", "a"):
            go(i, state, 0)
    return go(0, "", 0)


def plain(rows, damage=True):
    found = {}
    for conv, turn, role, text in rows:
        mine = found.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        draw = zlib.crc32(name.encode()) % 20 if damage else 9
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        mine += [(turn, "user" if draw == 4 else role, text)] * {0: 0, 3: 2}.get(draw, 1)
    out = []
    for conv, mine in found.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, faults = set(), ""
        for _, role, text in mine:
            body = text.rstrip(" \t\n\x0b\f\r")
            faults += "b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "."
            seen.add((role, text))
        initials = "".join(r[:1] if r[:1] in ("s", "u", "a") else "o" for _, r, _ in mine)
        cost, audit = cheapest(initials, faults)
        state, i, made = "", 0, []
        for e in audit:
            role, text = ("", "") if e == "I" else mine[i][1:]
            i += e != "I"
            if e != "D":
                if e != "K":
                    role = "assistant" if state == "u" else "user"
                state = role[0]
                made.append(f"{role}:{text}")
        known = [t for t, _, _ in mine if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        out.append((conv, gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(rows, edits):
    return sorted((tuple(r[c] for c in COLUMNS) for r in turns.report(rows, edits).collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", True, "z") for r in rows],
                                 "conv_id long, turn long, role string, text string, slice string, at int, audit string, gone boolean, digest string")


ODD = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hello?"), (1, 2, "assistant", "Hi."), (2, 0, "user", None), (2, 1, None, "What."), (3, None, "user", "A."),
       (3, None, "assistant", "B."), (3, 7, "tool", "C!"), (None, 0, "user", "No id."), (None, None, None, None), (None, 3, "assistant", "Yes\n "), (4, 5, "", "."),
       (4, 5, "", "."), (4, 5, "user", "tie a."), (4, 5, "user", "tie b."), (5, 0, "assistant", "only."), (6, 0, "system", "s."), (6, 1, "system", "t."),
       (7, -3, "user", "\x00 odd."), (7, 2 ** 40, "unter", "ü?\x1f"), (8, 1, "user", "x" * 300_000), (8, 2, "assistant", "y. " * 100_000)]
ODD += [(40 + c, t, "user" if t % 2 else "assistant", f"Turn {t}." if c < 30 else "Same.") for c in range(40) for t in range(c % 5)]


@pytest.mark.parametrize("length", [turns.RUN, 1, 2])
def test_odd_rows(spark, length):
    df = frame(spark, ODD).repartition(5)
    assert found(*turns.repair(turns.turns(df), length)) == plain(ODD, damage=False)
    assert found(*turns.repair(turns.damaged(turns.turns(df)), length)) == plain(ODD)


@pytest.fixture
def many_slices(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_one_conversation_over_many_runs_and_slices(spark, many_slices):
    random.seed(4)
    rows = [(9, t, random.choice(["user", "user", "assistant", "system"]), random.choice(["a.", "b", " ", f"{t}.", f"{t}!"])) for t in range(900)]
    rows += [(10, 5, "user", "same.")] * 300 + [(11, 0, "user", "q?"), (11, 1, "assistant", "a.")]
    df = frame(spark, rows).repartition(7)
    placed, edits = turns.repair(turns.turns(df), 64)
    assert placed.where("conv_id = 9").select("slice").distinct().count() > 1
    assert found(placed, edits) == plain(rows, damage=False)
    texts = {}
    for r in turns.repaired(placed, edits).orderBy("slice", "at", "place").collect():
        texts.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    want = {r[0]: r[-1] for r in plain(rows, damage=False)}
    empty = hashlib.sha256().hexdigest()
    assert {c: hashlib.sha256("\n".join(t).encode()).hexdigest() for c, t in texts.items()} == {c: h for c, h in want.items() if h != empty}


def test_runs_join_to_the_whole():
    random.seed(3)
    for _ in range(3000):
        n = random.randrange(0, 11)
        pick = random.choice(["suao", "ua", "uuua", "sua", "sssua"])
        initials = "".join(random.choice(pick) for _ in range(n))
        faults = "".join(random.choice(random.choice(["....bdt", "tt.", "."])) for _ in range(n))
        cuts = [0] + sorted(random.randrange(0, n + 1) for _ in range(random.randrange(0, 4))) + [n]
        parts = [alignment.align(initials[x:y], faults[x:y], k == 0) for k, (x, y) in enumerate(zip(cuts, cuts[1:]))]
        runs = [{(w[0], w[1]): (w[2], sorted(v[3] for v in p if v[0] == w[0]).index(w[3])) for w in p} for p in parts]
        cost, states = alignment.join(runs)
        audit = "".join(next(w[3] for w in p if (w[0], w[1]) == s) for p, s in zip(parts, states)) + alignment.ENDING[states[-1][1]][0]
        assert (cost, audit) == cheapest(initials, faults), (initials, faults, cuts)


def test_empty_and_dropped(spark):
    assert found(*turns.repair(turns.turns(frame(spark, [])))) == []
    gone = [(c, t, "user", "a.") for c in range(300) for t in range(1) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    got = found(*turns.repair(turns.damaged(turns.turns(frame(spark, gone)))))
    assert len(got) == len(gone) > 0 and all(r[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for r in got)


def test_query_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op11_conversation_repair(spark, SF)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=repr) == plain(rows)
    assert compare(got, duck(SF), queries.ORACLES["op11_conversation_repair"]) == []
