"""Conversation repair against a turn-by-turn search over grammar states."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from tablelens.llm import turn_repair as R

GRAMMAR = re.compile("(s?(ua)+)?")


def plain(turns):
    """(cost, audit, repaired lines) of turns (role, text, fault): the best script
    to each state of the grammar, turn by turn."""
    def insert(state):
        return ("a", "assistant:") if state == "u" else ("u", "user:")

    best = {"": (0, "", ())}
    for role, text, fault in turns:
        nxt = {}
        for state, (cost, audit, lines) in best.items():
            for inserts in range(3):
                s, c, a, ls = state, cost, audit, lines
                for _ in range(inserts):
                    s, line = insert(s)
                    c, a, ls = c + 3, a + "I", (*ls, line)
                options = [(s, c + 4, a + "D", ls)]
                if fault not in ("blank", "duplicate"):
                    more = 3 if fault == "truncated" else 0
                    want = insert(s)[0]
                    if role[:1] == want or (role[:1] == "s" and s == ""):
                        options.append((role[:1], c + more, a + "K", (*ls, f"{role}:{text}")))
                    if role[:1] != want:
                        options.append((want, c + more + 3, a + "R", (*ls, insert(s)[1] + text)))
                for s2, c2, a2, l2 in options:
                    if s2 not in nxt or (c2, a2) < nxt[s2][:2]:
                        nxt[s2] = (c2, a2, l2)
        best = nxt
    ends = []
    for state, (cost, audit, lines) in best.items():
        while state in ("s", "u"):
            state, line = insert(state)
            cost, audit, lines = cost + 3, audit + "I", (*lines, line)
        ends.append((cost, audit, lines))
    return min(ends)


def report(rows):
    """The expected report of one conversation: rows (turn, role, text)."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows),
                  key=lambda v: (v[0] is not None, v[0] or 0, v[1].encode(), v[2].encode()))
    seen, turns = set(), []
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        turns.append((role, text, fault))
    known = [t for t, _, _ in rows if t is not None]
    faults = [f for _, _, f in turns]
    cost, audit, lines = plain(turns)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (max(known) - min(known) + 1 - len(set(known)) if known else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_align_all_short_turns():
    """Every script up to four turns, by trying all of them."""
    for m in range(4):
        for turns in itertools.product("suaoUS", repeat=m):
            turns = "".join(turns)
            got = R.align(turns)
            cost, audit = min((c + R._END[q][0], a + R._END[q][1]) for (p, q), (c, a) in got.items() if p == R._NONE)
            want = plain([({"s": "system", "u": "user", "a": "assistant", "o": "tool"}[c.lower()], "", "truncated" if c.isupper() else "") for c in turns])
            assert (cost, audit) == want[:2], turns


def test_align_pieces_make_up_the_whole():
    rng = random.Random(3)
    for _ in range(60):
        turns = "".join(rng.choice("uauauasouUA") for _ in range(rng.randrange(1, 40)))
        cut = rng.randrange(len(turns) + 1)
        whole, left, right = R.align(turns), R.align(turns[:cut]), R.align(turns[cut:])
        for (p, q), value in whole.items():
            both = [(c1 + c2, a1 + a2) for (x, y), (c1, a1) in left.items() if x == p for (y2, z), (c2, a2) in right.items() if (y2, z) == (y, q)]
            assert min(both) == value


def conversations(spark):
    rng = random.Random(11)
    rows = []
    for conv in [*range(25), None]:
        for turn in range(rng.randrange(1, 12)):
            text = rng.choice([f"Hello {turn}.", "ok", " \t", "", None, "Same.", f"why {rng.random()}?"])
            rows.append((conv, rng.choice([turn, turn, turn, None, 3]), rng.choice(["user", "assistant", "system", "tool", None, "", "unknown"]), text))
    for turn in range(700):     # one long conversation, with texts that come again far apart
        role = "user" if turn % 2 == 0 else "assistant"
        rows.append((100, turn + turn // 50, role if rng.random() < 0.9 else "system", rng.choice([f"t{turn}.", f"t{turn}", f"t{turn % 90}!", "Yes."])))
    rows += [(101, 5, "user", "again and again.")] * 300 + [(101, 6, "assistant", "so.")]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


@pytest.mark.parametrize("segment", [64, 5, 1])
def test_against_plain(llm_spark, monkeypatch, segment):
    monkeypatch.setattr(R, "SEGMENT", segment)
    df = conversations(llm_spark).withColumn("seg", F.lit("clash")).withColumn("n", F.lit(0))
    groups = {}
    for r in df.collect():
        groups.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    repair = R.repair_conversations(df)
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in repair.report.collect()}
    assert got == {c: report(rows) for c, rows in groups.items()}
    # the repaired turns follow the grammar and give the digest
    lines = {}
    for r in repair.turns().orderBy("conv_id", "segment", "place").collect():
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for c, v in got.items():
        assert hashlib.sha256("\n".join(lines.get(c, [])).encode()).hexdigest() == v[-1]
        assert GRAMMAR.fullmatch("".join(x[0] for x in lines.get(c, [])))


def test_empty_table_and_dropped_turns(llm_spark):
    schema = "conv_id long, turn long, role string, text string"
    assert R.repair_conversations(llm_spark.createDataFrame([], schema)).report.count() == 0
    gone = llm_spark.createDataFrame([(1, 0, "user", "x."), (1, 1, "assistant", "y."), (2, 0, "user", "z.")], schema)
    rows = R.repair_conversations(gone.withColumn("copies", F.when(F.col("conv_id") == 1, 0).otherwise(1))).report.orderBy("conv_id").collect()
    assert tuple(rows[0][c] for c in COLUMNS) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert rows[1].audit == "KI" and rows[1].cost == 3
