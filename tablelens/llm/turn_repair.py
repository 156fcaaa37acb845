"""Conversation structure repair (operator 13).

The turns of a conversation are aligned with the grammar ``(s?(ua)+)?`` of role
initials by Wagner-Fischer: keep, rerole, delete and insert have costs, and the
grammar has one string of each feasible length. All these strings end with the
same alternating tail, so one table, filled from the last turn on, holds the
distance to every length; Ukkonen's band keeps it to the cells that a script no
dearer than a plain incumbent can pass. The cheapest lengths are traced back and
their audits (the scripts' initials) compared; the ASCII-least one stands.

Conversations of any length: the turns are range-sorted by conversation and turn
and cut into segments of ``SEGMENT`` turns, wherever a task begins. For each pair of
grammar states before and after it, a segment is aligned by itself. Inserts
are counted with the turn that follows them, so no audit of a segment is the
beginning of another one, and the least audits of the segments in a row make up the
least audit of the whole. One scan over the segments' small tables picks the
states.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tablelens.llm.stage import Steps

RETURN, INSERT, DELETE, TRUNCATED = 3, 3, 4, 3
#: Different turns, and bytes of text, of one segment.
SEGMENT = 64
SEGMENT_BYTES = 1 << 20
_WHITE = " \t\n\x0b\x0c\r"
_NONE, _SYSTEM, _USER, _ASSISTANT = range(4)
_STATES = range(4)
#: Cost and audit of ending a conversation in each state.
_END = {_NONE: (0, ""), _SYSTEM: (2 * INSERT, "II"), _USER: (INSERT, "I"), _ASSISTANT: (0, "")}
_LEGAL = {"su", "ua", "au"}
_INF = 1 << 60


def _keep(c: str) -> int:
    return TRUNCATED if c.isupper() else 0


def _greedy(turns: str, first: str) -> int:
    """Cost of the script that keeps or reroles every turn."""
    cost, want = 0, first
    for c in turns:
        cost += _keep(c) + (0 if c.lower() == want else RETURN)
        want = "a" if want == "u" else "u"
    return cost


def _tables(turns: str, last: str, incumbent: int) -> list[dict[int, int]]:
    """Wagner-Fischer from the end: ``t[i][k]`` aligns the turns from i on with the
    last k characters of the alternating string that ends with ``last`` (no insert
    after the last turn). Only cells within the incumbent's deletes and inserts."""
    other = "a" if last == "u" else "u"
    m = len(turns)
    deletes, inserts = incumbent // DELETE, incumbent // INSERT
    rows: list[dict[int, int]] = [{}] * m + [{0: 0}]
    for i in range(m - 1, -1, -1):
        c, keep, below = turns[i].lower(), _keep(turns[i]), rows[i + 1]
        row: dict[int, int] = {}
        left = _INF
        for k in range(max(0, m - i - deletes), m - i + inserts + 1):
            best = below.get(k, _INF) + DELETE
            if k:
                step = below.get(k - 1, _INF) + keep + (0 if c == (last if k & 1 else other) else RETURN)
                if step < best:
                    best = step
                if left + INSERT < best:
                    best = left + INSERT
            row[k] = left = best
        rows[i] = row
    return rows


def _trace(turns: str, table: list[dict[int, int]], last: str, i: int, k: int) -> str:
    """The ASCII-least cheapest script from cell (i, k)."""
    other = "a" if last == "u" else "u"
    out = []
    while i < len(turns):
        here = table[i][k]
        if table[i + 1].get(k, _INF) + DELETE == here:
            out.append("D")
            i += 1
        elif k and table[i].get(k - 1, _INF) + INSERT == here:
            out.append("I")
            k -= 1
        else:
            out.append("K" if turns[i].lower() == (last if k & 1 else other) else "R")
            i += 1
            k -= 1
    return "".join(out)


@lru_cache(maxsize=1 << 15)
def align(turns: str) -> dict[tuple[int, int], tuple[int, str]]:
    """Cheapest script, and of equal ones the ASCII-least audit, for each pair of
    grammar states before and after the turns. A turn is its role's initial
    (``o``: none of s, u, a), in capitals if its text is truncated."""
    m = len(turns)
    out: dict[tuple[int, int], tuple[int, str]] = {(p, p): (DELETE * m, "D" * m) for p in (_NONE, _SYSTEM)}
    greedy = {first: _greedy(turns, first) + DELETE for first in "ua"}
    systems = [i for i, c in enumerate(turns) if c.lower() == "s"]
    for after, last in ((_USER, "u"), (_ASSISTANT, "a")):
        table = _tables(turns, last, max(greedy.values()))
        for first, befores in (("u", (_NONE, _SYSTEM, _ASSISTANT)), ("a", (_USER,))):
            odd = first == last
            lengths = [(c, k) for k, c in table[0].items() if (k & 1) == odd and c < _INF]
            for before in befores:
                least = 0 if before == after else 1
                own = [(c, k) for c, k in lengths if k >= least]
                best = min((c for c, _ in own), default=_INF)
                starts = [(0, k, "") for c, k in own if c == best]
                if before == _NONE:         # a kept system turn first, what is before it deleted
                    for i in systems:
                        head = DELETE * i + _keep(turns[i])
                        for k, c in table[i + 1].items():
                            if (k & 1) == odd and k >= 1 and c < _INF and head + c <= best:
                                if head + c < best:
                                    best, starts = head + c, []
                                starts.append((i + 1, k, "D" * i + "K"))
                if starts:
                    out[before, after] = best, min(s + _trace(turns, table, last, i, k) for i, k, s in starts)
    if systems:                             # one system turn is all that stays
        out[_NONE, _SYSTEM] = min((DELETE * (m - 1) + _keep(turns[i]), "D" * i + "K" + "D" * (m - 1 - i)) for i in systems)
    return out


def _digest(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()


_SEGMENT_FIELDS = [
    ("seg", pa.int64()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("copies", pa.list_(pa.int64())),
    ("kinds", pa.string()), ("keys", pa.list_(pa.binary())), ("turn_first", pa.int64()), ("turn_last", pa.int64()),
    ("turns", pa.int64()), ("illegal", pa.int64()), ("initial_first", pa.string()), ("initial_last", pa.string())]
_SEGMENT_SCHEMA = ("seg long, roles array<string>, texts array<string>, copies array<long>, kinds string, keys array<binary>, "
                   "turn_first long, turn_last long, turns long, illegal long, initial_first string, initial_last string")


def _kind(role: str, text: str) -> str:
    """The turn for ``align``; ``b`` if it is blank."""
    body = text.rstrip(_WHITE)
    if not body:
        return "b"
    c = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return c if body[-1] in ".!?" else c.upper()


def _segments(id_type: pa.DataType):
    """Sorted turns to segments. ``kinds`` has a letter per different turn: its
    letter for ``align``, b (blank) or d (seen earlier in this task); ``keys``
    holds the digests of the others."""
    schema = pa.schema([("conv_id", id_type), *_SEGMENT_FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        done: list[tuple] = []
        seen: set[bytes] = set()
        rows: list[tuple] = []
        conv, size, opened = None, 0, False

        def close():
            nonlocal number, rows, size
            kinds, keys = [], []
            turns, illegal, turn, initial = 0, 0, None, None
            for t, role, text, n in rows:
                if n:
                    kind = _kind(role, text)
                    if kind != "b":
                        key = _digest(role, text)
                        if key in seen:
                            kind = "d"
                        else:
                            seen.add(key)
                            keys.append(key)
                    kinds.append(kind)
                    c = role[:1]
                    illegal += (n - 1) * (c + c not in _LEGAL) + (initial is not None and initial + c not in _LEGAL)
                    initial = c
                    turns += t is not None and t != turn
                    turn = t
            live = [r for r in rows if r[3]]
            known = [r[0] for r in live if r[0] is not None]
            done.append((conv, number, [r[1] for r in live], [r[2] for r in live], [r[3] for r in live], "".join(kinds), keys,
                         known[0] if known else None, known[-1] if known else None, turns, illegal,
                         live[0][1][:1] if live else None, initial))
            number += 1
            rows, size = [], 0

        def emit():
            out = pa.record_batch([pa.array([d[i] for d in done], f.type) for i, f in enumerate(schema)], schema=schema)
            done.clear()
            return out

        for batch in batches:
            for c, t, role, text, n in zip(*[col.to_pylist() for col in batch.columns]):
                if opened and (c != conv or len(rows) >= SEGMENT or size >= SEGMENT_BYTES):
                    close()
                    if c != conv:
                        seen = set()
                conv, opened = c, True
                rows.append((t, role, text, n))
                size += len(text or "")
            if len(done) >= 1024:
                yield emit()
        if opened:
            close()
        if done:
            yield emit()

    return run


def _transfers(id_type: pa.DataType):
    """Per segment the scripts between grammar states and the counts of faults."""
    schema = pa.schema([("conv_id", id_type), ("seg", pa.int64()), ("pairs", pa.list_(pa.int32())), ("costs", pa.list_(pa.int64())),
                        ("audits", pa.list_(pa.string())), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
                        ("n", pa.int64()), ("turn_first", pa.int64()), ("turn_last", pa.int64()), ("turns", pa.int64()),
                        ("illegal", pa.int64()), ("initial_first", pa.string()), ("initial_last", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.to_pydict()
            out = {f.name: [] for f in schema}
            for kinds, copies, late in zip(d["kinds"], d["copies"], d["late"]):
                if late:
                    # the late-th of the segment's different turns is seen earlier, in another task
                    at = [i for i, c in enumerate(kinds) if c not in "bd"]
                    gone = {at[j] for j in late}
                    kinds = "".join("d" if i in gone else c for i, c in enumerate(kinds))
                forced = [n - (c not in "bd") for c, n in zip(kinds, copies)]      # deletes of each turn's copies
                live = "".join(c for c in kinds if c not in "bd")
                cost = DELETE * sum(forced)
                scripts = align(live)
                out["pairs"].append([4 * p + q for p, q in scripts])
                out["costs"].append([cost + c for c, _ in scripts.values()])
                out["audits"].append([_merged(a, kinds, forced) for _, a in scripts.values()])
                out["blank"].append(sum(n for c, n in zip(kinds, copies) if c == "b"))
                out["duplicate"].append(sum(n - (c != "d") for c, n in zip(kinds, copies) if c != "b"))
                out["truncated"].append(sum(c.isupper() for c in kinds))
                out["n"].append(sum(copies))
            for name in out:
                out[name] = out[name] or d[name]
            yield pa.record_batch([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    return run


def _merged(audit: str, kinds: str, forced: list[int]) -> str:
    """The audit with the deletes of blank and repeated turns in their places:
    after the turn they repeat, before the next turn's inserts."""
    if not any(forced):
        return audit
    steps = re.findall("I*[KRD]", audit)
    out, j = [], 0
    for c, n in zip(kinds, forced):
        if c not in "bd":
            out.append(steps[j])
            j += 1
        out.append("D" * n)
    return "".join(out)


def _choose(id_type: pa.DataType):
    """The states between the segments of each conversation (rows sorted by
    conversation and segment): totals from the end, then choices from the start."""
    schema = pa.schema([("conv_id", id_type), ("seg", pa.int64()), ("before", pa.int32()), ("audit", pa.string()), ("closing", pa.string()),
                        *[(c, pa.int64()) for c in ("cost", "n", "gaps", "blank", "duplicate", "truncated", "illegal")]])

    def solve(conv, segs):
        tables = [{(p >> 2, p & 3): (c, a) for p, c, a in zip(s["pairs"], s["costs"], s["audits"])} for s in segs]
        ahead = [{q: _END[q][0] for q in _STATES}]
        for t in reversed(tables):
            nxt = ahead[-1]
            ahead.append({p: min((c + nxt[q] for (b, q), (c, _) in t.items() if b == p), default=_INF) for p in _STATES})
        ahead.reverse()
        state, turn, initial = _NONE, None, None
        low = next((s["turn_first"] for s in segs if s["turn_first"] is not None), None)
        high = next((s["turn_last"] for s in reversed(segs) if s["turn_last"] is not None), None)
        turns = 0
        rows = []
        for i, (s, t) in enumerate(zip(segs, tables)):
            audit, after = min((a, q) for (b, q), (c, a) in t.items() if b == state and c + ahead[i + 1][q] == ahead[i][state])
            joint = 0
            if s["n"]:
                joint = int(initial is not None and initial + s["initial_first"] not in _LEGAL)
                turns += s["turns"] - (s["turn_first"] is not None and s["turn_first"] == turn)
                turn = s["turn_last"]
                initial = s["initial_last"]
            rows.append([conv, s["seg"], state, audit, "", 0, s["n"], 0, s["blank"], s["duplicate"], s["truncated"], s["illegal"] + joint])
            state = after
        rows[0][5] = ahead[0][_NONE]
        rows[0][7] = high - low + 1 - turns if low is not None else 0
        rows[-1][4] = _END[state][1]
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, segs, done, opened = None, [], [], False

        def emit():
            out = pa.record_batch([pa.array([r[i] for r in done], f.type) for i, f in enumerate(schema)], schema=schema)
            done.clear()
            return out

        for batch in batches:
            for row in batch.to_pylist():
                if opened and row["conv_id"] != conv:
                    done.extend(solve(conv, segs))
                    segs = []
                conv, opened = row["conv_id"], True
                segs.append(row)
            if len(done) >= 4096:
                yield emit()
        if opened:
            done.extend(solve(conv, segs))
        if done:
            yield emit()

    return run


def _apply(id_type: pa.DataType):
    """The repaired turns of each segment by its audit."""
    schema = pa.schema([("conv_id", id_type), ("seg", pa.int64()), ("audit", pa.string()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.to_pydict()
            roles, texts = [], []
            for state, audit, closing, role, text, copies in zip(d["before"], d["audit"], d["closing"], d["roles"], d["texts"], d["copies"]):
                out_r, out_t = [], []
                i, copy = 0, 0
                for step in audit + closing:
                    # only a kept system turn leads to the state after it
                    after = _SYSTEM if state == _NONE and step == "K" and role[i][:1] == "s" else _ASSISTANT if state == _USER else _USER
                    if step == "K":
                        out_r.append(role[i])
                    elif step != "D":
                        out_r.append("assistant" if after == _ASSISTANT else "user")
                    if step != "D":
                        out_t.append("" if step == "I" else text[i])
                        state = after
                    if step != "I":
                        copy += 1
                        if copy == copies[i]:
                            i, copy = i + 1, 0
                roles.append(out_r)
                texts.append(out_t)
            audits = [a + c for a, c in zip(d["audit"], d["closing"])]
            yield pa.record_batch([pa.array(v, f.type) for v, f in zip((d["conv_id"], d["seg"], audits, roles, texts), schema)], schema=schema)

    return run


def _hashed(id_type: pa.DataType):
    """SHA-256 over the repaired turns and the whole audit of each conversation, in
    order of the segments, without holding a conversation."""
    schema = pa.schema([("conv_id", id_type), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, opened, digest, audit, done, any_turn = None, False, hashlib.sha256(), [], [], False

        def emit():
            out = pa.record_batch([pa.array([r[i] for r in done], pa.string() if i else id_type) for i in range(3)], schema=schema)
            done.clear()
            return out

        for batch in batches:
            for c, a, roles, texts in zip(*[batch.column(n).to_pylist() for n in ("conv_id", "audit", "roles", "texts")]):
                if opened and c != conv:
                    done.append((conv, "".join(audit), digest.hexdigest()))
                    digest, audit, any_turn = hashlib.sha256(), [], False
                conv, opened = c, True
                audit.append(a)
                for r, t in zip(roles, texts):
                    digest.update((("\n" if any_turn else "") + f"{r}:{t}").encode("utf-8", "surrogatepass"))
                    any_turn = True
            if len(done) >= 4096:
                yield emit()
        if opened:
            done.append((conv, "".join(audit), digest.hexdigest()))
        if done:
            yield emit()

    return run


def damage_conversations(conversations: DataFrame) -> DataFrame:
    """Known damage for measuring a repair, by ``crc32(conv_id:turn) % 20`` (nulls: one
    space): 0 drops the turn, 1 empties its text, 2 removes ``. ! ?`` from it, 3 repeats it, 4
    makes its role user. Returns conv_id, turn, role, text (nulls: one space) and
    ``copies`` (0, 1 or 2)."""
    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    return conversations.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(text("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text("text"), ".!?", "")).otherwise(text("text")).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


class Repair:
    """``report``: a row per conversation. ``turns()``: the repaired conversations."""

    def __init__(self, report: DataFrame, segments: DataFrame):
        self.report = report
        self._segments = segments

    def turns(self) -> DataFrame:
        """(conv_id, segment, place, role, text): the order of a conversation is
        (segment, place)."""
        both = self._segments.select("conv_id", F.col("seg").alias("segment"), F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "t"))
        return both.select("conv_id", "segment", "place", F.col("t.roles").alias("role"), F.col("t.texts").alias("text"))


def repair_conversations(turns: DataFrame) -> Repair:
    """Align each conversation with alternating turns at the least cost: keep 0,
    rerole 3, delete 4 (always for a turn without other characters than white
    space, and for one whose role and text were there earlier), insert 3; a turn
    that stays and does not end with ``. ! ?`` adds 3. The report has conv_id, gaps
    (missing turn numbers), blank, duplicate, truncated (each turn's first fault), illegal
    (neighbours other than su, ua, au by role initials), cost, audit,
    repaired_sha256 (of ``role:text`` lines).

    ``turns``: conv_id, turn, role, text; ``copies`` (optional) says how often a row
    counts, 0 keeps only its conversation in the report. Other columns
    do not matter. Order: turn (null first), then role and text, so ties and
    equal rows have one order. Null role or text: one space, so such a text is
    blank; a null conv_id is a conversation of its own; no turns: zeros, empty audit
    and the digest of no text; an empty table gives none. Turn numbers are whole.
    """
    spark = turns.sparkSession
    steps = Steps(spark)
    n = F.coalesce(F.col("copies").cast("long"), F.lit(0)) if "copies" in turns.columns else F.lit(1).cast("long")
    space = F.lit(" ")
    rows = turns.select("conv_id", F.when(n > 0, F.col("turn").cast("long")).alias("turn"),
                        F.when(n > 0, F.coalesce(F.col("role").cast("string"), space)).alias("role"),
                        F.when(n > 0, F.coalesce(F.col("text").cast("string"), space)).alias("text"), F.greatest(n, F.lit(0)).alias("n"))
    # equal rows count as one row, so that they may be any number
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    rows = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 32)) \
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    id_schema = turns.schema["conv_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type
    id_type = to_arrow_type(id_schema)
    name = f"conv_id {id_schema.simpleString()}"
    segments = steps.write("segments", rows.mapInArrow(_segments(id_type), f"{name}, {_SEGMENT_SCHEMA}"))

    # turns seen earlier in another task: only in conversations that more than one task holds
    task = F.shiftright("seg", 32)
    spread = segments.groupBy("conv_id").agg(F.min(task).alias("x"), F.max(task).alias("y")).where("x < y") \
        .select(F.col("conv_id").alias("spread_id"))         # fewer than there are tasks
    keys = segments.select("conv_id", "seg", F.posexplode("keys").alias("place", "key")) \
        .join(F.broadcast(spread), F.col("conv_id").eqNullSafe(F.col("spread_id")), "left_semi").select("conv_id", "seg", "place", "key")
    first = keys.groupBy("conv_id", "key").agg(F.min(F.struct("seg", "place")).alias("first"), F.count(F.lit(1)).alias("k")) \
        .where("k > 1").select(F.col("conv_id").alias("c"), F.col("key").alias("key2"), "first")
    late = keys.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("key") == F.col("key2"))) \
        .where(F.struct("seg", "place") > F.col("first")).groupBy("seg").agg(F.collect_list("place").alias("late"))
    slim = segments.drop("roles", "texts", "keys").join(late, "seg", "left")
    slim = slim.select("conv_id", "seg", *[c for c in segments.columns if c not in ("conv_id", "seg", "roles", "texts", "keys")], "late")
    transfers = slim.mapInArrow(_transfers(id_type), f"{name}, seg long, pairs array<int>, costs array<long>, audits array<string>, blank long, "
                                "duplicate long, truncated long, n long, turn_first long, turn_last long, turns long, illegal long, "
                                "initial_first string, initial_last string")
    chosen = steps.write("chosen", transfers.repartition("conv_id").sortWithinPartitions("conv_id", "seg").mapInArrow(
        _choose(id_type), f"{name}, seg long, before int, audit string, closing string, cost long, n long, gaps long, blank long, "
        "duplicate long, truncated long, illegal long"))

    texts = segments.select("seg", "roles", "texts", "copies")
    both = chosen.select("conv_id", "seg", "before", "audit", "closing").join(texts, "seg")
    repaired = both.select("conv_id", "seg", "before", "audit", "closing", "roles", "texts", "copies").mapInArrow(
        _apply(id_type), f"{name}, seg long, audit string, roles array<string>, texts array<string>")
    hashed = repaired.repartition("conv_id").sortWithinPartitions("conv_id", "seg").mapInArrow(
        _hashed(id_type), f"{name}, audit string, repaired_sha256 string")
    counts = chosen.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]) \
        .withColumnRenamed("conv_id", "c")
    report = hashed.join(counts, F.col("conv_id").eqNullSafe(F.col("c"))).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return Repair(report, repaired)
