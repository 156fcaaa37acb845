"""LM scoring: exact base scores, proper probabilities, held-out perplexity."""

import glob
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tablelens.llm.pitman_yor import Seating, _cuts, _flat, _pack, _unpack, score_documents, sweep_seats
from tablelens.llm.stage import Steps
from tests.llm.conftest import words


def held(i):
    return i is None or zlib.crc32(str(i).encode()) % 10 == 0


def check(df, **options):
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    count = Counter()
    for i, t in rows:
        if not held(i):
            count.update(words(t, fold=True) + ["</end>"])
    total, types = sum(count.values()), len(count)
    want = []
    for i, t in rows:
        w = words(t, fold=True) + ["</end>"]
        want.append((str(i), held(i), len(w), sum(count[x] > 0 for x in w), total,
                     sum(math.log10((count[x] + 0.1) / (total + 0.1 * (types + 1))) for x in w)))
    out = score_documents(df, **options).collect()
    got = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in out)
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in out)
    return out


@pytest.mark.parametrize("share,group", [(2048, 1 << 20), (8, 50)])
def test_edge_rows(edge, share, group):
    check(edge.where("length(text) < 100000 or text is null"), share=share, group_tokens=group)


def test_better_than_the_base(docs):
    out = check(docs, group_tokens=1 << 14)
    for flag in (True, False):
        own = [r for r in out if r["held_out"] == flag]
        n = sum(r["n_tokens"] for r in own)
        assert sum(r["score"] for r in own) / n > sum(r["base_score"] for r in own) / n + 0.2


def test_empty_tables(llm_spark, empty):
    assert score_documents(empty).count() == 0
    only_held = llm_spark.createDataFrame([(None, "a b")], "doc_id long, text string")
    row = score_documents(only_held).first()
    assert row["train_tokens"] == 0 and row["n_known"] == 0 and row["n_tokens"] == 3


def test_contexts_do_not_depend_on_the_tasks(llm_spark):
    """A word with exactly 1/8 of the tokens, all in one half of the rows: the
    same scores in one task and in several, whichever rows a task has."""
    ids = [i for i in range(1, 400) if not held(i)][:40]
    rows = [(i, "hot a b c hot d e") if k < 20 else (i, f"f{k % 5} g h i j k l") for k, i in enumerate(ids)]
    df = llm_spark.createDataFrame(rows, "doc_id long, text string")
    found = [{r["doc_id"]: r["score"] for r in score_documents(x, share=8).collect()}
             for x in (df.coalesce(1), df.repartition(2, "text"), df.repartition(7))]
    for other in found[1:]:
        assert other == pytest.approx(found[0], rel=1e-9)


def test_probabilities_sum_to_one(llm_spark):
    """p(w | u) over the training words, the end and one unknown word, for a
    context with a restaurant and for one without."""
    ids = [i for i in range(1, 400) if not held(i)][:60]
    held_ids = [i for i in range(1, 4000) if held(i)]
    text = ["u a u b u a a c", "b a u u a", "c c u b d"]
    rows = [(i, text[i % 3]) for i in ids]
    vocabulary = ["u", "a", "b", "c", "d", "zzz"]
    probes = [(held_ids[0], ""), (held_ids[1], "u"), (held_ids[2], "c")]
    probes += [(held_ids[3 + k], f"u {w}") for k, w in enumerate(vocabulary)]
    probes += [(held_ids[20 + k], w) for k, w in enumerate(vocabulary)]
    df = llm_spark.createDataFrame(rows + probes, "doc_id long, text string")
    score = {r["doc_id"]: r["score"] for r in score_documents(df, share=20).collect()}
    # p(w | start) = p("w", end) / p(end | w); the end's own share given each word comes out as 1 in total
    start = sum(10 ** score[held_ids[20 + k]] for k in range(len(vocabulary)))
    empty_text = 10 ** score[held_ids[0]]
    assert 0 < empty_text < 1 and 0 < start < 1
    assert start + empty_text < 1


def test_seating_moves_customers_and_keeps_counts():
    random = np.random.RandomState(0)
    count = np.array([5, 1, 9, 2])
    seats = Seating(4, np.arange(4), count.copy())
    new = np.array([0.5, 0.5, 2.0, 0.1])
    tables = []
    for _ in range(400):
        cells = np.array([0, 2, 3])
        seats.leave_many(cells, np.ones(3, dtype=np.int64), random)
        assert (seats.customers() == count - np.array([1, 0, 1, 1])).all()
        seats.sit_many(cells, np.ones(3, dtype=np.int64), new[cells], np.full(3, 0.5), random)
        assert (seats.tables() == np.bincount(seats.owner[seats.size > 0], minlength=4)).all()
        assert (np.diff(seats.owner) >= 0).all()
        assert (seats.customers() == count).all()
        tables.append(seats.tables())
    mean = np.mean(tables[100:], axis=0)
    assert mean[1] == 1 and (mean >= 1).all() and (mean <= count).all() and mean[2] > mean[3]


def test_two_customers_share_a_table_as_often_as_they_should():
    """Exact case: with weight n for a new table, two customers of a cell are
    apart with probability n / (n + 1 - d)."""
    random = np.random.RandomState(1)
    seats = Seating(3000, np.repeat(np.arange(3000), 1), np.full(3000, 2))
    every = np.arange(3000)
    for _ in range(30):
        seats.leave_many(every, np.ones(3000, dtype=np.int64), random)
        seats.sit_many(every, np.ones(3000, dtype=np.int64), np.full(3000, 0.8), np.full(3000, 0.4), random)
    apart = (seats.tables() == 2).mean()
    assert apart == pytest.approx(0.8 / (0.8 + 0.6), abs=0.04)


def _plain_tables(customers, discount, weight, sweeps, random):
    """Table counts of a cell after each sweep of a plain sampler, one random customer at a time."""
    seat, size, out = [0] * customers, {0: customers}, []
    for _ in range(sweeps):
        for x in random.randint(customers, size=customers):
            size[seat[x]] -= 1
            if not size[seat[x]]:
                del size[seat[x]]
            u = random.random_sample() * (customers - 1 - discount * len(size) + weight)
            if u < weight:
                t = max(size, default=0) + 1
            else:
                while True:  # a random other customer's table, by rejection
                    t = seat[random.randint(customers)]
                    # (the one who left still names the old seat)
                    if t in size and random.random_sample() * (size[t] + (t == seat[x])) < size[t] - discount:
                        break
            seat[x] = t
            size[t] = size.get(t, 0) + 1
        out.append(len(size))
    return out


def test_large_cells_have_as_many_tables_as_with_a_plain_sampler():
    customers, d, weight, sweeps = 4000, 0.6, 100.0, 20
    random = np.random.RandomState(3)
    plain = np.mean([_plain_tables(customers, d, weight, sweeps, random) for _ in range(6)], axis=0)
    cells = Seating(40, np.arange(40), np.full(40, customers))
    root = Seating(1, np.zeros(1, dtype=np.int64), np.array([40 + 1000]))
    mine = []
    for _ in range(sweeps):
        sweep_seats(cells, np.zeros(40, dtype=np.int64), np.full(40, weight), root, lambda c, t: np.ones(len(c)), d, 5.0, 0.5,
                    3, random)
        assert (cells.customers() == customers).all() and root.customers()[0] == 1000 + cells.tables().sum()
        mine.append(cells.tables().mean())
    assert mine[0] == pytest.approx(plain[0], rel=0.15)
    assert np.mean(mine[10:]) == pytest.approx(np.mean(plain[10:]), rel=0.1)


def test_every_context_has_a_restaurant(llm_spark):
    """Rare words tell what follows them, a rare word or a frequent one: with
    ``share=20`` only "the" and the end are heavy. The model does not depend on
    what counts as heavy; only the draws of the seating do."""
    random = np.random.RandomState(5)
    train = [i for i in range(1, 900) if not held(i)][:300]
    probes = [i for i in range(1, 4000) if held(i)][:4]
    pairs = [f"a{k} b{k}" if k % 2 else f"a{k} the" for k in range(60)]
    rows = [(i, " ".join(random.choice(pairs, 6))) for i in train]
    rows += list(zip(probes, ["a1 b1", "a1 b3", "a2 the", "a1 the"]))
    df = llm_spark.createDataFrame(rows, "doc_id long, text string")
    score = {r["doc_id"]: r["score"] for r in score_documents(df, share=20, group_tokens=1000).collect()}
    assert score[probes[0]] > score[probes[1]] + 1.5
    assert score[probes[2]] > score[probes[3]] + 1.0
    heavy = {r["doc_id"]: r["score"] for r in score_documents(df, share=1 << 20).collect()}
    assert [score[i] for i in train] == pytest.approx([heavy[i] for i in train], rel=0.06)
    assert sum(score.values()) == pytest.approx(sum(heavy.values()), rel=0.005)


def test_tokens_are_shuffled_in_waves(docs, monkeypatch):
    """Each step that shuffles the lists of tokens reads one wave of them, and a
    scored wave is deleted before the next one is shuffled."""
    waves, left, write = [], [], Steps.write

    def spy(self, name, df, *parts):
        if name.startswith(("first", "sums")):
            plan = df._jdf.queryExecution().executedPlan().toString()
            read = re.findall(r"PartitionFilters: \[[^\]]*wave#\d+ = (\d+)", plan)
            waves.append((name, set(read)))
            left.append(len(glob.glob(self._paths["lists"].removeprefix("file:") + "/wave=[0-9]*")))
        return write(self, name, df, *parts)

    monkeypatch.setattr(Steps, "write", spy)
    rows = score_documents(docs, group_tokens=1 << 12).count()
    assert rows == docs.count()
    assert [n for n, _ in waves] == [f"{n}{w}" for n in ("first", "sums") for w in range(4)]
    assert [w for _, w in waves] == [{str(w)} for w in range(4)] * 2
    assert left == [4, 4, 4, 4, 4, 3, 2, 1]


@pytest.mark.parametrize("values", [np.zeros(0, np.int64), np.arange(300), np.array([-1, 1 << 62, -(1 << 63)]),
                                    np.array([1 << 40, 0]), np.array([0.1, -2.5e300]), np.float32([1.5, 3])])
def test_packed_numbers_come_back(values):
    packed = pa.array([_pack(values), _pack(values[:1])], pa.binary())
    assert (_unpack(packed[0], values.dtype) == values).all() and _unpack(packed[0], values.dtype).dtype == values.dtype
    assert list(_flat(packed, values.dtype)) == [*values, *values[:1]] and list(_cuts(packed)) == [
        0, len(values), len(values) + len(values[:1])]
