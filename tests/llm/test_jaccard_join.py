"""N-gram Jaccard join against brute force."""

import numpy as np
import pytest

from tablelens.llm import jaccard_join as J
from tests.llm.conftest import words


def brute(rows, n, num, den):
    sets = []
    for i, t in rows:
        w = words(t, fold=True) if i is not None else []
        sets.append(frozenset(tuple(w[k:k + n]) for k in range(len(w) - n + 1)) or (frozenset([tuple(w)]) if w else frozenset()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(rows[k][0])
    return sorted((str(i), links[k], str(min(groups[find(k)]) if i is not None else None)) for k, (i, _) in enumerate(rows))


def run(df, **options):
    out = J.ngram_jaccard_join(df, sketch_bits=12, **options)
    return sorted((str(r["doc_id"]), r["n_links"], str(r["component_id"])) for r in out.collect())


@pytest.mark.parametrize("limit,tile", [(24, 1 << 21), (2, 50)])
def test_edge_rows(edge, limit, tile):
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    assert run(edge, n=4, threshold=(85, 100), pair_limit=limit, tile_grams=tile) == brute(rows, 4, 85, 100)


def test_near_copies_of_every_distance(llm_spark):
    """A family around each threshold: changes at any place, any number."""
    random = np.random.RandomState(3)
    base = [f"t{k}" for k in range(60)]
    rows = []
    for k in range(90):
        w = list(base)
        for _ in range(random.randint(0, 6)):
            w[random.randint(len(w))] = f"u{random.randint(40)}"
        rows.append((k, " ".join(w[random.randint(3):])))
    df = llm_spark.createDataFrame(rows, "doc_id long, text string")
    assert run(df, n=5, pair_limit=8) == brute(rows, 5, 4, 5)
    assert run(df, n=4, threshold=(85, 100), pair_limit=3, tile_grams=400) == brute(rows, 4, 85, 100)


def test_empty_table(empty):
    assert run(empty) == []


def test_batches_cut_columns_anywhere():
    """The product's terms do not depend on where Arrow batches end."""
    import pyarrow as pa
    random = np.random.RandomState(1)
    rows = sorted({(int(g), int(n), int(k)) for g, n, k in zip(random.randint(0, 12, 300), random.randint(20, 30, 300),
                                                                random.randint(0, 60, 300))})
    table = pa.table({"gram": pa.array([r[0] for r in rows]), "key": pa.array([r[2] for r in rows]),
                      "n": pa.array([r[1] for r in rows], pa.int32()), "pos": pa.array([0] * len(rows), pa.int32())})
    terms, _ = J._column_terms(4, 5, 10)

    def linked(size):
        pairs = {(a, b) for out in terms(iter(table.to_batches(max_chunksize=size))) for a, b in
                 zip(out.column(0).to_pylist(), out.column(1).to_pylist())}
        root = {}
        for a, b in pairs:
            x, y = a, b
            while root.get(x, x) != x:
                x = root[x]
            while root.get(y, y) != y:
                y = root[y]
            root[max(x, y)] = min(x, y)
        find = lambda x: x if root.get(x, x) == x else find(root[x])
        return {k: find(k) for k in {r[2] for r in rows}}

    assert linked(1) == linked(7) == linked(1000)


def family_rows(seed=5, families=6, copies=14, short=12):
    """Families of near copies of several lengths, with one n-gram run in common."""
    random = np.random.RandomState(seed)
    rows = []
    for f in range(families):
        base = [f"f{f}w{k}" for k in range(30 + 25 * f)] + [f"c{k}" for k in range(short)]
        for _ in range(copies):
            w = list(base)
            for _ in range(random.randint(0, 5)):
                w[random.randint(len(w))] = f"u{random.randint(1000)}"
            rows.append((len(rows), " ".join(w)))
    return rows


@pytest.mark.parametrize("limit,tile", [(24, 1 << 21), (3, 150)])
def test_waves_give_the_same_links(llm_spark, monkeypatch, limit, tile):
    """N-grams and units in waves: same rows, and the written sets are read in several waves."""
    monkeypatch.setattr(J, "WAVE_ENTRIES", 0)
    monkeypatch.setattr(J, "WAVE_GRAMS", 1)
    seen = []
    write = J.Steps.write
    monkeypatch.setattr(J.Steps, "write", lambda self, name, df, *p: (seen.append(name), write(self, name, df, *p))[1])
    rows = family_rows()
    df = llm_spark.createDataFrame(rows, "doc_id long, text string")
    assert run(df, n=4, threshold=(85, 100), pair_limit=limit, tile_grams=tile) == brute(rows, 4, 85, 100)
    assert "pairs1" in seen and "texts" in seen and "links1" in seen


def column(sizes, labels=None):
    import pyarrow as pa
    m = len(sizes)
    data = {"gram": pa.array([7] * m), "key": pa.array(range(m)), "n": pa.array(sizes, pa.int32()), "pos": pa.array([0] * m, pa.int32())}
    return pa.table(data | ({"label": pa.array(labels)} if labels else {}))


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_long_column_of_many_sizes_is_paired(size):
    """Each class meets one or two of like size: pairs, that the bounds may drop,
    and not one run of 60 classes that belong together for good."""
    sizes = [int(100 * 1.12 ** k) for k in range(60)]
    terms, _ = J._column_terms(4, 5, 10)
    got = [t for out in terms(iter(column(sizes).to_batches(max_chunksize=size))) for t in out.to_pylist()]
    assert not any(t["long_column"] for t in got)
    assert {(t["a"], t["b"]) for t in got} == {(i, j) for j in range(60) for i in range(j) if sizes[i] * 5 >= sizes[j] * 4}


@pytest.mark.parametrize("size", [1, 7, 1000])
@pytest.mark.parametrize("limit", [1, 4, 10, 24, 100])
def test_pairs_or_a_run_cover_every_pair_of_like_size(size, limit):
    random = np.random.RandomState(limit)
    sizes = sorted(random.choice([random.randint(50, 60), random.randint(60, 400)]) for _ in range(80))
    terms, _ = J._column_terms(4, 5, limit)
    got = [t for out in terms(iter(column(sizes).to_batches(max_chunksize=size))) for t in out.to_pylist()]
    pairs = {(t["a"], t["b"]) for t in got if not t["long_column"]}
    root = list(range(80))

    def find(x):
        return x if root[x] == x else find(root[x])

    for t in got:
        if t["long_column"]:
            x, y = find(t["a"]), find(t["b"])
            root[max(x, y)] = min(x, y)
    assert all((i, j) in pairs or find(i) == find(j) for j in range(80) for i in range(j) if sizes[i] * 5 >= sizes[j] * 4)
    assert len(got) <= 80 * limit


def test_classes_of_one_label_give_no_terms():
    """A family that an earlier wave put together costs no pairs in later columns."""
    terms, _ = J._column_terms(4, 5, 24)
    got = [t for out in terms(iter(column([100] * 20, [0] * 19 + [19]).to_batches())) for t in out.to_pylist()]
    assert {(t["a"], t["b"]) for t in got} == {(i, 19) for i in range(19)}


def test_tiles_meet_only_sizes_that_may_link(llm_spark):
    """1,000 sets of 100 to 10,000 n-grams in a block: few pairs of tiles, and all that may link."""
    rows = [(k, k, 1, int(100 * 10 ** (k / 500)), 0) for k in range(1000)]
    df = llm_spark.createDataFrame(rows, "doc_id long, key long, copies long, n long, block long")
    got = J._tiled(df, 85, 100, 10_000).collect()
    assert len(got) == 1000
    for x in got[::7]:
        for y in got[::11]:
            if min(x["n"], y["n"]) * 100 >= max(x["n"], y["n"]) * 85:
                assert x["first"] <= y["tile"] <= x["last"] and y["first"] <= x["tile"] <= y["last"]
    tiles = 1 + max(r["tile"] for r in got)
    assert sum(r["last"] - r["first"] + 1 for r in got) < 0.3 * tiles * len(got)
