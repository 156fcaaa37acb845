"""The corpus pipeline against a plain-Python run of its stages."""

import corpus_pipeline as C
from tests.llm.conftest import words
from tests.llm.test_jaccard_join import brute as brute_links

SF = "/root/testdata/sf0.001"


def write(df, path):
    df.write.parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


def brute_cut(rows, window):
    first, out = {}, {}
    for i, t in sorted(rows):
        w = words(t)
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k:k + window]), i)
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k:k + window])] < i:
                gone[k:k + window] = [True] * window
        if not gone or not all(gone):
            out[i] = [x for x, g in zip(w, gone) if not g]
    return out


def test_stages(llm_spark, tmp_path):
    docs = llm_spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = write(C.quality(llm_spark, docs, SF), tmp_path / "q")
    assert kept.columns == columns and 0 < kept.count() <= docs.count()
    source = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert all(source[i] == t for i, t in rows)

    single = write(C.near_duplicates(llm_spark, kept, SF), tmp_path / "n")
    want = sorted(int(c) for c in {c for _, _, c in brute_links(rows, 5, 4, 5)})
    assert sorted(r["doc_id"] for r in single.collect()) == want and single.columns == columns

    cut = write(C.repeated_passages(llm_spark, single, SF), tmp_path / "s")
    left = [(r["doc_id"], r["text"]) for r in single.collect()]
    expected = brute_cut(left, C.REPEATED_WORDS)
    got = {r["doc_id"]: r for r in cut.collect()}
    assert cut.columns == columns and {i: words(r["text"]) for i, r in got.items()} == expected
    assert all(r["text"] == source[i] or len(r["text"]) == r["n_chars"] for i, r in got.items())

    packed = C.packing(llm_spark, cut, SF).collect()
    assert {r["doc_id"] for r in packed} == set(got)
    assert [n for n, _ in C.STAGES] == ["quality classifier", "n-gram Jaccard join", "substring dedup", "best-fit packing"]


def test_run_and_odd_rows(llm_spark, tmp_path, edge):
    assert C.run(llm_spark, SF).count() > 0
    rows = edge.withColumnRenamed("key", "n_chars")
    single = C.near_duplicates(llm_spark, rows, SF).collect()
    ids = [r["doc_id"] for r in single]
    assert ids.count(5) == 0 and ids.count(4) == 1 and ids.count(None) == 2   # 4 and 5 are equal; no id, no link
    cut = C.repeated_passages(llm_spark, rows, SF)
    texts = {r["n_chars"]: r["text"] for r in cut.collect()}
    assert texts[1] is None and 6 in {r["doc_id"] for r in cut.collect()}
    for stage in (C.near_duplicates, C.repeated_passages, C.packing):
        assert stage(llm_spark, rows.where("false"), SF).count() == 0
    assert C.quality(llm_spark, rows.where("false"), SF).count() == 0


def test_one_id_with_two_texts(llm_spark):
    """An id that repeats with another text keeps the text that is nowhere else."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(1, a, 1, "x"), (5, a, 2, "x"), (5, b, 3, "y"), (7, c, 4, "z"), (7, c, 3, "z"), (7, b + " tail", 5, "z"), (None, a, 6, "n")]
    docs = llm_spark.createDataFrame(rows, "doc_id long, text string, `row` long, gone string")
    got = C.near_duplicates(llm_spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([rows[0], rows[2], rows[4], rows[6]], key=str)
