"""Substring dedup against brute force, and the suffix automaton itself."""

import hashlib
import random

import pytest

from tablelens.llm.substring_dedup import SuffixAutomaton, remove_repeated_spans
from tests.llm.conftest import words


def brute(rows, window):
    first, out = {}, []
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[k:k + window])
                first[key] = min(first.get(key, i), i)
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k:k + window])] < i:
                gone[k:k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((str(i), len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def run(df, **options):
    return sorted((str(r[0]), *r[1:]) for r in remove_repeated_spans(df, payload="digest", **options).collect())


@pytest.mark.parametrize("window,segments", [(13, 4096), (13, 1), (3, 2), (50, 4096)])
def test_edge_rows(edge, window, segments):
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    assert run(edge, window=window, shard_segments=segments) == brute(rows, window)


def test_documents(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert run(docs) == brute(rows, 13)


def test_texts_keep_what_is_not_cut(llm_spark):
    a = "p q r s t u v w x y z 1 2 3"
    rows = [(1, f"{a} end", "k"), (2, f"start\n\n{a}\n\nrest  of it", "k"), (3, "untouched \n text ", "k"), (4, a, "k"),
            (5, None, "k")]
    df = llm_spark.createDataFrame(rows, "doc_id long, text string, begin string")
    out = {r["doc_id"]: r for r in remove_repeated_spans(df, window=13).collect()}
    assert out[1]["text"] == f"{a} end" and out[3]["text"] == "untouched \n text " and out[5]["text"] is None
    assert out[2]["text"] == "start\n\nrest  of it" and out[4]["text"] == ""
    assert [(s["start"], s["end"]) for s in out[2]["removed"]] == [(7, 7 + len(a))]
    assert out[2]["begin"] == "k"
    with pytest.raises(ValueError):
        remove_repeated_spans(df.withColumnRenamed("begin", "removed"))


@pytest.mark.parametrize("segments", [4096, 1])
def test_rows_of_one_id_with_different_texts(llm_spark, segments):
    """Each row loses words of its own text only; one of them is shorter than a window."""
    a = "p q r s t u v w x y z 1 2 3"
    other = " ".join(f"n{k}" for k in range(40))
    rows = [(1, a), (2, f"head {a} tail"), (2, "too short"), (2, other), (3, f"{a} {other}"), (3, a), (3, None)]
    df = llm_spark.createDataFrame(rows, "doc_id long, text string")
    assert run(df, shard_segments=segments) == brute(rows, 13)
    out = sorted((r["doc_id"], r["text"] or "") for r in remove_repeated_spans(df, shard_segments=segments).collect())
    assert out == sorted([(1, a), (2, "head tail"), (2, "too short"), (2, other), (3, ""), (3, ""), (3, "")])


def test_empty_table(empty):
    assert run(empty) == []


def test_automaton_names_the_first_owner():
    for seed in range(60):
        rng = random.Random(seed)
        texts = [[rng.choice("abc") for _ in range(rng.randint(0, 14))] for _ in range(5)]
        automaton = SuffixAutomaton()
        for owner, text in enumerate(texts):
            for window in (1, 2, 4):
                want = []
                for k in range(len(text) - window + 1):
                    w = text[k:k + window]
                    want.append(next((o for o, t in enumerate(texts[:owner]) if any(
                        t[j:j + window] == w for j in range(len(t) - window + 1))), None))
                assert automaton.owners(text, window) == want
            automaton.add(text, owner)
