"""Phrase counts and collocations against plain counting."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablelens.llm import phrases as P
from tests.llm.conftest import FOLD


def pieces(text):
    for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(FOLD)):
        yield re.findall("[^ \t]+", piece)


def plain_counts(rows, most):
    f = Counter()
    for lang, text in rows:
        for w in pieces(text):
            for n in range(1, most + 1):
                for i in range(len(w) - n + 1):
                    f[lang or "und", " ".join(w[i:i + n])] += 1
    return f


def plain_collocations(rows, most, least, top):
    f = plain_counts(rows, most)
    total = Counter()
    for (lang, p), c in f.items():
        if " " not in p:
            total[lang] += c
    cand = {k: c for k, c in f.items() if " " in k[1] and c >= least}
    covered = set()
    for (lang, p), c in cand.items():
        w = p.split(" ")
        for i in range(len(w)):
            for j in range(i + 1, len(w) + 1):
                part = " ".join(w[i:j])
                if part != p and f[lang, part] <= c:
                    covered.add((lang, part))
    out = {}
    for (lang, p), a in cand.items():
        if (lang, p) in covered:
            continue
        w, best = p.split(" "), None
        for k in range(1, len(w)):
            l, r = f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])]
            score = 1000 * a * total[lang] // (l * r)
            if best is None or score < best[0]:
                best = (score, l, r)
        out.setdefault(lang, []).append((-best[0], -a, p.encode(), p, a, best[1], best[2]))
    return sorted((lang, k + 1, x[3], x[4], x[5], x[6], total[lang], -x[0])
                  for lang, xs in out.items() for k, x in enumerate(sorted(xs)[:top]))


@pytest.mark.parametrize("most,least,top", [(5, 4, 2000), (3, 2, 5), (2, 3, 2000)])
def test_documents(llm_spark, docs, most, least, top):
    some = docs.where("n_chars < 4000").withColumn("lang", F.when(F.col("lang") == "en", None).otherwise(F.col("lang")))
    rows = [(r.lang, r.text) for r in some.collect()]
    got = P.collocations(some, max_words=most, min_count=least, top=top).collect()
    assert sorted(map(tuple, got)) == plain_collocations(rows, most, least, top)


def test_edge_rows(llm_spark, edge, empty):
    some = edge.withColumn("lang", F.when(F.col("key") < 12, "x")).withColumn("freq", F.lit("clash"))
    rows = [(r.lang, r.text) for r in some.collect()]
    phrases, total = P.count_phrases(some, min_count=2)
    got = {(r.lang, r.phrase): r.f for r in phrases.collect()}
    assert got == {k: c for k, c in plain_counts(rows, 5).items() if c >= 2}
    assert P.collocations(empty.withColumn("lang", F.lit("x"))).count() == 0


@pytest.mark.parametrize("period", [1, 3, 1 << 40])
def test_chunks_cover_each_start_once(monkeypatch, period):
    """Long texts in small blocks: the n-grams owned by the chunks are those of the text."""
    monkeypatch.setattr(P, "PERIOD", period)
    monkeypatch.setattr(P, "BLOCK", 64)
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["a", "bb", "c,", "dd\t", "é"], 300)), "a " * 400, "", None, "one. two three four five six", "x" * 500]
    batch = pa.record_batch([pa.array(["l"] * len(texts)), pa.array(texts, pa.string())], names=["lang", "text"])
    got = Counter()
    for out in P._parse(4)(iter([batch])):
        for _, chunk, own in zip(*[c.to_pylist() for c in out.columns]):
            w = chunk.split(" ")
            assert own == len(w) or own == len(w) - 4
            for n in range(1, 6):
                got.update(" ".join(w[i:i + n]) for i in range(min(own, len(w) - n + 1)))
    assert got == Counter({p: c for (_, p), c in plain_counts([("l", t) for t in texts], 5).items()})


def test_copies_share_chunks(llm_spark, docs):
    """The dictionary of a text and its copies is that of the text."""
    one = docs.where("doc_id < 20")
    chunks = P.chunk_dictionary(one)
    twice = P.chunk_dictionary(one.union(one))
    assert sorted((r.lang, r.chunk, 2 * r.freq) for r in chunks.collect()) == sorted((r.lang, r.chunk, r.freq) for r in twice.collect())
