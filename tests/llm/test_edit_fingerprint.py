"""Fingerprints: neighbours, likeness, near copies."""

import hashlib
import random

import numpy as np

from tablelens.llm.edit_fingerprint import (PLACES, _Walk, as_text, block_starts, edited, fingerprint_edits, fingerprints, from_text, likeness,
                                            near_copies)


def test_neighbours_and_digests(edge, docs):
    for df in (edge, docs):
        rows = [(r["doc_id"], r["text"] or "") for r in df.collect()]
        order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
        want = []
        for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
            want.append((str(i), len(t), hashlib.sha256(edited(t, after).encode()).hexdigest()))
        for buckets in (1, 4):
            out = fingerprint_edits(df, buckets=buckets).collect()
            assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in out) == sorted(want)
            by_text = {}
            text = {(str(i), len(t)): t for i, t in rows}
            for r in out:
                assert len(r["fingerprint"]) == PLACES and 0 <= r["near_next"] <= 1
                by_text.setdefault(text[str(r["doc_id"]), r["n_chars"]], set()).add(r["fingerprint"])
            assert all(len(p) == 1 for p in by_text.values())


def test_edited_texts_are_near_and_others_far(docs):
    rows = [r for r in fingerprint_edits(docs).collect() if r["n_chars"] > 200]
    assert min(r["near_edited"] for r in rows) > 0.5 and max(r["near_next"] for r in rows if r["near_next"] < 1) < 0.4


def test_likeness_falls_with_the_number_of_edits():
    rng = random.Random(4)
    base = "".join(rng.choice("abcdefghij klmnop") for _ in range(6000))
    texts = [base]
    for edits in (3, 30, 300):
        t = list(base)
        for _ in range(edits):
            k = rng.randrange(len(t))
            t[k:k + 1] = rng.choice(["", "x", t[k] + "y"])
        texts.append("".join(t))
    p = fingerprints(texts)
    near = likeness(np.repeat(p[:1], 4, axis=0), p)
    assert near[0] == 1 and near[1] > near[2] > near[3] and near[1] > 0.9
    assert (from_text(as_text(p)) == p).all()
    assert (fingerprints(texts[::-1])[::-1] == p).all()  # whatever the batch


def _plain(text):
    """One text, one block after the other, one step at a time."""
    walk, out, best = _Walk(), [255] * PLACES, [1 << 64] * PLACES
    starts = block_starts(np.array([ord(c) for c in text], dtype=np.uint32))
    for b, (i, end) in enumerate(zip(starts, starts[1:] + [len(text)])):
        place, rank = (x.tolist() for x in walk.ranks(b))
        for j in range(len(walk.add)):
            if i >= end:
                break
            note = ((ord(text[i]) ^ int(walk.add[j])) * int(walk.times[j])) % (1 << 32)
            if rank[j] < best[place[j]]:
                out[place[j]], best[place[j]] = (note >> 27) & 15, rank[j]
            i += note >> 31
    return out


def test_equals_a_plain_walk():
    rng = random.Random(5)
    lengths = [0, 1, 2, 7, 100, 3584, 3599, 3600, 3650, 5120, 9000, 30_000]
    texts = ["".join(rng.choice("abcdefghij é\U0001f600") for _ in range(n)) for n in lengths] + ["ab" * 7000, "a" * 6000]
    assert fingerprints(texts).tolist() == [_plain(t) for t in texts]


def test_likeness_does_not_jump_where_blocks_begin():
    rng = random.Random(8)
    base = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(5200))
    p = fingerprints([base[:n] for n in range(3000, 5200, 20)])
    assert likeness(p[:-1], p[1:]).mean() > 0.95


def test_blocks_fall_into_step_after_an_insertion():
    """One insertion near the beginning of 40,000 characters, of any length far
    below a block's, and a few all over it."""
    rng = random.Random(6)
    near = {k: [] for k in (1, 20, 60, 100, 200)}
    few = []
    make = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    for _ in range(12):
        base = make(40_000)
        other = [base[:500] + make(k) + base[500:] for k in near]
        spread = base
        for at in (35_000, 20_000, 1_000):
            spread = spread[:at] + make(15) + spread[at:]
        p = fingerprints([base, spread, *other, make(40_000)])
        found = likeness(np.repeat(p[:1], len(p) - 1, axis=0), p[1:])
        few.append(found[0])
        for k, x in zip(near, found[1:-1]):
            near[k].append(x)
        assert found[-1] < 0.2
    assert all(np.mean(x) > 0.8 for x in near.values()), {k: (np.mean(x), min(x)) for k, x in near.items()}
    assert np.mean(few) > 0.7


def test_classes_against_all_pairs(llm_spark):
    """Families of edited copies of short and long texts: links of all pairs at the
    threshold, against the classes that banding and verification find."""
    rng = random.Random(7)
    make = lambda n: "".join(rng.choice("abcdefghij klmnop") for _ in range(n))
    rows = []
    for n in [60, 100, 150, 300, 300, 900, 900, 2000, 12_000] * 4:
        base = make(n)
        for _ in range(5):
            t = base
            for _ in range(rng.randrange(1, 3)):
                k = rng.randrange(len(t))
                t = t[:k] + rng.choice("xyz") + t[k + rng.randrange(2):]
            rows.append((len(rows), t))
    p = fingerprints([t for _, t in rows])
    found = {r["doc_id"]: r["class_id"] for r in near_copies(
        llm_spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    linked = kept = 0
    for a in range(len(rows)):
        near = np.flatnonzero(likeness(np.repeat(p[a:a + 1], len(rows), axis=0), p) >= 0.8)
        for b in near[near > a]:
            linked += 1
            kept += found[a] == found[int(b)]
    assert linked > 100 and kept >= 0.9 * linked, (kept, linked)
    family = {k: k // 5 for k, _ in rows}
    assert all(family[c] == family[k] for k, c in found.items())  # nothing else is joined


def test_empty_table(empty):
    assert fingerprint_edits(empty).count() == 0


def test_near_copies(llm_spark):
    rng = random.Random(9)
    make = lambda: "".join(rng.choice("abcdefghij klmnop") for _ in range(900))
    a, b = make(), make()
    rows = [(1, a), (2, a), (3, a[:400] + "X" + a[400:]), (4, b), (5, b[:-3]), (6, make()), (7, ""), (8, None)]
    out = {r["doc_id"]: r["class_id"] for r in near_copies(
        llm_spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1] == out[2] == out[3] == 1 and out[4] == out[5] == 4 and out[6] == 6 and out[7] == out[8] == 7
