"""Packing: ids, pieces, and places."""

import struct
import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from tablelens.llm.packing import pack_documents, sum_of_squares


def check(rows, texts, capacity):
    plain = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = sorted((str(i), plain.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in texts)
    by_doc, got = {}, []
    for r in sorted(rows, key=lambda r: (str(r["doc_id"]), r["piece"])):
        by_doc.setdefault(str(r["doc_id"]), []).append(r)
    assert sorted(len(x[1]) for x in want) == sorted(
        sum(r["length"] for r in rs) for rs in split_rows(by_doc))
    for rs in split_rows(by_doc):
        ids = [x for r in rs for x in r["ids"]]
        got.append((str(rs[0]["doc_id"]), ids))
        assert [r["start"] for r in rs] == list(np.cumsum([0] + [r["length"] for r in rs[:-1]]))
        assert all(r["length"] == capacity for r in rs[1:]) and (len(rs) == 1 or len(ids) > capacity)
    assert sorted(got) == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def split_rows(by_doc):
    """Rows of equal ids, one list per document (pieces restart at 0)."""
    for rs in by_doc.values():
        copies = sum(r["piece"] == 0 for r in rs)
        for k in range(copies):
            yield [r for p in sorted({r["piece"] for r in rs}) for r in [x for x in rs if x["piece"] == p][k:k + 1]]


def test_edge_rows(edge):
    rows = pack_documents(edge, capacity=512, shard_pieces=7).collect()
    check(rows, [(r["doc_id"], r["text"]) for r in edge.collect()], 512)


def test_documents_and_digests(docs):
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows = pack_documents(docs).collect()
    made = check(rows, texts, 2048)
    total = sum(r["length"] for r in rows)
    assert made <= -(-total // 2048) + 2
    digests = {(r["doc_id"], r["piece"]): r["ids_crc32"] for r in pack_documents(docs, payload="crc32").collect()}
    assert digests == {(r["doc_id"], r["piece"]): zlib.crc32(struct.pack(f"<{r['length']}I", *r["ids"])) for r in rows}


def test_empty_table(empty):
    assert pack_documents(empty).count() == 0


def test_rule():
    """Each piece goes where the squares become smallest; no open sequence that
    has room is passed over for a new one."""
    lengths = np.array([6, 6, 5, 4, 4, 3, 2, 2, 1, 10])
    sequence, offset = sum_of_squares(lengths, 10)
    fill = np.bincount(sequence, weights=lengths)
    assert fill.max() <= 10 and len(fill) == 5 and lengths.sum() == fill.sum()
    random = np.random.RandomState(0)
    lengths = random.randint(1, 700, 4000)
    sequence, _ = sum_of_squares(lengths, 2048)
    assert sequence.max() + 1 <= -(-lengths.sum() // 2048) + 1
