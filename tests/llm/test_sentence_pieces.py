"""SentencePiece: the best path, the trie, and exact round trips."""

import itertools
import random

import pytest
import sentencepiece

from tablelens.llm.sentence_pieces import MARK, DoubleArray, UnigramModel, encode_documents, public_model_path, read_model
from tests.llm.conftest import DOCS


def _varint(v):
    out = bytearray()
    while v > 127:
        out.append(v & 127 | 128)
        v >>= 7
    return bytes(out + bytes([v]))


def _field(number, data):
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def tiny_model(scores, with_bytes=False):
    """A model file with these pieces."""
    import struct
    pieces = [("<unk>", 0.0, 2)] + [(p, s, 1) for p, s in scores.items()]
    if with_bytes:
        pieces += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    out = b""
    for p, s, kind in pieces:
        out += _field(1, _field(1, p.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", s) + _varint(3 << 3) + _varint(kind))
    return UnigramModel(out + _field(3, _varint(3 << 3) + b"\x01" + _varint(4 << 3) + b"\x00"))


def brute_score(model, text):
    """The largest sum of scores over all ways to cut a text."""
    known = {p: s for p, s, t in zip(model.pieces, model.scores, model.types) if t == 1}
    text = MARK + text.replace(" ", MARK)
    best = None
    for cuts in itertools.product([0, 1], repeat=len(text) - 1):
        parts, at = [], 0
        for k, c in enumerate(cuts, 1):
            if c:
                parts.append(text[at:k])
                at = k
        parts.append(text[at:])
        score = 0.0
        for p in parts:
            if p in known:
                score += known[p]
            elif len(p) == 1:
                score += model.low
            else:
                break
        else:
            best = score if best is None or score > best else best
    return best


def test_best_path_against_all_cuts():
    rng = random.Random(2)
    for _ in range(30):
        pieces = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 4))): -rng.uniform(0.5, 6) for _ in range(8)}
        pieces |= {MARK + p: -rng.uniform(0.5, 6) for p in list(pieces)[:3]} | {MARK: -2.0}
        model = tiny_model(pieces)
        text = "".join(rng.choice("abc ") for _ in range(9))
        ids = model.encode(text)
        got = sum(model.low if k == model.unknown else model.scores[k] for k in ids)
        assert got == pytest.approx(brute_score(model, text))


def test_same_best_path_as_the_library():
    """The library's lattice for the same vocabulary read as a unigram model
    (it adds in 32 bits, so only short texts without unknown characters)."""
    with open(public_model_path(), "rb") as f:
        raw = f.read()
    library = sentencepiece.SentencePieceProcessor(model_proto=raw + _field(2, _varint(3 << 3) + b"\x01"))
    model = read_model(public_model_path())
    for word in "the of whisper thing Anblewh schtzch éaux ciónasga a-b 12,345 x".split():
        assert library.nbest_encode_as_ids(word, 3)[0] == model.encode(word)


def test_trie():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6))) for _ in range(400)})
    trie = DoubleArray([(w, k) for k, w in enumerate(words)])

    def look(word):
        s = 0
        for c in word:
            t = trie.base[s] + trie.codes.get(c, 0)
            if not trie.codes.get(c) or t >= len(trie.check) or trie.check[t] != s:
                return -1
            s = t
        return trie.value[s]

    assert [look(w) for w in words] == list(range(len(words)))
    other = {"".join(rng.choice("abcdéf") for _ in range(5)) for _ in range(300)} - set(words)
    assert all(look(w) == -1 for w in other)


def test_byte_fallback_and_decoding():
    model = tiny_model({MARK: -1.0, "a": -1.0}, with_bytes=True)
    text = "a é\n日\U0001f600 "
    assert model.decode(model.encode(text)) == text
    assert model.decode([model.bytes[0xC3]]) == "�" and model.decode([0]) == " ⁇ "
    plain = tiny_model({MARK: -1.0, "a": -1.0})
    assert plain.encode("aé") == [1, 2, 0]


def test_round_trip_of_whole_tables(llm_spark, edge, empty):
    for df in (edge.withColumnRenamed("key", "ids"), llm_spark.read.parquet(DOCS)):
        for r in encode_documents(df, decoded_col="again").collect():
            if r["text"] is None:
                assert r["piece_ids"] is None and r["again"] is None
            else:
                assert r["again"] == r["text"].replace(MARK, " ")
                assert bool(r["piece_ids"]) == bool(r["text"])
    assert encode_documents(empty).count() == 0
    with pytest.raises(ValueError):
        encode_documents(edge, ids_col="key")
