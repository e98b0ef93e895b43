import functools

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from archivolt.llm import sentence_pieces as op

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_ids_of_all_documents_are_the_librarys(spark, library):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    t = op.transducer()
    assert [t.encode(r.text) for r in rows] == library.encode([r.text or "" for r in rows])


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=30), st.text("the aninger.\n", max_size=90), st.text("aab ▁é", max_size=20)))
def test_ids_are_the_librarys(text):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    text = text.replace("\0", "")
    t = op.transducer()
    assert t.encode(text) == library.encode(text)
    assert t.decode(t.encode(text)) == text.replace("▁", " ")


def ways(t, raw):
    """All paths over raw, as pieces."""
    if not raw:
        return [[]]
    n = next(k for k in range(1, 5) if k == len(raw) or raw[k] & 0xC0 != 0x80)
    out = [[-1, *w] for w in ways(t, raw[n:])] if raw[:n] not in t.arcs else []
    return out + [[t.arcs[raw[:k]], *w] for k in range(1, len(raw) + 1) if raw[:k] in t.arcs for w in ways(t, raw[k:])]


@settings(max_examples=60, deadline=None)
@given(st.text("theani \né☃", min_size=1, max_size=9))
def test_one_path_is_finite_and_unigram_weight_is_least(text):
    t = op.transducer()
    raw = t.normal(text)
    all_ways = ways(t, raw)
    finite = [w for w in all_ways if all(k < 0 or t.follows(u, k) for u, k in zip([-1, *w], w))]
    whole = lambda w: [k for k in w if k >= 0]
    ids = t._finite(raw)
    assert len(finite) == 1 and whole(finite[0]) == [k for k in ids if k in set(t.arcs.values())]
    cost = lambda w: sum(t.unknown if k < 0 else -t.scores[k] for k in w)
    least = [k for k in t._least(raw) if k in set(t.arcs.values())]
    chars = sum(k < 0 for k in min(all_ways, key=cost))
    assert cost(least) + chars * t.unknown == pytest.approx(min(map(cost, all_ways)))


@functools.cache
def model(kind, prefix, squeeze):
    """A small model file: pieces a, b, ab, blank and bytes."""
    import struct
    import tempfile

    one = lambda f, v: bytes([f << 3]) + bytes([v])
    text = lambda f, v: bytes([f << 3 | 2, len(v)]) + v
    piece = lambda p, s, k: text(1, text(1, p.encode()) + bytes([2 << 3 | 5]) + struct.pack("<f", s) + one(3, k))
    raw = b"".join(piece(p, s, 1) for p, s in (("▁", -3.0), ("a", -2.0), ("b", -2.5), ("ab", -1.0))) + b"".join(piece(f"<0x{k:02X}>", 0.0, 6) for k in range(256))
    with tempfile.NamedTemporaryFile(suffix=".model", delete=False) as f:
        f.write(raw + text(2, one(3, kind)) + text(3, one(3, prefix) + one(4, squeeze)))
    return op.Transducer(f.name)


def test_normaliser_flags():
    assert model(2, 1, 1).normal("  a  b ") == b" a b" and model(2, 0, 0).normal(" a  b") == b" a  b"
    assert model(1, 1, 1).encode("ab") == [0, 3] == model(2, 1, 1).encode("ab")
    assert model(1, 0, 1).decode(model(1, 0, 1).encode("aé")) == "aé"


def test_odd(odd, none):
    rows = {(r.doc_id, r.text) for r in op.decode(op.encode(odd)).collect()}
    assert rows == {(r.doc_id, r.text or "") for r in odd.collect()}
    assert op.digest(odd).filter("not round_trip").count() == 0 and op.digest(none).count() == 0
