import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from archivolt.llm import media as op


def brute(doc_id, text):
    raw = (text or "").encode()
    payload = raw + b"\xff" * ((576 - len(raw) % 576) % 576 or (0 if raw else 576))
    pgm = b"P5\n576 %d\n255\n" % (len(payload) // 576) + payload
    return (doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(pgm), hashlib.sha256(pgm).hexdigest(), op.features(payload))


def check(df):
    assert sorted(map(tuple, op.media(df).collect())) == sorted(brute(r.doc_id, r.text) for r in df.collect())


def test_documents(docs):
    check(docs)


def test_odd(odd, none):
    check(odd)
    assert op.media(none).count() == 0


def shared(spark):
    rng = np.random.default_rng(3)
    part = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    passage = part(30000)
    return spark.createDataFrame([(k, part(int(rng.integers(0, 3000))) + passage + part(500)) for k in range(20)], "doc_id long, text string")


def test_shared_chunks_are_stored_once(spark):
    df = shared(spark)
    check(df)
    recipes, stored = op.store(df)
    ids = [bytes(i) for r in stored.collect() for i in r.own]
    assert len(ids) == len(set(ids)) and set(ids) == {bytes(i) for r in recipes.collect() for i in r.ids}
    assert len(ids) < 0.5 * sum(len(r.ids) for r in recipes.collect())


def test_the_store_holds_the_digested_bytes(spark):
    """Put together by hand from the stored frames, in the order of the lists, the chunks are the images that the query digests."""
    df = shared(spark)
    recipes, stored = op.store(df, passes=1)
    unpack, frames = zstandard.ZstdDecompressor(), {}
    for r in stored.collect():
        frames |= {bytes(i): unpack.decompress(bytes(z)) for i, z in zip(r.own, r.zs)}
    assert all(op.chunk_id(c) == i for i, c in frames.items())
    media = {r.doc_id: b"".join(frames[bytes(i)] for i in r.ids) for r in recipes.collect()}
    assert {r.doc_id: (len(media[r.doc_id]), hashlib.sha256(media[r.doc_id]).hexdigest()) for r in df.collect()} == {r.doc_id: (r.media_bytes, r.media_sha256) for r in op.media(df).collect()}


def test_a_wrong_chunk_is_found():
    media = op.media_of(b"some text")
    ids = [op.chunk_id(c) for c in op.chunks(media)]
    pack = zstandard.ZstdCompressor()
    row = lambda zs: pa.RecordBatch.from_pylist([{"content": hashlib.sha256(media).digest(), "ids": ids, "own": ids, "zs": zs, "away": None}])
    good = [pack.compress(c) for c in op.chunks(media)]
    assert next(op._read([row(good)])).num_rows == 1
    with pytest.raises(ValueError, match="digest"):
        next(op._read([row([pack.compress(b"other"), *good[1:]])]))


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=5000).map(lambda b: b * 9))
def test_chunks(data):
    parts = op.chunks(data)
    assert b"".join(parts) == data and all(0 < len(p) <= op.MOST for p in parts) and all(len(p) >= op.LEAST for p in parts[:-1])


def test_gear_hash_is_rolling():
    data = np.random.default_rng(0).integers(0, 256, 300).astype(np.uint8)
    h, slow = op.gear_hashes(data), 0
    for k, b in enumerate(data):
        slow = (slow * 2 + int(op.GEAR[b])) % 2**32
        assert h[k] == slow


def test_null_ids(spark):
    df = spark.createDataFrame([(None, "shared text"), (None, None), (3, "shared text"), (None, "own " * 3000)], "doc_id long, text string")
    assert sorted(map(tuple, op.media(df).collect()), key=str) == sorted((brute(r.doc_id, r.text) for r in df.collect()), key=str)
