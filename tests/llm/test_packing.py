import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from archivolt.llm import packing


def reference_ids(texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [e.ids + [0] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check(df):
    rows = df.select("doc_id", "text").collect()
    ids = dict(zip([r.doc_id for r in rows], reference_ids([r.text for r in rows])))
    got = packing.pack(df).orderBy("sequence_id", "offset").collect()
    at, seen = {}, {}
    for r in got:
        assert r.offset == at.get(r.sequence_id, 0) and r.length > 0
        at[r.sequence_id] = r.offset + r.length
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        seen.setdefault(r.doc_id, []).append((r.start, r.length))
    for doc, pieces in seen.items():
        pieces.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:])) and pieces[0][0] == 0 and sum(n for _, n in pieces) == len(ids[doc])
    assert set(seen) == set(ids) and max(at.values()) <= 1024
    short = [n for n in at.values() if n not in packing.TIERS]
    assert len(short) <= df.rdd.getNumPartitions()


def test_documents(docs):
    check(docs)


def test_ids_of_all_documents(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    assert [packing.token_ids(t).tolist() for t in texts] == reference_ids(texts)


def test_odd(odd, none):
    check(odd.dropDuplicates(["doc_id"]))
    assert packing.pack(odd).selectExpr("sum(length)").first()[0] == sum(map(len, reference_ids([r.text for r in odd.collect()])))
    assert packing.pack(none).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_rank_file_gives_the_same_ids(texts):
    texts = [*texts, "a <|endoftext|> b", " \n\n\t x y"]
    assert [packing.token_ids(t).tolist() for t in texts] == reference_ids(texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 3000), max_size=60))
def test_windows_are_full_but_the_last(sizes):
    p = packing.Packer(pool=2000)
    out = []
    for k, n in enumerate(sizes):
        p.add(k, np.arange(n, dtype=np.uint32))
        out += p.windows()
    out += p.windows(last=True)
    used = [sum(len(x[2]) for x in pieces) for _, pieces in out]
    assert sum(used) == sum(sizes) and sum(u != size for u, (size, _) in zip(used, out)) <= 1


def test_step_groups_balance():
    sizes = [1024] * 50 + [128] * 70 + [512] * 9
    groups = packing.step_groups(sizes)
    load = np.bincount(groups, weights=sizes)
    assert load.max() - load.min() <= 1024
