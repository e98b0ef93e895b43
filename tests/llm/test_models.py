"""Language identification and toxicity: kernels and gradients against plain versions, held-out accuracy, odd rows."""

import numpy as np
import pyarrow as pa
import pytest

from archivolt.llm import language_id as lang
from archivolt.llm import toxicity as tox

SF = "/root/testdata/sf0.01"


def grams_of(text):
    raw = lang.FOLD[np.frombuffer(text.lower().encode(), np.uint8)].tobytes()
    while b"  " in raw:
        raw = raw.replace(b"  ", b" ")
    return {raw[i : i + n] for n in lang.SIZES for i in range(len(raw) - n + 1)}


def test_presence_is_the_set_of_grams():
    texts = ["abc  abd!", "", "é x", "zz" * 300, "  ", " a"]
    for i, n, rows, grams in lang.presence(pa.array(texts, pa.large_string())):
        got = [{(int(g) & 0xFFFFFFFF).to_bytes(int(g) >> 32, "big") for g in grams[rows == k]} for k in range(n)]
        assert got == [grams_of(t) for t in texts[i : i + n]]


def test_places():
    grams = np.unique(np.random.default_rng(1).integers(0, 2**35, 5000, dtype=np.uint64))
    places = lang.Places(grams)
    assert (places.find(grams) == np.arange(len(grams))).all() and (places.find(grams + np.uint64(1 << 36)) == -1).all()
    assert lang.Places(grams[:0]).find(grams[:3]).tolist() == [-1, -1, -1]


def plain_model(texts, langs, landmarks):
    """Kernel, map and regression on sets of bytes: scores of a text by class."""
    sets, classes = [grams_of(t) for t in texts], sorted(set(langs))
    marks = [k for k in range(len(texts)) if langs[:k].count(langs[k]) < landmarks]
    kernel = lambda a, b: len(a & b) / np.sqrt(max(1, len(a)) * max(1, len(b)))
    full = np.array([[kernel(a, sets[m]) for m in marks] for a in sets])
    value, vector = np.linalg.eigh(full[marks])
    root = vector / np.sqrt(np.maximum(value, 1e-8))
    phi = full @ root
    y = np.array([[1.0 if x == c else -1.0 for c in classes] for x in langs])
    share = np.array([[len(langs) / len(classes) / langs.count(x)] for x in langs])
    w = np.linalg.solve(phi.T @ (share * phi) + lang.RIDGE * np.eye(len(marks)), phi.T @ (share * y))
    return classes, lambda t: np.array([kernel(grams_of(t), sets[m]) for m in marks]) @ root @ w


def test_query_against_a_plain_version(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    train = lang.sample(docs)
    classes, plain = plain_model([r.t for r in train], [r.lang for r in train], lang.LANDMARKS)
    got = {r.doc_id: r for r in lang.query(spark, sf).collect()}
    import zlib

    for r in rows:
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if not any(c.isalpha() for c in r.text or ""):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0)
            continue
        s = plain(r.text)
        p = np.exp(4 * (s - s.max()))
        assert got[r.doc_id].score == pytest.approx(p.max() / p.sum(), abs=2e-3)
        assert got[r.doc_id].lang_pred == classes[int(s.argmax())] or np.sort(s)[-1] - np.sort(s)[-2] < 1e-3


def test_all_languages_are_learned_and_the_sample_is_bounded(spark):
    rows = [(k, f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)} " * 20, f"l{k % 100}") for k in range(2000)] + [(5, "same text", "l0")] * 500 + [(None, "x", "l1")]
    got = lang.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len({r.lang for r in got}) == 100 and len(got) <= lang.SAMPLE
    assert max(sum(r.lang == x for r in got) for x in ("l0", "l1")) <= lang.SAMPLE // 100


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = lang.query(spark, SF).join(docs, "doc_id").filter("held_out")
    right, n = got.selectExpr("avg(cast(lang_pred = lang as double))", "count(*)").first()
    assert n > 200 and right > 0.98


def test_language_odd(spark, odd, none):
    got = {(r.doc_id, r.lang_pred) for r in lang.identify(odd).collect()}
    assert (2, "und") in got and (1, "und") in got and (5, "und") in got and not {(3, "und"), (8, "und")} & got
    assert lang.identify(none).count() == 0


def test_gradients():
    """Of all parameters, through pooling, both directions, embeddings and the convolution over characters."""
    rng = np.random.default_rng(1)
    net = tox.Network(4)
    net.p = {k: v.astype(np.float64) + (0.1 if v.ndim == 1 else 0) for k, v in net.p.items()}
    text = " ".join("".join(rng.choice(list("abcdé"), rng.integers(1, 7))) for _ in range(60)).encode()
    w = tox.Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    ids = np.arange(len(w.hash)) % 5
    place, mask = tox.steps_of(w.which, np.array([0, 10, 30]), np.array([32, 20, 1]))
    slope = np.array([1.0, -2.0, 0.5])
    value = lambda: float((slope * net.forward(net.embed(ids, w.chars, w.first, w.size), place, mask)).sum())
    x, made = net.embed(ids, w.chars, w.first, w.size, keep=True)
    _, tape = net.forward(x, place, mask, keep=True)
    got, gx = net.gradients(slope, tape)
    got |= net.embed_gradients(gx, made)
    assert set(got) == set(net.p)
    for name, v in net.p.items():
        for at in [tuple(rng.integers(0, s) if name != "C" else (97 + rng.integers(0, 4) if k == 0 else rng.integers(0, s)) for k, s in enumerate(v.shape)) for _ in range(4)]:
            old, ends = v[at], []
            for e in (1e-4, -1e-4):
                v[at] = old + e
                ends.append(value())
            v[at] = old
            assert got[name][at] == pytest.approx((ends[0] - ends[1]) / 2e-4, rel=0.05, abs=2e-3), name


def plain_score(model, text):
    """The network word by word and window by window."""
    p, sig = {k: v.astype(float) for k, v in model.net.p.items()}, lambda v: 1 / (1 + np.exp(-v))
    parts = tox.FOLD[np.frombuffer(text.lower().encode(), np.uint8)].tobytes().split()
    if not parts:
        return min(model.prior, 0.49)
    inputs = []
    for word in parts:
        h = tox.span_hashes(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))[0]
        own = int(np.flatnonzero(model.keys == h)[0]) + 1 if h in model.keys else 0
        marked = bytes([tox.FIRST]) + word + bytes([tox.LAST])
        z = [sum(p["C"][marked[i + k]] @ p[f"K{k}"] for k in range(3)) + p["k"] for i in range(len(word))]
        inputs.append(np.r_[p["E"][own], np.tanh(np.max(z, axis=0))])
    best, at, k = -np.inf, 0, tox.HIDDEN
    while True:
        win, states = inputs[at : at + tox.LENGTH], []
        for d, order in (("f", range(len(win))), ("b", range(len(win) - 1, -1, -1))):
            h, own = np.zeros(k), [None] * len(win)
            for t in order:
                g, u = win[t] @ p["W" + d] + p["b" + d], h @ p["U" + d]
                z, r = sig(g[:k] + u[:k]), sig(g[k : 2 * k] + u[k : 2 * k])
                h = own[t] = h + (1 - z) * (np.tanh(g[2 * k :] + r * u[2 * k :]) - h)
            states.append(own)
        hs = [np.r_[a, b] for a, b in zip(*states)]
        s = np.array([np.tanh(h @ p["A"] + p["a"]) @ p["v"] for h in hs])
        alpha = np.exp(s - s.max())
        best = max(best, sum(a * h for a, h in zip(alpha / alpha.sum(), hs)) @ p["w"] + p["c"][0])
        if at + tox.LENGTH >= len(inputs):
            return sig(np.clip(model.scale * best + model.shift, -30, 30))
        at += tox.STRIDE


def test_scores_against_a_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = tox.fit(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    for r in tox.score(docs.select("doc_id", "text").filter("length(text) < 3000"), model).limit(25).collect():
        assert r.toxic_score == pytest.approx(plain_score(model, r.text or ""), abs=2e-3)


def test_windows_cover_every_word():
    rows = np.repeat([0, 2, 3, 4], [5, 33, 32, 100])
    row, first, size = tox.windows(rows, 5)
    seen = {int(w) for f, s in zip(first, size) for w in range(f, f + s)}
    assert seen == set(range(len(rows))) and size.min() > 0 and size.max() <= tox.LENGTH
    assert all(rows[f] == r == rows[f + s - 1] for r, f, s in zip(row, first, size))


def test_toxicity_held_out(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = tox.query(spark, "/root/testdata/sf0.1").join(labels, "doc_id").filter("held_out")
    clean = got.filter("toxic = 0").selectExpr("avg(predicted)").first()[0]
    caught = got.filter("toxic = 1").selectExpr("avg(predicted)").first()[0]
    assert clean < 0.02 and caught > 0.85


def test_toxicity_odd(spark, odd, none):
    labels = spark.createDataFrame([(1, 0), (3, 1), (4, 0), (7, None), (None, 1)], "doc_id long, toxic int")
    model = tox.fit(odd, labels)
    out = tox.score(odd, model)
    assert out.count() == odd.count() and out.filter("toxic_score is null or toxic_score < 0 or toxic_score > 1").count() == 0
    assert tox.score(none, model).count() == 0
    assert tox.score(odd, tox.fit(none, labels)).filter("toxic_score >= 0.5").count() == 0


def test_toxicity_sample_is_bounded(spark):
    docs = spark.createDataFrame([(k % 50, f"text {k % 7} " + "x" * 20000) for k in range(500)] + [(None, "y")], "doc_id long, text string")
    labels = spark.createDataFrame([(k % 50, k % 2) for k in range(100)], "doc_id long, toxic int")
    got, share = tox.sample(docs, labels, per_label=5)
    assert len(got) == 10 and {len(r.t) for r in got} == {tox.MOST_CHARS} and 0 < share < 1


def test_calibration_of_labels_that_lie_far_apart():
    """Undamped steps ended at a shift of -12 here, below which no row was toxic."""
    rng = np.random.default_rng(3)
    s = np.r_[np.clip(rng.normal(1.5, 3, 580), -6, 7.3), np.clip(rng.normal(8.5, 0.5, 87), 7.1, 9.3)]
    y = np.r_[np.zeros(580, np.int64), np.ones(87, np.int64)]
    model = tox.Model.__new__(tox.Model)
    model.prior = 0.1
    model._calibrate(s, y)
    found = model.scale * s + model.shift >= 0
    assert found[y == 1].mean() > 0.9 and found[y == 0].mean() < 0.02
