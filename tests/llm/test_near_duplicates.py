import random

from archivolt.llm import ngram_join as op


def grams(text, n=5):
    w = (text or "").lower().encode().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, threshold=0.8):
    sets = [grams(t) for _, t in rows]
    links, up = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                up[find(i)] = find(j)
    low = {}
    for k, (d, _) in enumerate(rows):
        low[find(k)] = min(d, low.get(find(k), d))
    return sorted((d, low[find(k)], links[k]) for k, (d, _) in enumerate(rows))


def same(df, **options):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    return sorted(map(tuple, op.near_duplicates(df, **options).collect())) == brute(rows)


def variants(n, seed=3):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    base = [rnd.choice(words) for _ in range(120)]
    out = []
    for k in range(n):
        w = list(base) if k % 3 else [rnd.choice(words) for _ in range(100)]
        for _ in range(rnd.randrange(4)):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        out.append((k, " ".join(w)))
    return out


def test_documents(docs):
    assert same(docs)


def test_large_group_is_dealt_in_blocks(spark):
    df = spark.createDataFrame(variants(150), "doc_id long, text string")
    assert same(df, block=16)


def test_odd(odd, none):
    assert same(odd)
    assert op.near_duplicates(none).count() == 0


def test_bands_reach_the_recall():
    assert 1 - (1 - op.THRESHOLD**op.ROWS) ** op.band_count() >= op.RECALL


def test_stage_keeps_one_of_each_group(spark):
    text = " ".join(f"w{k}" for k in range(80))
    df = spark.createDataFrame([(3, text), (1, text), (2, text + " tail"), (9, "clean and short"), (8, ""), (7, None)], "doc_id long, text string")
    assert sorted(r.doc_id for r in op.stage(spark, df, "").collect()) == [1, 7, 8, 9]
