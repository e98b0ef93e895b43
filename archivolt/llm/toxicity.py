"""Operator 9: toxicity by a bidirectional gated recurrent network with attention pooling over word and character inputs.

A word enters as a learned embedding (words of several sample texts; all others share one) and as what a convolution over
the learned embeddings of its characters finds anywhere in it. The network reads windows of 32 words that overlap by half;
a document's score is that of its most toxic window, calibrated. All of it is trained together, in numpy, on a bounded
sample of labelled rows. What the sample's labels say of single words is where the first component of their embeddings
begins, and chooses the windows that the first epochs learn from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, crc_of_id, give_back, slices, small_batches, span_hashes, tidy, words

#: Bounds of the fit: rows of each label, and characters that are read of such a text. All texts are scored whole.
PER_LABEL, MOST_CHARS = 1000, 8000
LENGTH, STRIDE, HIDDEN, ATTEND = 32, 16, 8, 8
#: Sample texts that a word of its own must occur in; sizes of word and character embeddings, and of what characters give a word.
LEAST_TEXTS, WORD, CHAR, FILTERS = 3, 8, 6, 8
INPUTS = WORD + FILTERS
#: Epochs; after each `RANKED` of them windows are ranked anew. Share of words that train without their own embedding.
EPOCHS, RANKED, PASSES, BATCH, RATE, DROPPED = 12, 3, 2, 256, 0.02, 0.3
#: Each so many texts of the sample one is kept for the calibration and not learned from (of small samples none).
KEPT = 3
SMOOTH = 4.0
#: Bytes: ASCII letters lower, digits and other letters as they are, the rest a space.
FOLD = np.array([c if c >= 128 or chr(c).isdigit() else ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in range(256)], np.uint8)
FIRST, LAST = 1, 2


def odds(keys: np.ndarray, labels: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (text, word) pairs: the words, in how many texts each is, and its smoothed log-odds."""
    known, ids = np.unique(keys, return_inverse=True)
    toxic = np.bincount(ids, weights=labels, minlength=len(known))
    other = np.bincount(ids, weights=1 - labels, minlength=len(known))
    totals = np.maximum(totals, 1.0)
    share = totals / totals.sum()
    value = np.log((toxic + SMOOTH * share[1]) / totals[1]) - np.log((other + SMOOTH * share[0]) / totals[0])
    return known, toxic + other, np.clip(value, -4, 4)


class Words:
    """The distinct words of a slice: hash, characters between two marks, and where each occurs (which, rows)."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        folded = FOLD[buf]
        starts, ends, self.rows = words(folded, offsets)
        _, one, self.which = np.unique(span_hashes(folded, starts, ends), return_index=True, return_inverse=True)
        starts, ends = starts[one], ends[one]
        self.hash = span_hashes(folded, starts, ends)
        size = ends - starts
        self.first = np.r_[0, np.cumsum(size)[:-1]].astype(np.int64) if len(size) else np.zeros(0, np.int64)
        self.size = size
        inner = np.repeat(starts - self.first, size) + np.arange(int(size.sum()))
        at = np.arange(len(inner))
        before, after = folded[np.maximum(inner - 1, 0)], folded[np.minimum(inner + 1, len(folded) - 1)] if len(folded) else folded
        before[at[self.first] if len(size) else at] = FIRST
        if len(size):
            after[self.first + size - 1] = LAST
        self.chars = np.stack([before, folded[inner], after]) if len(inner) else np.zeros((3, 0), np.uint8)

    def take(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Characters, first character and size of some words."""
        size = self.size[chosen]
        first = np.r_[0, np.cumsum(size)[:-1]].astype(np.int64)
        return self.chars[:, np.repeat(self.first[chosen] - first, size) + np.arange(int(size.sum()))], first, size


def windows(rows: np.ndarray, n_rows: int):
    """Overlapping windows of all rows: (row, first word, words), as many as cover every word."""
    n = np.bincount(rows, minlength=n_rows)
    base = np.r_[0, np.cumsum(n)[:-1]]
    count = np.where(n > 0, np.maximum(1, -(-(n - (LENGTH - STRIDE)) // STRIDE)), 0)
    row = np.repeat(np.arange(n_rows), count)
    k = np.arange(len(row)) - np.repeat(np.r_[0, np.cumsum(count)[:-1]], count)
    return row, base[row] + k * STRIDE, np.minimum(LENGTH, n[row] - k * STRIDE)


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Network:
    def __init__(self, words: int = 0, seed: int = 5):
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"E": (0.1 * rng.standard_normal((words + 1, WORD))).astype(np.float32), "C": (0.5 * rng.standard_normal((256, CHAR))).astype(np.float32)}
        self.p |= {f"K{k}": draw(3 * CHAR, FILTERS)[:CHAR] for k in range(3)} | {"k": np.zeros(FILTERS, np.float32)}
        self.p |= {f"{k}{d}": v for d in "fb" for k, v in (("W", draw(INPUTS, 3 * HIDDEN)), ("U", draw(HIDDEN, 3 * HIDDEN)), ("b", np.zeros(3 * HIDDEN, np.float32)))}
        self.p |= {"A": draw(2 * HIDDEN, ATTEND), "a": np.zeros(ATTEND, np.float32), "v": draw(ATTEND), "w": draw(2 * HIDDEN), "c": np.zeros(1, np.float32)}

    def embed(self, ids: np.ndarray, chars: np.ndarray, first: np.ndarray, size: np.ndarray, keep: bool = False):
        """Inputs of words: their embeddings (ids; 0 for all that have none) and the best response of each filter in their characters."""
        p = self.p
        z = sum((p["C"] @ p[f"K{k}"])[chars[k]] for k in range(3)) + p["k"]
        best = np.maximum.reduceat(z, first, axis=0) if len(first) else np.zeros((0, FILTERS), np.float32)
        x = np.concatenate([p["E"][ids], np.tanh(best)], axis=1).astype(p["E"].dtype)
        return (x, (ids, chars, first, size, z, best, x)) if keep else x

    def embed_gradients(self, gx: np.ndarray, tape) -> dict[str, np.ndarray]:
        p, (ids, chars, first, size, z, best, x) = self.p, tape
        g = {"E": np.zeros_like(p["E"]), "C": np.zeros_like(p["C"])}
        np.add.at(g["E"], ids, gx[:, :WORD])
        slope = gx[:, WORD:] * (1 - x[:, WORD:] ** 2)
        won = z == np.repeat(best, size, axis=0)
        dz = won * np.repeat(slope / np.add.reduceat(won, first, axis=0), size, axis=0)
        g["k"] = dz.sum(0)
        for k in range(3):
            by_char = np.stack([np.bincount(chars[k], weights=dz[:, f], minlength=256) for f in range(FILTERS)], axis=1).astype(p["C"].dtype)
            g[f"K{k}"] = p["C"].T @ by_char
            g["C"] += by_char @ p[f"K{k}"].T
        return g

    def _scan(self, d: str, gates: np.ndarray, place: np.ndarray, mask: np.ndarray, keep: bool):
        """Hidden states (LENGTH, windows, HIDDEN) of one direction; gates: input parts of each word, place: word of each step."""
        h = np.zeros((place.shape[1], HIDDEN), gates.dtype)
        out, tape = np.empty((LENGTH, *h.shape), gates.dtype), []
        u, k = self.p["U" + d], HIDDEN
        for t in range(LENGTH) if d == "f" else range(LENGTH - 1, -1, -1):
            x, hu, m = gates[place[t]], h @ u, mask[t][:, None]
            zr = _sigmoid(x[:, : 2 * k] + hu[:, : 2 * k])
            z, r = zr[:, :k], zr[:, k:]
            n = np.tanh(x[:, 2 * k :] + r * hu[:, 2 * k :])
            new = h + m * (1 - z) * (n - h)
            if keep:
                tape.append((t, h, z, r, n, hu[:, 2 * k :], m))
            h = out[t] = new
        return out, tape

    def forward(self, x: np.ndarray, place: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows; x: inputs of distinct words, place (LENGTH, windows): the word at each step."""
        p = self.p
        scans = [self._scan(d, x @ p["W" + d] + p["b" + d], place, mask, keep) for d in "fb"]
        h = np.concatenate([s[0] for s in scans], axis=2)
        e = np.tanh(h @ p["A"] + p["a"])
        s = np.where(mask > 0, e @ p["v"], -1e9)
        alpha = np.exp(s - s.max(0))
        alpha /= alpha.sum(0)
        pooled = (alpha[:, :, None] * h).sum(0)
        logit = pooled @ p["w"] + p["c"][0]
        return (logit, (x, place, scans, h, e, alpha, pooled)) if keep else logit

    def gradients(self, slope, tape):
        """Gradients of sum(slope * logit), and those of the words' inputs."""
        p, (x, place, scans, h, e, alpha, pooled) = self.p, tape
        g = {"w": pooled.T @ slope, "c": np.array([slope.sum()], p["c"].dtype)}
        dp = slope[:, None] * p["w"]
        dh = alpha[:, :, None] * dp
        ds = alpha * ((h * dp).sum(2) - (pooled * dp).sum(1))
        de = ds[:, :, None] * p["v"] * (1 - e * e)
        g["v"] = (ds[:, :, None] * e).sum((0, 1))
        g["A"] = np.einsum("tbi,tbj->ij", h, de)
        g["a"] = de.sum((0, 1))
        dh = dh + de @ p["A"].T
        k, gx = HIDDEN, np.zeros_like(x)
        for d, (_, steps), part in zip("fb", scans, (dh[:, :, :k], dh[:, :, k:])):
            u, carry = p["U" + d], 0.0
            gates, gu = np.zeros((len(x), 3 * k), x.dtype), np.zeros_like(u)
            for t, before, z, r, n, hun, m in reversed(steps):
                dn_ = part[t] + carry
                dn = dn_ * m * (1 - z) * (1 - n * n)
                dz = -dn_ * m * (n - before) * z * (1 - z)
                dr = dn * hun * r * (1 - r)
                np.add.at(gates, place[t], np.concatenate([dz, dr, dn], axis=1))
                hidden = np.concatenate([dz, dr, dn * r], axis=1)
                gu += before.T @ hidden
                carry = dn_ * (1 - m * (1 - z)) + hidden @ u.T
            g |= {"W" + d: x.T @ gates, "U" + d: gu, "b" + d: gates.sum(0)}
            gx += gates @ p["W" + d].T
        return g, gx

    def logits(self, x, which, first, size, step: int = 4096) -> np.ndarray:
        """Logits of windows over occurrences: first occurrence and number of words of each."""
        parts = [self.forward(x, *steps_of(which, first[k : k + step], size[k : k + step])) for k in range(0, len(first), step)]
        return np.concatenate(parts) if parts else np.zeros(0, np.float32)


def steps_of(which: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(LENGTH, windows): the word at each step of each window, and 1 where there is one."""
    steps = np.arange(LENGTH)[:, None]
    return which[np.minimum(first[None, :] + steps, len(which) - 1)], (steps < size[None, :]).astype(np.float32)


class Model:
    """Vocabulary, network and calibration of a sample (texts lower-cased; labels 0 or 1)."""

    def __init__(self, texts: list[str], labels: list[int], share: float | None = None, epochs: int = EPOCHS, seed: int = 5):
        """share: the share of toxic rows among all labelled ones; by default that of the sample."""
        y = np.array(labels, np.int64)
        self.prior = float(np.clip(y.mean() if share is None else share, 1e-4, 1 - 1e-4)) if len(y) else 0.5
        self.scale, self.shift, self.keys = 1.0, 0.0, np.zeros(0, np.uint64)
        raw = "".join(texts).encode()
        offsets = np.r_[0, np.cumsum([len(t.encode()) for t in texts])].astype(np.int64)
        w = Words(np.frombuffer(raw, np.uint8), offsets)
        self.trained = len(set(labels)) == 2 and len(w.rows) > 0
        if not self.trained:
            return
        pair = np.unique(w.rows * len(w.hash) + w.which)
        row, word = pair // len(w.hash), pair % len(w.hash)
        _, n, value = odds(word, y[row], np.array([(y == 0).sum(), (y == 1).sum()], float))
        self.keys = np.sort(w.hash[n >= LEAST_TEXTS])
        self.net = Network(len(self.keys), seed)
        often = n >= LEAST_TEXTS
        self.net.p["E"][1:, 0] = value[often][np.argsort(w.hash[often])] / 2
        self._train(w, np.where(n >= LEAST_TEXTS, value, 0.0), y, epochs, seed)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word's embedding; 0 if it has none of its own."""
        if not len(self.keys):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, at + 1, 0)

    def _train(self, w: Words, value: np.ndarray, y: np.ndarray, epochs: int, seed: int) -> None:
        rng, moments, step = np.random.default_rng(seed), {k: [0.0, 0.0] for k in self.net.p}, 0
        row, first, size = windows(w.rows, len(y))
        ids = self.ids(w.hash)
        total = np.r_[0, np.cumsum(np.maximum(value[w.which], 0))]
        rank = total[first + size] - total[first]
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        learns = (np.arange(len(starts)) % KEPT != 0) | (len(starts) < 20 * KEPT)
        for epoch in range(epochs):
            top = np.lexsort((-rank, row))[starts][learns]
            other = starts + (rng.random(len(starts)) * np.diff(np.r_[starts, len(row)])).astype(np.int64)
            chosen = np.unique(np.r_[top, other[learns & (y[row[starts]] == 0)]])
            for _ in range(max(PASSES, 8 * BATCH // max(len(chosen), 1))):
                rng.shuffle(chosen)
                for k in range(0, len(chosen), BATCH):
                    b = chosen[k : k + BATCH]
                    place, mask = steps_of(w.which, first[b], size[b])
                    used, place = np.unique(place, return_inverse=True)
                    own = np.where(rng.random(len(used)) < DROPPED, 0, ids[used])
                    x, made = self.net.embed(own, *w.take(used), keep=True)
                    logit, tape = self.net.forward(x, place.reshape(mask.shape), mask, keep=True)
                    g, gx = self.net.gradients((_sigmoid(logit) - y[row[b]]).astype(np.float32) / len(b), tape)
                    g |= self.net.embed_gradients(gx, made)
                    step += 1
                    for name, v in self.net.p.items():
                        m = moments[name]
                        m[0] = 0.9 * m[0] + 0.1 * g[name]
                        m[1] = 0.99 * m[1] + 0.01 * g[name] ** 2
                        v -= RATE * ((m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-6))
            if epoch % RANKED == RANKED - 1 or epoch == epochs - 1:
                rank = self.net.logits(self.net.embed(ids, w.chars, w.first, w.size), w.which, first, size)
        judges = ~learns if not learns.all() else learns
        self._calibrate(np.maximum.reduceat(rank, starts).astype(float)[judges], y[row[starts]][judges])

    def _calibrate(self, s, y):
        """Logistic regression of the label on the largest logit, with a little ridge; labels weigh as in all labelled rows.

        Newton's steps are halved until they lower the loss; else they go astray where the labels lie far apart.
        """
        middle = float(s.mean())
        s, sign = s - middle, np.where(y == 1, -1.0, 1.0)
        a, b = 1.0, 0.0
        weight = np.where(y == 1, self.prior / max(y.mean(), 1e-9), (1 - self.prior) / max(1 - y.mean(), 1e-9))
        loss = lambda a, b: float((weight * np.logaddexp(0, sign * (a * s + b))).sum() + 0.05 * (a - 1) ** 2)
        for _ in range(50):
            p = _sigmoid(np.clip(a * s + b, -500, 500))
            w = weight * (p * (1 - p) + 1e-6)
            off = weight * (p - y)
            grad = np.array([(off * s).sum() + 0.1 * (a - 1), off.sum()])
            hess = np.array([[(w * s * s).sum() + 0.1, (w * s).sum()], [(w * s).sum(), w.sum()]])
            move, now = np.linalg.solve(hess, grad), loss(a, b)
            while abs(move).max() > 1e-9 and loss(a - move[0], b - move[1]) > now:
                move = move / 2
            a, b = a - move[0], b - move[1]
        self.scale = max(float(a), 1e-3)
        self.shift = float(b) - self.scale * middle

    def score(self, column: pa.Array) -> np.ndarray:
        """Scores of texts (lower-cased); without words or training: the sample's share of toxic rows, below one half."""
        out = np.full(len(column), min(self.prior, 0.49))
        if not self.trained:
            return out
        for i, j, buf, offsets in slices(column):
            w = Words(buf, offsets)
            if not len(w.rows):
                continue
            row, first, size = windows(w.rows, j - i)
            head = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            x = self.net.embed(self.ids(w.hash), w.chars, w.first, w.size)
            best = np.maximum.reduceat(self.net.logits(x, w.which, first, size), head)
            out[i + row[head]] = _sigmoid(np.clip(self.scale * best.astype(float) + self.shift, -30, 30))
        return out


def sample(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> tuple[list, float]:
    """At most per_label rows (t, toxic) of each label, those of smallest hash among ids with crc32 mod 5 not 0, and the share of toxic rows.

    A doc_id with two labels has the greater one. Rows that repeat a doc_id and text count once; t is cut to MOST_CHARS.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & (F.pmod(crc_of_id(), F.lit(5)) != 0)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = bounded_sample(known.withColumn("h", F.xxhash64("doc_id")), "toxic", per_label)
    rows = docs.select("doc_id", "text").filter(F.col("text").isNotNull() & (F.pmod(crc_of_id(), F.lit(5)) != 0))
    # at most 2 * per_label ids: small enough to send to all
    texts = rows.join(F.broadcast(chosen.select("doc_id", "toxic")), "doc_id").select("toxic", F.xxhash64("doc_id", "text").alias("h"), F.lower(F.left("text", F.lit(MOST_CHARS))).alias("t"))
    got = bounded_sample(texts, "toxic", per_label).collect()
    count = dict(known.groupBy("toxic").count().collect())
    return sorted(got, key=lambda r: (r.h, r.t)), count.get(1, 0) / max(1, sum(count.values()))


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model:
    got, share = sample(docs, labels, per_label)
    model = Model([r.t for r in got], [r.toxic for r in got], share)
    del got
    give_back()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with a column toxic_score (double; _2 added to its name as often as docs has it) appended; one row per row, null and empty texts and repeated or null ids included."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"_{k}" for k in range(len(docs.columns))]
    rows = docs.toDF(*names).withColumn("low", F.lower(F.coalesce(names[docs.columns.index("text")], F.lit(""))))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(shared.value.score(batch.column("low")))], names=[*names, "score"])

    kinds = ", ".join(f"{n} {t}" for n, (_, t) in zip(names, docs.dtypes))
    last = "toxic_score"
    while last in docs.columns:
        last += "_2"
    return rows.mapInArrow(tidy(run), f"{kinds}, score double").toDF(*docs.columns, last)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """held_out is false for a row without doc_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = F.coalesce(F.pmod(crc_of_id(), F.lit(5)) == 0, F.lit(False))
    out = score(docs, model).select("doc_id", held_out.alias("held_out"), F.col("toxic_score").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents with a score of one half or more."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, model)
    return scored.filter(F.col(scored.columns[-1]) < 0.5).select(*docs.columns)
