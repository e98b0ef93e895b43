"""Operator 5: language identification with a string kernel.

Blended-spectrum presence kernel: the number of byte n-grams (2 to 4) that two texts share, over the root of the product
of their own numbers. A Nystroem map from landmark texts, then kernel ridge regression of one language against the rest.
Texts are scored in batches: a 0/1 matrix of the landmarks' n-grams in each text times the fitted coefficients of these.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, crc_of_id, slices

#: Bounds of the fit: texts and landmarks of each language, of all languages together (one of each at least), and
#: characters that are read of a text of the sample. All languages that occur are learned, and all texts scored whole.
PER_LANGUAGE, LANDMARKS, SAMPLE, ALL_LANDMARKS, MOST_CHARS = 250, 24, 4000, 768, 12000
SIZES, RIDGE = (2, 3, 4), 0.3
#: Languages up to which a hash of each is sent to all tasks (1 MB and a half).
FEW = 100_000
#: Bytes: ASCII letters lower, other ASCII a space; bytes of other letters as they are.
FOLD = np.array([c if c >= 128 else ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in range(256)], np.uint8)
#: Entries of a batch's matrix.
CELLS = 1 << 22
_WIDTH = np.uint64(36)


def presence(column: pa.Array):
    """(first row, rows, row of each n-gram, n-grams) for slices of a column: the distinct n-grams of each text, in order.

    Blanks in a row count once. A gram is its bytes and its size, so different grams are never one.
    """
    for i, j, buf, offsets in slices(column):
        b = FOLD[buf].astype(np.uint64)
        rows = np.repeat(np.arange(j - i, dtype=np.uint64), np.diff(offsets))
        blank = b == 32
        keep = ~blank
        keep[1:] |= ~blank[:-1] | (rows[1:] != rows[:-1])
        b, rows = b[keep], rows[keep]
        value, found = b, []
        for n in range(2, max(SIZES) + 1):
            m = max(0, len(b) - n + 1)
            value = value[:m] << np.uint64(8) | b[n - 1 :]
            if n in SIZES:
                whole = rows[:m] == rows[n - 1 :]
                found.append(rows[:m][whole] << _WIDTH | np.uint64(n) << np.uint64(32) | value[whole])
        keys = np.unique(np.concatenate(found))
        yield i, j - i, (keys >> _WIDTH).astype(np.int64), keys & ((np.uint64(1) << _WIDTH) - np.uint64(1))


def has_letter(column: pa.Array):
    for i, j, buf, offsets in slices(column):
        plain = np.r_[0, np.cumsum((FOLD[buf] != 32) & (buf < 128))]
        for k in range(j - i):
            a, b = offsets[k], offsets[k + 1]
            yield bool(plain[b] > plain[a]) or any(c.isalpha() for c in buf[a:b][buf[a:b] >= 128].tobytes().decode("utf-8", "ignore"))


class Places:
    """The place of each known n-gram: a table with open addressing, filled and read for all grams at once."""

    def __init__(self, grams: np.ndarray):
        self.grams = grams
        self.mask = (1 << max(4, int(4 * len(grams)).bit_length())) - 1
        self.slots = np.full(self.mask + 1, -1, np.int32)
        left, at = np.arange(len(grams), dtype=np.int32), self._hash(grams)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            later = self.slots[at] != left
            left, at = left[later], (at[later] + 1) & self.mask

    def _hash(self, grams: np.ndarray) -> np.ndarray:
        return ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)).astype(np.int64) & self.mask

    def find(self, grams: np.ndarray) -> np.ndarray:
        """Places, or -1."""
        out, left, at = np.full(len(grams), -1, np.int32), np.arange(len(grams)), self._hash(grams)
        while len(left):
            slot = self.slots[at]
            hit = (slot >= 0) & (self.grams[slot] == grams[left]) if len(self.grams) else slot >= 0
            out[left[hit]] = slot[hit]
            more = (slot >= 0) & ~hit
            left, at = left[more], (at[more] + 1) & self.mask
        return out


class Model:
    """classes, the landmarks' n-grams, and their coefficients: scores = presence @ weights / root of a text's number of n-grams."""

    def __init__(self, texts: list[str], langs: list[str], landmarks: int = LANDMARKS):
        self.classes = sorted(set(langs))
        if not self.classes:
            return
        landmarks = max(1, min(landmarks, ALL_LANDMARKS // len(self.classes)))
        column = pa.array(texts, pa.large_string())
        own = {lang: [k for k, x in enumerate(langs) if x == lang][:landmarks] for lang in self.classes}
        marks = sorted(k for places in own.values() for k in places)
        chosen = pa.array([texts[k] for k in marks], pa.large_string())
        self.places = Places(np.unique(np.concatenate([grams for *_, grams in presence(chosen)])))
        width = len(self.places.grams)
        z = np.zeros((len(marks), width), np.float32)
        for at, x, own in self._batches(chosen, width):
            z[at : at + len(x)] = x / own[:, None]
        kernel = np.zeros((len(texts), len(marks)))
        for at, x, own in self._batches(column, width):
            kernel[at : at + len(x)] = x @ z.T / own[:, None]
        value, vector = np.linalg.eigh(kernel[marks])
        root = vector * (1 / np.sqrt(np.maximum(value, 1e-8)))
        phi = kernel @ root
        y = np.where(np.array(langs)[:, None] == np.array(self.classes)[None, :], 1.0, -1.0)
        share = (len(langs) / len(self.classes) * (y > 0).sum(0)[(y > 0).argmax(1)] ** -1.0)[:, None]
        fit = np.linalg.solve(phi.T @ (share * phi) + RIDGE * np.eye(phi.shape[1]), phi.T @ (share * y))
        self.weights = (z.T @ (root @ fit)).astype(np.float32)

    def _batches(self, column: pa.Array, width: int):
        """(first row, 0/1 matrix of the known n-grams, root of the number of n-grams) of some texts at a time."""
        step = max(1, CELLS // max(width, 1))
        for i, n, rows, grams in presence(column):
            own = np.sqrt(np.maximum(np.bincount(rows, minlength=n), 1))
            place = self.places.find(grams)
            known = place >= 0
            rows, place = rows[known], place[known]
            cut = np.searchsorted(rows, np.arange(0, n + step, step))
            for k, (a, b) in enumerate(zip(cut[:-1], cut[1:])):
                x = np.zeros((min(step, n - k * step), width), np.float32)
                x[rows[a:b] - k * step, place[a:b]] = 1
                yield i + k * step, x, own[k * step : k * step + len(x)]

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        n = len(column)
        if not self.classes:
            return ["und"] * n, np.zeros(n)
        scores = np.zeros((n, len(self.classes)))
        for at, x, own in self._batches(column, len(self.places.grams)):
            scores[at : at + len(x)] = x @ self.weights / own[:, None]
        letters = np.fromiter(has_letter(column), bool, n) if n else np.zeros(0, bool)
        best = scores.argmax(1)
        p = np.exp(4 * (scores - scores.max(1, keepdims=True)))
        p = p[np.arange(n), best] / p.sum(1)
        return [self.classes[b] if ok else "und" for b, ok in zip(best, letters)], np.where(letters, p, 0.0)


def sample(docs: DataFrame) -> list:
    """(lang, t) of the bounded sample: of each language the rows of smallest hash, repeated rows once; t is cut to MOST_CHARS."""
    rows = docs.filter((F.pmod(crc_of_id(), F.lit(4)) != 2) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.select("lang", F.xxhash64("doc_id", "text").alias("h"), F.lower(F.left("text", F.lit(MOST_CHARS))).alias("t"))
    n = rows.select("lang").distinct().count()
    got = bounded_sample(rows, "lang", max(1, min(PER_LANGUAGE, SAMPLE // max(n, 1))), few=n <= FEW).collect()
    return sorted(got, key=lambda r: (r.h, r.lang, r.t))


def fit(docs: DataFrame) -> Model:
    got = sample(docs)
    return Model([r.t for r in got], [r.lang for r in got])


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, lang_pred, score) for each row; und and 0 where text is null or has no letter, or nothing was learned.

    Rows that repeat a doc_id are rows of their own; rows without one are scored, but not learned from.
    """
    model = model or fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            lang, score = shared.value.predict(batch.column("t"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    rows = docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("t"))
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """held_out is false for a row without doc_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(F.pmod(crc_of_id(), F.lit(4)) == 2, F.lit(False))
    return identify(docs).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
