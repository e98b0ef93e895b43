"""Operator 10: long repeated passages, by paths of a token de Bruijn graph.

A window of 13 words is an edge of the graph; consecutive windows of a document with the same smallest
5-gram (the anchor) form a path. Paths are dealt by anchor, so that all occurrences of an edge meet;
equal paths compact to one, and edges are compared only where paths of an anchor differ (branch). A join
of the documents' paths with the answers gives the coordinates of the repeated spans.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import document_key, free_shuffles, mix, ngram_hashes, signed, slices, span_hashes, table, words

WINDOW, ANCHOR = 13, 5
#: Most windows of one path: a bit of a long marks each.
LONGEST = 64
_STEP = np.uint64(0x9E3779B97F4A7C15)


def path_ids(anchor: np.ndarray, edges: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit id of each path: its anchor and the 64-bit hashes of its edges, in order."""
    count = np.diff(np.r_[first, len(edges)])
    place = np.arange(len(edges), dtype=np.uint64) - np.repeat(first, count).astype(np.uint64)
    return mix(np.add.reduceat(mix(edges + place * _STEP), first) + anchor * np.uint64(3) + count.astype(np.uint64))


def paths(column: pa.Array, window: int = WINDOW, anchor: int = ANCHOR):
    """(row, anchor, edges, first edge of each path, first word of each path) for slices of the column."""
    for i, _, buf, offsets in slices(column):
        starts, ends, rows = words(buf, offsets)
        n = len(starts) - window + 1
        if n <= 0:
            continue
        hashes = span_hashes(buf, starts, ends)
        edges, at = ngram_hashes(hashes, rows, window)
        if not len(at):
            continue
        grams = np.full(len(starts), np.iinfo(np.uint64).max, np.uint64)
        values, where = ngram_hashes(hashes, rows, anchor)
        grams[where] = values
        low, width, need = grams, 1, window - anchor + 1
        while width * 2 <= need:
            low = np.minimum(low[: len(low) - width], low[width:])
            width *= 2
        if need > width:
            low = np.minimum(low[: len(low) - (need - width)], low[need - width :])
        low = low[at]
        new = np.r_[True, (low[1:] != low[:-1]) | (at[1:] != at[:-1] + 1)]
        runs = np.flatnonzero(new)
        new |= (np.arange(len(at)) - np.repeat(runs, np.diff(np.r_[runs, len(at)]))) % LONGEST == 0
        first = np.flatnonzero(new)
        base = np.searchsorted(rows, np.arange(len(offsets)))
        row = rows[at[first]]
        yield i + row, low[first], edges, first, at[first] - base[row]


def _lists(edges: np.ndarray, first: np.ndarray, take: np.ndarray) -> pa.Array:
    """Binary values: the edges of the paths `take`."""
    bounds = np.r_[first, len(edges)]
    sizes = (bounds[1:] - bounds[:-1])[take]
    at = np.repeat(bounds[:-1][take] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
    return pa.Array.from_buffers(pa.binary(), len(take), [None, pa.py_buffer(np.r_[0, np.cumsum(sizes) * 8].astype(np.int32)), pa.py_buffer(np.ascontiguousarray(edges[at]))])


def _emit_paths(batches):
    """Paths for their anchors; equal ones of a slice are one row with the smallest doc_id and whether others had it."""
    for batch in batches:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        for row, anchor, edges, first, _ in paths(batch.column("text")):
            path, doc = path_ids(anchor, edges, first), ids[row]
            order = np.lexsort((doc, path))
            head = np.flatnonzero(np.r_[True, path[order][1:] != path[order][:-1]])
            low, high = doc[order][head], np.maximum.reduceat(doc[order], head)
            take = order[head]
            yield pa.RecordBatch.from_arrays([pa.array(signed(anchor[take])), pa.array(low), pa.array(high > low), _lists(edges, first, take)], names=["anchor", "doc_id", "many", "edges"])


def _emit_places(batches):
    for batch in batches:
        for row, anchor, edges, first, start in paths(batch.column("text")):
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(signed(path_ids(anchor, edges, first))), batch.column("doc_id").take(take), batch.column("key").take(take), pa.array(start.astype(np.int32)), pa.array(np.diff(np.r_[first, len(edges)]).astype(np.int32))], names=["path", "doc_id", "key", "start", "n"])


class _Held:
    """Distinct paths of some anchors, each with the smallest doc_id that has it and whether another has it too."""

    def __init__(self, anchor, doc, many, edges, first):
        self.anchor, self.doc, self.many, self.edges, self.first = anchor, doc, many, edges, first
        self.path = path_ids(anchor, edges, first) if len(anchor) else np.zeros(0, np.uint64)

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> _Held:
        column = batch.column("edges").combine_chunks() if isinstance(batch.column("edges"), pa.ChunkedArray) else batch.column("edges")
        bounds = np.frombuffer(column.buffers()[1], np.int32, len(column) + column.offset + 1)[column.offset :] // 8
        edges = np.frombuffer(column.buffers()[2], np.uint64)[bounds[0] : bounds[-1]]
        return cls(batch.column("anchor").to_numpy().view(np.uint64), batch.column("doc_id").to_numpy(), batch.column("many").to_numpy(zero_copy_only=False), edges, (bounds[:-1] - bounds[0]).astype(np.int64))

    def pick(self, take: np.ndarray) -> _Held:
        bounds = np.r_[self.first, len(self.edges)]
        sizes = np.diff(bounds)[take]
        first = np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64) if len(take) else np.zeros(0, np.int64)
        at = np.repeat(bounds[:-1][take] - first, sizes) + np.arange(int(sizes.sum()))
        return _Held(self.anchor[take], self.doc[take], self.many[take], self.edges[at], first)

    def plus(self, other: _Held) -> _Held:
        both = _Held(*(np.concatenate([getattr(self, k), getattr(other, k)]) for k in ("anchor", "doc", "many", "edges")), np.concatenate([self.first, other.first + len(self.edges)]))
        return both.compact()

    def compact(self) -> _Held:
        order = np.lexsort((self.doc, self.path))
        head = np.flatnonzero(np.r_[True, self.path[order][1:] != self.path[order][:-1]])
        if len(head) == len(order):
            return self
        doc = self.doc[order]
        many = np.logical_or.reduceat(self.many[order], head) | (np.maximum.reduceat(doc, head) > doc[head])
        out = self.pick(order[head])
        out.many = many
        return out

    def answers(self) -> pa.RecordBatch:
        """For each path: its smallest doc_id, and a bit for each edge that a still smaller doc_id has."""
        n = np.diff(np.r_[self.first, len(self.edges)])
        doc = np.repeat(self.doc, n)
        key = mix(np.repeat(self.anchor, n) * np.uint64(5) ^ mix(self.edges + _STEP))
        order = np.argsort(key, kind="stable")
        head = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
        low = np.empty(len(key), np.int64)
        low[order] = np.repeat(np.minimum.reduceat(doc[order], head), np.diff(np.r_[head, len(order)]))
        bit = (low < doc).astype(np.uint64) << (np.arange(len(key)) - np.repeat(self.first, n)).astype(np.uint64)
        mask = np.bitwise_or.reduceat(bit, self.first)
        told = np.flatnonzero(self.many | (mask != 0))
        return pa.RecordBatch.from_arrays([pa.array(signed(self.path[told])), pa.array(self.doc[told]), pa.array(signed(mask[told]))], names=["path", "least", "mask"])


def _resolve(batches):
    """Sorted by anchor: whole anchors are resolved as they pass; the last one's distinct paths are carried over."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = _Held.of(batch).compact()
        held = now if held is None else held.plus(now)
        last = batch.column("anchor")[batch.num_rows - 1].as_py() % (1 << 64)
        done = held.anchor != np.uint64(last)
        if done.any():
            yield held.pick(np.flatnonzero(done)).answers()
            held = held.pick(np.flatnonzero(~done))
    if held is not None and len(held.anchor):
        yield held.answers()


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(key, starts: array<int>, masks: array<long>): first word of each run of windows, a bit for each repeated one."""
    base = docs.filter("doc_id is not null").select("doc_id", document_key().alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = base.select("doc_id", "text").mapInArrow(_emit_paths, "anchor long, doc_id long, many boolean, edges binary")
    answers = table(dealt.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_resolve, "path long, least long, mask long"))
    free_shuffles(docs.sparkSession)
    places = base.mapInArrow(_emit_places, "path long, doc_id long, key binary, start int, n int")
    whole = F.expr(f"shiftrightunsigned(-1L, {LONGEST} - n)")
    spans = places.join(answers, "path").withColumn("mask", F.when(F.col("doc_id") > F.col("least"), whole).otherwise(F.col("mask"))).filter("mask <> 0")
    return spans.groupBy("key").agg(F.collect_list(F.struct("start", "mask")).alias("s")).select("key", F.col("s.start").alias("starts"), F.col("s.mask").alias("masks"))


def removed_words(n: int, starts, masks, window: int = WINDOW) -> np.ndarray:
    """Which of n words a repeated window covers."""
    edge = np.zeros(n + 1, np.int64)
    bits = np.unpackbits(np.asarray(masks, np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, bit = np.nonzero(bits)
    at = np.asarray(starts, np.int64)[row] + bit
    np.add.at(edge, at, 1)
    np.add.at(edge, np.minimum(at + window, n), -1)
    return np.cumsum(edge[:-1]) > 0


def _cut(batches):
    for batch in batches:
        n, gone, digest, text = [], [], [], []
        for raw, starts, masks in zip(batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("starts").to_pylist(), batch.column("masks").to_pylist()):
            parts = (raw or b"").split()
            n.append(len(parts))
            if starts:
                cut = removed_words(len(parts), starts, masks)
                gone.append(int(cut.sum()))
                parts = [w for w, c in zip(parts, cut) if not c]
            else:
                gone.append(0)
            kept = b" ".join(parts)
            digest.append(hashlib.sha256(kept).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256 (kept words joined by a space).

    A word goes if a window of 13 words over it also starts in a document with a smaller doc_id. Null texts have no words.
    Rows that share a doc_id never remove from each other; a row without one keeps all its words and removes none.
    """
    gone = table(repeated_windows(docs))
    free_shuffles(docs.sparkSession)
    rows = docs.select("doc_id", document_key().alias("key"), "text").join(gone, "key", "left").select("doc_id", "text", "starts", "masks")
    return rows.mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"))
