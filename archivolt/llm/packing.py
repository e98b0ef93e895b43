"""Operator 3: hierarchical packing of token streams into windows of several context sizes.

A document's tokens fill whole windows of the largest size; what is left goes to the tier whose window
holds it. Tiers are packed from long to short; gaps of long windows are filled with the best-fitting
pieces of shorter tiers, and the last gap with a cut piece, so windows are exactly full. Each map task
packs what it reads, with a bounded pool: there is no shuffle, and a lost task packs the same again.
"""

from __future__ import annotations

import base64
import functools
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import small_batches, tidy

TIERS = (128, 256, 512, 1024)
#: Tokens that wait in a task's pool before it is packed, and windows' tokens of a step group.
POOL, STEP = 1 << 17, 8192
END, END_OF_TEXT = 0, "<|endoftext|>"


@functools.lru_cache(maxsize=2)
def encoder(path: str | None = None):
    """The byte-level BPE vocabulary; its rank file gives the ids of byte_bpe_50k.json, four times as fast.

    Its special token counts where a text holds it, as it does in that file.
    """
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END_OF_TEXT: 50256})


def token_ids(text: str | None, path: str | None = None) -> np.ndarray:
    ids = encoder(path).encode(text, allowed_special={END_OF_TEXT}) if text else []
    ids.append(END)
    return np.array(ids, np.uint32)


class Packer:
    """Packs pieces (row number, start, ids); windows() returns [(size, [piece, ...])] that are full, or all at the end."""

    def __init__(self, tiers: tuple[int, ...] = TIERS, pool: int = POOL):
        self.tiers, self.pool = sorted(tiers), pool
        self.waiting: dict[int, list[tuple[int, int, int, np.ndarray]]] = {t: [] for t in self.tiers}
        self.held, self.serial, self.full = 0, 0, []

    def add(self, row, ids: np.ndarray) -> None:
        top = self.tiers[-1]
        whole = len(ids) // top * top
        self.full += [(top, [(row, s, ids[s : s + top])]) for s in range(0, whole, top)]
        if whole < len(ids):
            self._wait(row, whole, ids[whole:])

    def _wait(self, row, start: int, ids: np.ndarray) -> None:
        tier = next(t for t in self.tiers if len(ids) <= t)
        self.serial += 1
        pool = self.waiting[tier]
        item = (len(ids), self.serial, row, start, ids)
        pool.insert(bisect_right(pool, item[:2], key=lambda x: x[:2]), item)
        self.held += len(ids)

    def _take(self, tiers: list[int], gap: int):
        """The longest waiting piece of these tiers that fits; else the shortest one, to be cut; None if none waits."""
        for t in reversed(tiers):
            k = bisect_right(self.waiting[t], (gap, float("inf")), key=lambda x: x[:2])
            if k:
                return self.waiting[t].pop(k - 1)
        for t in tiers:
            if self.waiting[t]:
                return self.waiting[t].pop(0)
        return None

    def _fill(self, size: int, tiers: list[int]):
        gap, pieces = size, []
        while gap and (piece := self._take(tiers, gap)):
            n, _, row, start, ids = piece
            self.held -= n
            used = min(n, gap)
            pieces.append((row, start, ids[:used]))
            gap -= used
            if used < n:
                self._wait(row, start + used, ids[used:])
        return size, pieces

    def windows(self, last: bool = False):
        out, self.full = self.full, []
        if last or self.held >= self.pool:
            for k in range(len(self.tiers) - 1, -1, -1):
                tier, usable = self.tiers[k], self.tiers[: k + 1]
                while self.waiting[tier] and sum(x[0] for t in usable for x in self.waiting[t][: 2 * tier]) >= tier:
                    out.append(self._fill(tier, usable))
            while last and self.held:
                out.append(self._fill(self.tiers[-1], self.tiers))
        return out


def step_groups(sizes: list[int], tokens: int = STEP) -> list[int]:
    """Deals windows, largest first, each to the group with fewest tokens; there are as many groups as `tokens` asks for."""
    import heapq

    heap = [(0, g) for g in range(max(1, -(-sum(sizes) // tokens)))]
    out = [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        load, g = heapq.heappop(heap)
        out[k] = g
        heapq.heappush(heap, (load + sizes[k], g))
    return out


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window_size int, step_group long"


def _packing(tiers, pool, path):
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def pack(batches):
        home = TaskContext.get().partitionId() << 40
        packer, sequence, group = Packer(tiers, pool), home, home

        def rows(windows):
            nonlocal sequence, group
            groups, out = step_groups([w for w, _ in windows]), []
            for (size, pieces), g in zip(windows, groups):
                offset = 0
                for (doc, total), start, ids in pieces:
                    out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, offset, size, group + g))
                    offset += len(ids)
                sequence += 1
            group += max(groups, default=-1) + 1
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

        ready = []
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = token_ids(text.as_py(), path)
                packer.add((doc, len(ids)), ids)
                if packer.held >= pool or len(packer.full) >= 128:
                    ready = packer.windows()
                    if ready:
                        yield rows(ready)
        if ready := packer.windows(last=True):
            yield rows(ready)

    return pack


def pack(docs: DataFrame, tiers: tuple[int, ...] = TIERS, pool: int = POOL, vocabulary: str | None = None) -> DataFrame:
    """One row per piece. A null text is empty; every document ends with id 0, so it has one id at least.

    Windows are exactly full, but for the last of each map task. Rows that repeat a doc_id are packed as
    documents of their own. An empty table gives no rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(tidy(_packing(tuple(sorted(tiers)), pool, vocabulary)), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)
