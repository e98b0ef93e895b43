"""Operator 2: SentencePiece encoding and decoding by a weighted finite-state transducer.

The model's normaliser (identity; blanks as its flags say, escaped), its pieces and the byte fallback are compiled into
one transducer: a state for each last piece, an arc for each piece that may follow it and, where no piece is just the
next character, a path of byte pieces. Composing it with an input gives a lattice; its path of least weight in the
tropical semiring is the encoding.

Weights are those of the model's own kind. Unigram: an arc costs minus its score. Merge models (BPE): a piece may follow
another (weight 0) if merging the characters of both gives the two again, else the weight is infinite. A sequence of
pieces is the model's encoding if and only if each two neighbours pass that test, so every prefix of an input has one
path of finite weight, and the lattice keeps one state a position.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a character outside the pieces costs below the lowest score (unigram).
PENALTY = 10.0
#: Segments that a worker remembers with their ids (the last so many, and as many before), and the longest of them in bytes.
REMEMBERED, LONGEST = 1 << 17, 64
#: Pairs of pieces of which a worker remembers whether one follows the other.
PAIRS = 1 << 21
UNIGRAM, BPE = 1, 2


def _fields(raw: bytes):
    """(field, value) of a protocol buffer message."""
    i = 0

    def number() -> int:
        nonlocal i
        out = shift = 0
        while True:
            c = raw[i]
            i += 1
            out |= (c & 127) << shift
            shift += 7
            if c < 128:
                return out

    while i < len(raw):
        key = number()
        kind = key & 7
        if kind == 0:
            value = number()
        else:
            n = {1: 8, 5: 4}.get(kind) or number()
            value, i = raw[i : i + n], i + n
        yield key >> 3, value


def _char(lead: int) -> int:
    return 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


class Transducer:
    """Arcs keyed by the bytes of their pieces (a space for the escape sign), the bytes' own pieces, and the normaliser's flags."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            model = list(_fields(f.read()))
        self.pieces: list[bytes] = []
        self.scores: list[float] = []
        self.arcs: dict[bytes, int] = {}
        self.bytes: dict[int, int] = {}
        self.kind, self.prefix, self.squeeze = UNIGRAM, True, True
        for field, value in model:
            if field == 1:
                self._piece(dict(_fields(value)))
            elif field == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                spec = dict(_fields(value))
                self.prefix, self.squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
                if spec.get(2) or not spec.get(5, 1):
                    raise ValueError("a normaliser with a character map, or one that does not escape blanks, is not compiled")
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and merge models are compiled")
        self.starts = {p[:n] for p in self.arcs for n in range(1, len(p) + 1)}
        self.unknown = PENALTY - min((self.scores[k] for k in self.arcs.values()), default=0.0)
        #: Lattices split where no arc can cross: before a run of blanks, unless a piece holds a blank after another character.
        self.segment = None if any(b" " in p.lstrip(b" ") for p in self.arcs) else re.compile(rb" +[^ ]*|[^ ]+")
        self.known: dict[int, bool] = {}
        self.seen: dict[bytes, tuple[int, ...]] = {}
        self.before = self.seen

    def _piece(self, piece: dict) -> None:
        k, kind, raw = len(self.pieces), piece.get(3, 1), piece[1].decode().replace("▁", " ").encode()
        self.scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
        if kind == 1:
            self.arcs[raw] = k
        elif kind == 6:
            self.bytes[int(piece[1][3:5], 16)] = k
            raw = bytes([int(piece[1][3:5], 16)])
        else:
            raw = b""
        self.pieces.append(raw)

    def _merged(self, raw: bytes) -> list[bytes]:
        """What merging the characters leaves: of all neighbours that make a piece, the best piece first, then the first place."""
        parts, i = [], 0
        while i < len(raw):
            parts.append(raw[i : i + _char(raw[i])])
            i += len(parts[-1])
        while True:
            best, at = -np.inf, -1
            for j in range(len(parts) - 1):
                k = self.arcs.get(parts[j] + parts[j + 1])
                if k is not None and self.scores[k] > best:
                    best, at = self.scores[k], j
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def follows(self, left: int, right: int) -> bool:
        """Whether the arc of `right` may come after that of `left`, or (left: -1) at the start or after bytes."""
        key = left << 32 | right
        ok = self.known.get(key)
        if ok is None:
            own = [self.pieces[right]] if left < 0 else [self.pieces[left], self.pieces[right]]
            if len(self.known) >= PAIRS:
                self.known.clear()
            ok = self.known[key] = self._merged(b"".join(own)) == own
        return ok

    def _arcs_at(self, raw: bytes, i: int) -> list[int]:
        """The pieces that begin at place i, the shortest first."""
        out, size, n = [], 1, len(raw)
        while i + size <= n and (piece := raw[i : i + size]) in self.starts:
            k = self.arcs.get(piece)
            if k is not None:
                out.append(k)
            size += 1
        return out

    def best(self, raw: bytes) -> tuple[int, ...]:
        """The ids of the least path over one input."""
        return self._finite(raw) if self.kind == BPE else self._least(raw)

    def _finite(self, raw: bytes) -> tuple[int, ...]:
        """Merge models: the one path of finite weight, by search from the longest arcs on; places that lead nowhere are left out once found."""
        n, path, i, dead = len(raw), [], 0, set()
        ways = self._arcs_at(raw, 0)
        while i < n:
            u = path[-1][1] if path else -1
            while ways:
                k = ways.pop()
                if i + len(self.pieces[k]) not in dead and self.follows(u, k):
                    path.append((i, k, ways))
                    i += len(self.pieces[k])
                    break
            else:
                size = min(_char(raw[i]), n - i)
                if i + size not in dead and raw[i : i + size] not in self.arcs:
                    path.append((i, -1, []))
                    i += size
                else:
                    dead.add(i)
                    i, _, ways = path.pop()
                    continue
            ways = self._arcs_at(raw, i)
        ids: list[int] = []
        for j, (i, k, _) in enumerate(path):
            ids += [k] if k >= 0 else [self.bytes[b] for b in raw[i : path[j + 1][0] if j + 1 < len(path) else n]]
        return tuple(ids)

    def _least(self, raw: bytes) -> tuple[int, ...]:
        """Unigram models: the lattice is relaxed from left to right."""
        n = len(raw)
        cost, back, last = [0.0] + [np.inf] * n, [0] * (n + 1), [-1] * (n + 1)
        for i in range(n):
            if cost[i] == np.inf:
                continue
            size = min(_char(raw[i]), n - i)
            ways = [(cost[i] - self.scores[k], len(self.pieces[k]), k) for k in self._arcs_at(raw, i)]
            for new, size, k in ways if raw[i : i + size] in self.arcs else [*ways, (cost[i] + self.unknown, size, -1)]:
                if new < cost[i + size]:
                    cost[i + size], back[i + size], last[i + size] = new, size, k
        ids, i = [], n
        while i:
            size = back[i]
            ids += [last[i]] if last[i] >= 0 else [self.bytes[b] for b in reversed(raw[i - size : i])]
            i -= size
        return tuple(reversed(ids))

    def encode(self, text: str | None) -> list[int]:
        """The ids of a whole text; none of a null or empty one."""
        raw, out = self.normal(text), []
        for s in self.segment.findall(raw) if self.segment else [raw] * bool(raw):
            ids = self.seen.get(s)
            if ids is None:
                ids = self.before.get(s) or self.best(s)
                if len(s) <= LONGEST:
                    if len(self.seen) >= REMEMBERED:
                        self.before, self.seen = self.seen, {}
                    self.seen[s] = ids
            out += ids
        return out

    def normal(self, text: str | None) -> bytes:
        """What the lattice is made of: blanks as the flags say, the escape sign as a blank."""
        text = (text or "").replace("▁", " ")
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        return (" " * (self.prefix and text != "") + text).encode("utf-8", "surrogatepass")

    def decode(self, ids) -> str:
        """The text of ids; bytes that are not UTF-8 become replacement characters."""
        raw = b"".join(self.pieces[k] for k in ids or ())
        return (raw[1:] if self.prefix and raw[:1] == b" " else raw).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def transducer(path: str | None = None) -> Transducer:
    import public_tokenizers

    return Transducer(path or public_tokenizers.path("piece_bpe_32k.model"))


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids: array<int>) for each row; a null or empty text has no ids. Texts are never cut.

    Rows that repeat a doc_id, or have none, are rows of their own; other columns are not read.
    """

    def run(batches):
        t = transducer(vocabulary)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                ids = [t.encode(x) for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give an empty text."""

    def run(batches):
        t = transducer(vocabulary)
        for batch in batches:
            texts = [t.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(encoded.dtypes)['doc_id']}, text string")


def digest(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Per row: doc_id, n_ids, ids_crc32 (unsigned, little-endian 32-bit ids), decoded_sha256, round_trip (decoding gives the normalised text)."""
    names = ["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "round_trip"]

    def run(batches):
        t = transducer(vocabulary)
        for batch in batches:
            n, crc, sha, same = [], [], [], []
            for text in batch.column("text"):
                text = text.as_py()
                ids, back = t.encode(text), t.normal(text)[t.prefix :]
                decoded = t.decode(ids).encode()
                n.append(len(ids)), crc.append(zlib.crc32(np.array(ids, "<u4").tobytes()))
                sha.append(hashlib.sha256(decoded).hexdigest()), same.append(decoded == back)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(sha), pa.array(same)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
