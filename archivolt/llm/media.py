"""Operator 6: media columns over a store of content-defined chunks.

A payload is kept as the samples of an 8-bit grey image (binary PGM, 576 columns). The bytes of that image, header
included, are cut where a rolling gear hash says so; Spark joins on chunk digests decide which text stores a chunk, so each
distinct chunk is stored once. An image is read back by its ordered chunk list: each chunk is checked against its own
digest, the whole against the one taken before. Only chunks that other texts store move between tasks.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_shuffles, table

UNIT = 576
#: Bounds and mean of a chunk's bytes; the hash covers 32 bytes.
LEAST, MEAN_BITS, MOST = 512, 11, 16384
GEAR = np.random.default_rng(77).integers(0, 2**32, 256, dtype=np.uint32)


def payload_of(raw: bytes) -> bytes:
    """The bytes, filled with 255 up to a positive multiple of UNIT."""
    return raw + b"\xff" * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def header_of(n: int) -> bytes:
    return b"P5\n%d %d\n255\n" % (UNIT, n // UNIT)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte; by doubling the span that each value covers, up to all 32 bits."""
    h = GEAR[data]
    for step in (1, 2, 4, 8, 16):
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    return h


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks."""
    n = len(data)
    hits = np.flatnonzero(gear_hashes(np.frombuffer(data, np.uint8)) >> np.uint32(32 - MEAN_BITS) == 0) + 1
    out, at = [], 0
    while at < n:
        k = np.searchsorted(hits, at + LEAST)
        end = int(hits[k]) if k < len(hits) else n
        at = min(end, at + MOST, n)
        out.append(at)
    return out


def chunks(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def chunk_id(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def features(payload: bytes) -> str:
    """count:sum:sum of squares:sum of steps:eight-bin histogram of the samples."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    bins = np.bincount(x >> 5, minlength=8)
    return f"{len(x)}:{x.sum()}:{(x * x).sum()}:{np.abs(np.diff(x)).sum()}:" + ",".join(map(str, bins))


def media_of(raw: bytes) -> bytes:
    """The stored form: a binary PGM of the payload."""
    payload = payload_of(raw)
    return header_of(len(payload)) + payload


def payload_in(media: bytes) -> bytes:
    """The samples of a stored form."""
    return media[media.index(b"\n255\n") + 5 :]


def _raw(batch, name: str = "text") -> list[bytes]:
    return batch.column(name).cast(pa.large_binary()).to_pylist()


def _recipes(batches):
    for batch in batches:
        n, ids, sha = [], [], []
        for raw in _raw(batch):
            media = media_of(raw)
            n.append(len(raw))
            ids.append([chunk_id(c) for c in chunks(media)])
            sha.append(hashlib.sha256(media).digest())
        columns = [batch.column("doc_id"), pa.array(sha, pa.binary()), pa.array(n, pa.int64()), pa.array(ids, pa.list_(pa.binary()))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "content", "n_bytes", "ids"])


def _squeezed(batches):
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        raw = _raw(batch)
        sha = [hashlib.sha256(media_of(t)).digest() for t in raw]
        yield pa.RecordBatch.from_arrays([pa.array(sha, pa.binary()), pa.array([pack.compress(t) for t in raw], pa.binary())], names=["content", "z"])


STORE = "content binary, ids array<binary>, own array<binary>, zs array<binary>, lent array<binary>"


def _stored(batches):
    pack, unpack = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
    for batch in batches:
        content, ids, own, zs, lent = [], [], [], [], []
        for sha, z, mine in zip(*(batch.column(c).to_pylist() for c in ("content", "z", "own"))):
            parts, mine = chunks(media_of(unpack.decompress(z))), {x["seq"]: x["lent"] for x in mine or ()}
            content.append(sha)
            ids.append([chunk_id(c) for c in parts])
            own.append([ids[-1][k] for k in sorted(mine)])
            zs.append([pack.compress(parts[k]) for k in sorted(mine)])
            lent.append([ids[-1][k] for k in sorted(mine) if mine[k]])
        lists = [pa.array(x, pa.list_(pa.binary())) for x in (ids, own, zs, lent)]
        yield pa.RecordBatch.from_arrays([pa.array(content, pa.binary()), *lists], names=["content", "ids", "own", "zs", "lent"])


READ = "content binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _read(batches):
    """Images by their ordered chunk lists: own chunks, and those that others store (away)."""
    unpack, kinds = zstandard.ZstdDecompressor(), [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        rows = []
        for sha, ids, own, zs, away in zip(*(batch.column(c).to_pylist() for c in ("content", "ids", "own", "zs", "away"))):
            found = {i: unpack.decompress(z) for i, z in [*zip(own, zs), *((x["id"], x["z"]) for x in away or ())]}
            for i, chunk in found.items():
                if chunk_id(chunk) != i:
                    raise ValueError("a stored chunk is not what its digest says")
            media = b"".join(found[i] for i in ids)
            if hashlib.sha256(media).digest() != sha:
                raise ValueError("the stored chunks do not give the image back")
            payload = payload_in(media)
            rows.append((sha, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), sha.hex(), features(payload)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, kinds)], names=[x.split()[0] for x in READ.split(", ")])


def _lent(batches):
    """The chunks that other texts use, with their digests."""
    for batch in batches:
        got = [(i, z) for own, zs, lent in zip(*(batch.column(c).to_pylist() for c in ("own", "zs", "lent"))) for wanted in [set(lent)] for i, z in zip(own, zs) if i in wanted]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in got], pa.binary()) for k in range(2)], names=["id", "z"])


def store(docs: DataFrame, passes: int = 2) -> tuple[DataFrame, DataFrame]:
    """(recipes, chunk store), both written tables of the shared folder.

    recipes: doc_id, content (SHA-256 of the stored form), n_bytes, ids (ordered chunk digests) per row.
    store, one row for each distinct text: content, ids, own and zs (the chunks it stores, each a frame of its own), lent
    (those of them that other texts use). passes: into how many parts, by content, the texts are dealt to the store one
    after the other; more of them keep less shuffled data on disk at a time, and read the texts more often.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    recipes = table(base.mapInArrow(_recipes, f"doc_id {dict(docs.dtypes)['doc_id']}, content binary, n_bytes long, ids array<binary>"))
    uses = recipes.select("content", F.posexplode("ids").alias("seq", "id"))
    owners = uses.groupBy("id").agg(F.min(F.struct("content", "seq")).alias("o"), (F.min("content") != F.max("content")).alias("lent"))
    own = table(owners.groupBy(F.col("o.content").alias("content")).agg(F.collect_list(F.struct("o.seq", "lent")).alias("own")))
    parts = []
    for k in range(passes):
        part = base.filter(F.pmod(F.xxhash64("text"), F.lit(passes)) == k).select("text")
        raw = part.mapInArrow(_squeezed, "content binary, z binary").dropDuplicates(["content"])
        parts.append(table(raw.join(own.hint("merge"), "content", "left").select("content", "z", "own").mapInArrow(_stored, STORE)))
        free_shuffles(docs.sparkSession)
    return recipes, reduce(DataFrame.unionByName, parts)


def read_back(stored: DataFrame, buckets: int = 32) -> DataFrame:
    """One row for each distinct payload, with the columns of READ, made of the stored bytes alone.

    A chunk that very many texts use is copied into `buckets` and its users are dealt to these, so that none is one task's.
    """
    missing = F.array_except("ids", "own")
    wants = stored.select("content", F.explode(missing).alias("id")).withColumn("bucket", F.pmod(F.xxhash64("content"), F.lit(buckets)))
    lent = stored.filter("size(lent) > 0").select("own", "zs", "lent").mapInArrow(_lent, "id binary, z binary")
    users = wants.groupBy("id", "bucket").agg(F.count("*").alias("n")).select("id", "bucket")
    copies = users.join(lent.hint("merge"), "id")
    away = wants.join(copies.hint("merge"), ["id", "bucket"]).groupBy("content").agg(F.collect_list(F.struct("id", "z")).alias("away"))
    whole = stored.filter(F.size(missing) == 0).select("content", "ids", "own", "zs", F.lit(None).cast("array<struct<id: binary, z: binary>>").alias("away"))
    parts = stored.filter(F.size(missing) > 0).select("content", "ids", "own", "zs").join(away.hint("merge"), "content")
    return whole.mapInArrow(_read, READ).unionByName(parts.mapInArrow(_read, READ))


def media(docs: DataFrame, passes: int = 2) -> DataFrame:
    """One row per row of docs, with the contract's columns. A null text is empty; equal texts have equal values.

    Rows that repeat a doc_id, or have none, are rows of their own; other columns are not read.
    """
    recipes, stored = store(docs, passes)
    back = table(read_back(stored))
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return recipes.select("doc_id", "n_bytes", "content").join(back, "content").select("doc_id", "n_bytes", *names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media(spark.read.parquet(f"{sf_dir}/documents.parquet"))
