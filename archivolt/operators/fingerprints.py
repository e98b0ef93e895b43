"""Fingerprints of page images given as grey pixels: a perceptual hash, a layout hash, ink and profiles, by batched matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivolt.functions.text import page_splits, profile_distance, rounded_by_decimal

# Sides of the image and of the low band of a perceptual hash, cells and bins of a layout, limits of ink, and what a complex page is.
SIDE, LOW, GRID, BINS = 32, 8, 16, 16
INK, BELOW_MEDIAN, LEAST_DENSITY, DENSITY_SHARE = (110.0, 238.0), 18.0, 0.015, 0.85
CONTRAST, AREA, WEIGHTS, PORTRAIT = 96.0, 2400 * 3200, (0.45, 0.4, 0.15), 1.2
WHITE = 255


def frames(docs: DataFrame, key: str, text: str, side: int = SIDE) -> DataFrame:
    """(key, frame, pixels): a text's UTF-8 as square images of side x side bytes, filled up with white; a null text is one white image."""
    raw, size = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"), side * side
    rows = docs.select(key, raw.alias("__b")).withColumn("__n", F.greatest(F.lit(1), F.ceil(F.octet_length("__b") / size)).cast("int"))
    rows = rows.withColumn("__p", F.rpad("__b", F.col("__n") * size, F.lit(bytes([WHITE]))))
    return rows.select(key, F.posexplode(F.transform(F.sequence(F.lit(0), F.col("__n") - 1), lambda i: F.substring("__p", i * size + 1, F.lit(size)))).alias("frame", "pixels"))


def transform_matrix(n: int) -> np.ndarray:
    """Rows of the orthonormal cosine transform."""
    r, c = np.arange(n)[:, None], np.arange(n)[None, :]
    return np.where(r == 0, np.sqrt(1 / n), np.sqrt(2 / n)) * np.cos((2 * c + 1) * r * (np.pi / (2 * n)))


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits, the first one the highest, as signed numbers of 64 bits."""
    return np.packbits(bits, axis=1).view(">u8").astype(np.uint64).view(np.int64)


def measured(x: np.ndarray) -> dict[str, np.ndarray]:
    """Of images (n, side, side): phash, layout (n, 4), ink, rows, cols (n, bins), deviation.

    Coefficients are compared after rounding to six digits, so that the order of sums doesn't decide.
    """
    n, side = len(x), x.shape[1]
    small = x.reshape(n, SIDE, side // SIDE, SIDE, side // SIDE).mean((2, 4))
    t = transform_matrix(SIDE)[:LOW]
    low = np.round(t @ small @ t.T, 6).reshape(n, LOW * LOW)
    phash = packed(low > np.median(low[:, 1:], axis=1, keepdims=True))
    flat = x.reshape(n, -1)
    least, most = flat.min(1, keepdims=True), flat.max(1, keepdims=True)
    scale = 255.0 / np.where(most > least, most - least, 255.0)
    stretched = np.where(most > least, np.trunc(flat * scale + -least * scale), flat)
    limit = np.clip(np.median(stretched, axis=1, keepdims=True) - BELOW_MEDIAN, *INK)
    ink = (stretched < limit).reshape(n, side, side)
    ratio = np.round(ink.sum((1, 2)) / (side * side), 6)
    bins = lambda counts: np.round((counts / side).reshape(n, BINS, -1).mean(2), 4)
    cell = side // GRID
    density = ink.reshape(n, GRID, cell, GRID, cell).sum((2, 4)).reshape(n, -1) / (cell * cell)
    layout = packed(density > np.maximum(LEAST_DENSITY, ratio * DENSITY_SHARE)[:, None])
    return {"phash": phash, "layout": layout, "ink": ratio, "rows": bins(ink.sum(2)), "cols": bins(ink.sum(1)), "deviation": flat.std(1)}


def fingerprints(pages: DataFrame, side: int = SIDE) -> DataFrame:
    """C-49: pages with pixels (side x side bytes, a multiple of SIDE and GRID), in whose place phash, layout, ink, row_profile, col_profile and deviation come."""
    keys = [c for c in pages.columns if c != "pixels"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.frombuffer(b"".join(batch.column("pixels").to_pylist()), np.uint8).reshape(-1, side, side).astype(np.float64)
                parts = [measured(x[i : i + 512]) for i in range(0, len(x), 512)]  # bounded, whatever the batch
                m = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
                lists = [pa.array(list(m[k])) for k in ("layout", "rows", "cols")]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), pa.array(m["phash"][:, 0]), lists[0], pa.array(m["ink"]), lists[1], lists[2], pa.array(m["deviation"])], names=[*keys, "phash", "layout", "ink", "row_profile", "col_profile", "deviation"])

    kinds = dict(pages.dtypes)
    return pages.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", phash long, layout array<long>, ink double, row_profile array<double>, col_profile array<double>, deviation double")


def complexity(deviation: Column, width: Column, height: Column) -> Column:
    """C-57: contrast, area and whether a page is upright, 0 to 1 with four digits; 0.5 for a page without pixels."""
    contrast, area = F.least(deviation / CONTRAST, F.lit(1.0)), F.least(width * height / float(AREA), F.lit(1.0))
    upright = F.when(height > width * PORTRAIT, WEIGHTS[2]).otherwise(0.0)
    known = deviation.isNotNull() & width.isNotNull() & height.isNotNull()
    return F.when(known, F.round(F.least(F.lit(1.0), contrast * WEIGHTS[0] + area * WEIGHTS[1] + upright), 4)).otherwise(0.5)


def layout_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def compared(marks: DataFrame, document: str, order: str, threshold: int) -> DataFrame:
    """C-48 on C-49: each page with how far it is from the one before in its document, and whether a new document starts; the first page starts none. Halves of profile distances are told by 17 places."""
    w = Window.partitionBy(document).orderBy(order)
    names = ("phash", "layout", "ink", "row_profile", "col_profile")
    rows = marks.select("*", *(F.lag(c).over(w).alias(f"__{c}") for c in names))
    pair = lambda c: (F.col(f"__{c}"), F.col(c))
    ph = F.bit_count(F.col("__phash").bitwiseXOR(F.col("phash"))).cast("int")
    rows = rows.select(document, order, ph.alias("phash_distance"), layout_distance(*pair("layout")).alias("layout_distance"), profile_distance(pair("row_profile"), pair("col_profile"), pair("ink"), rounded_by_decimal).alias("profile_distance"))
    split = page_splits(F.col("phash_distance"), F.col("layout_distance"), F.col("profile_distance"), F.lit(None).cast("double"), threshold)
    return rows.withColumn("starts", F.coalesce(split, F.lit(False)))
