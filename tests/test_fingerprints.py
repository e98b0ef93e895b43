"""Fingerprints against plain loops."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from archivolt.functions.text import rounded_by_decimal
from archivolt.operators import fingerprints as f


def plain(x):
    n = len(x)
    t = [[(math.sqrt(1 / n) if u == 0 else math.sqrt(2 / n)) * math.cos((2 * c + 1) * u * math.pi / (2 * n)) for c in range(n)] for u in range(8)]
    half = [[sum(t[u][r] * x[r][c] for r in range(n)) for c in range(n)] for u in range(8)]
    low = [round(sum(half[u][c] * t[z][c] for c in range(n)), 6) for u in range(8) for z in range(8)]
    middle = statistics.median(low[1:])
    phash = "".join(str(int(v > middle)) for v in low)
    flat = [v for row in x for v in row]
    lo, hi = min(flat), max(flat)
    out = [int(v * (255 / (hi - lo)) + -lo * (255 / (hi - lo))) for v in flat] if hi > lo else flat
    limit = min(238, max(110, statistics.median(out) - 18))
    ink = [int(v < limit) for v in out]
    ratio = round(sum(ink) / len(ink), 6)
    cells = [sum(ink[r * n + c] for r in (2 * y, 2 * y + 1) for c in (2 * z, 2 * z + 1)) / 4 > max(0.015, ratio * 0.85) for y in range(16) for z in range(16)]
    return phash, "".join(str(int(c)) for c in cells), ratio


def test_against_loops(spark):
    rng = random.Random(4)
    rows = [("a", "".join(chr(rng.randrange(32, 900)) for _ in range(rng.choice((3, 600, 1500))))) for _ in range(6)] + [("e", ""), ("n", None), ("w", "z" * 1024)]
    frames = f.frames(spark.createDataFrame(rows, "k string, t string"), "k", "t").collect()
    assert all(len(r.pixels) == 1024 for r in frames) and sum(r.k == "n" for r in frames) == 1
    for r in frames:
        x = np.frombuffer(bytes(r.pixels), np.uint8).reshape(1, 32, 32).astype(float)
        m = f.measured(x)
        bits = lambda v: "".join(f"{int(b) & (2**64 - 1):064b}" for b in v)
        assert (bits(m["phash"][0]), bits(m["layout"][0]), m["ink"][0]) == plain(x[0].tolist())


def test_larger_images_and_compared(spark):
    rng = np.random.default_rng(1)
    one = rng.integers(0, 255, (64, 64), dtype=np.uint8)
    rows = [("d", 0, one.tobytes()), ("d", 1, one.tobytes()), ("d", 2, (255 - one).tobytes())]
    marks = f.fingerprints(spark.createDataFrame(rows, "doc string, page int, pixels binary"), side=64)
    got = {r.page: r for r in f.compared(marks, "doc", "page", 10).collect()}
    assert got[0].starts is False and got[0].phash_distance is None
    assert (got[1].phash_distance, got[1].layout_distance, got[1].profile_distance, got[1].starts) == (0, 0, 0.0, False)
    assert got[2].phash_distance > 50 and got[2].starts is True
    assert f.fingerprints(spark.createDataFrame([], "doc string, page int, pixels binary"), side=64).count() == 0


def test_halves_of_profile_distances(spark):
    # rows of a page of check_s: their mean is 0.027349999999999996 by the order of its sum, 0.02735 by its decimal
    rows = [[0.2031, 0.1562, 0.1562, 0.1406, 0.1875, 0.1719, 0.2031, 0.1562, 0.0938, 0.1719, 0.2031, 0.1719, 0.1875, 0.2188, 0.1875, 0.2031], [0.1875, 0.2031, 0.1719, 0.1719, 0.1719, 0.1562, 0.2031, 0.1562, 0.1875, 0.1719, 0.2188, 0.1875, 0.1406, 0.1406, 0.1875, 0.1562]]
    cols = [[0.125, 0.2031, 0.1719, 0.2188, 0.1406, 0.2188, 0.2188, 0.1094, 0.0469, 0.3281, 0.2031, 0.1562, 0.1406, 0.1406, 0.2344, 0.1562], [0.1875, 0.1406, 0.2188, 0.2031, 0.1406, 0.2188, 0.2344, 0.1875, 0.1562, 0.1719, 0.0781, 0.1875, 0.1562, 0.2188, 0.1875, 0.125]]
    marks = spark.createDataFrame([("d", k, 0, [0, 0, 0, 0], 0.175781, rows[k], cols[k]) for k in (0, 1)], "doc string, page int, phash long, layout array<long>, ink double, row_profile array<double>, col_profile array<double>")
    assert {r.page: r.profile_distance for r in f.compared(marks, "doc", "page", 10).collect()} == {0: None, 1: 0.0274}


def test_rounded_by_decimal(spark):
    duckdb = pytest.importorskip("duckdb")
    rng, values = random.Random(8), []
    for _ in range(3000):
        v = (rng.randrange(10_000) + 0.5) / 10_000
        for _ in range(rng.randrange(6)):
            v = math.nextafter(v, rng.choice((0, 2)))
        values.append(v)
    got = [r.x for r in spark.createDataFrame([(v,) for v in values], "x double").select(rounded_by_decimal(F.col("x")).alias("x")).collect()]
    assert got == [r[0] for r in duckdb.execute("SELECT CAST(round(CAST(unnest(?::DOUBLE[]) AS DECIMAL(38, 17)), 4) AS DOUBLE)", [values]).fetchall()]


def test_complexity(spark):
    df = spark.createDataFrame([(96.0, 2400, 3200), (0.0, 100, 10), (None, None, None)], "s double, w int, h int")
    assert [r.c for r in df.select(f.complexity(F.col("s"), F.col("w"), F.col("h")).alias("c")).collect()] == [1.0, 0.0001, 0.5]
