"""The matching-blocks ratio of two texts: the longest common block, then the same on both sides of it, over code points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: In a second text of so many characters or more, characters that make up more than a hundredth (and one) of it begin no block.
LONG = 200


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Blocks:
    """Blocks of a first text in one second text, which is laid out once: where each of its characters is."""

    def __init__(self, second: str):
        self.b = _points(second)
        values, counts = np.unique(self.b, return_counts=True)
        common = counts > len(self.b) // 100 + 1 if len(self.b) >= LONG else np.zeros(len(values), bool)
        self.places = {int(v): self.b == v for v, c in zip(values, common) if not c}

    def longest(self, a: np.ndarray, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
        """(i, j, size) of the longest block within the ranges; of equal ones the first in a, then in b.

        A row of run lengths for each character of a: a run is one longer than the run that ends one place before in both.
        """
        best, at_a, at_b = 0, alo, blo
        run, none = np.zeros(bhi - blo, np.int32), np.zeros(bhi - blo, np.int32)
        for i in range(alo, ahi):
            here = self.places.get(int(a[i]))
            if here is None:
                run = none
                continue
            now = np.empty_like(run)
            now[:1], now[1:] = 1, run[:-1] + 1
            run = now * here[blo:bhi]
            j = int(run.argmax()) if len(run) else 0
            if len(run) and run[j] > best:
                best = int(run[j])
                at_a, at_b = i - best + 1, blo + j - best + 1
        while at_a > alo and at_b > blo and a[at_a - 1] == self.b[at_b - 1]:
            at_a, at_b, best = at_a - 1, at_b - 1, best + 1
        while at_a + best < ahi and at_b + best < bhi and a[at_a + best] == self.b[at_b + best]:
            best += 1
        return at_a, at_b, best

    def matched(self, first: str) -> int:
        """Characters in all blocks of `first`."""
        a, total = _points(first), 0
        todo = [(0, len(a), 0, len(self.b))]
        while todo:
            alo, ahi, blo, bhi = todo.pop()
            i, j, n = self.longest(a, alo, ahi, blo, bhi)
            if n:
                total += n
                if alo < i and blo < j:
                    todo.append((alo, i, blo, j))
                if i + n < ahi and j + n < bhi:
                    todo.append((i + n, ahi, j + n, bhi))
        return total


def ratio(a: str, b: str, blocks: Blocks | None = None) -> float:
    """Twice the matched characters over all; 1 for two empty texts."""
    n = len(a) + len(b)
    return 2.0 * (blocks or Blocks(b)).matched(a) / n if n else 1.0


def _ratios(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for left, right in batches:
        held: dict[str, Blocks] = {}
        known: dict[tuple[str, str], float] = {}  # pairs of one batch of rows, which often come again
        out = []
        for a, b in zip(left, right):
            if a and b:
                if (a, b) not in known:
                    if b not in held:
                        held = {b: Blocks(b)}
                    known[a, b] = ratio(a, b, held[b])
                out.append(known[a, b])
            else:
                out.append(0.0)
        yield pd.Series(out, dtype="float64")


def gestalt(a: Column, b: Column) -> Column:
    """C-13: the matching-blocks ratio; the order of the two matters. 0 for a null or empty text."""
    return F.pandas_udf(_ratios, DoubleType())(a, b)


def ratio_sql(pairs: str) -> str:
    """SQL with the same result: WITH parts that give `ratios` (p, ratio) of a table of (p, a, b), a and b not empty.

    Characters that agree make runs along diagonals. A window's block is its longest run of characters that may begin
    one, with what agrees around it, or what agrees at the window's start if it has no such run; windows left and right of it follow by recursion.
    """
    return f"""mb AS (SELECT p, a, b, length(a) AS n, length(b) AS m FROM {pairs}),
  ma AS (SELECT p, unnest(range(1, n + 1)) AS i, a FROM mb), mc AS (SELECT p, i, substr(a, i, 1) AS c FROM ma),
  md AS (SELECT p, m, j, substr(b, j, 1) AS c FROM (SELECT p, m, b, unnest(range(1, m + 1)) AS j FROM mb)),
  me AS (SELECT p, j, c, m >= {LONG} AND count(*) OVER (PARTITION BY p, c) > m // 100 + 1 AS common FROM md),
  mf AS (SELECT mc.p, i, j, common FROM mc JOIN me ON me.p = mc.p AND me.c = mc.c),
  mg AS (SELECT *, i - row_number() OVER (PARTITION BY p, i - j ORDER BY i) AS full_run, CASE WHEN NOT common THEN i - row_number() OVER (PARTITION BY p, i - j, common ORDER BY i) END AS own_run FROM mf),
  mh AS (SELECT p, i - j AS d, full_run, own_run, min(i) AS s, max(i) + 1 AS e FROM mg WHERE NOT common GROUP BY ALL),
  mi AS (SELECT p, i - j AS d, full_run, min(i) AS fs, max(i) + 1 AS fe FROM mg GROUP BY ALL),
  mr AS (SELECT mi.p, mi.d, coalesce(s, 0) AS s, coalesce(e, 0) AS e, fs, fe FROM mi LEFT JOIN mh ON mi.p = mh.p AND mi.d = mh.d AND mi.full_run = mh.full_run),
  mw AS (SELECT p, 1 AS alo, n + 1 AS ahi, 1 AS blo, m + 1 AS bhi, 0 AS size FROM mb UNION ALL
    SELECT p, CASE side WHEN 0 THEN alo ELSE x.e END, CASE side WHEN 0 THEN x.s ELSE ahi END, CASE side WHEN 0 THEN blo ELSE x.e - x.d END, CASE side WHEN 0 THEN x.s - x.d ELSE bhi END, CASE side WHEN 0 THEN x.e - x.s ELSE 0 END
    FROM (SELECT w.p, alo, ahi, blo, bhi, arg_max({{'s': greatest(fs, alo, blo + d), 'e': least(fe, ahi, bhi + d), 'd': d}}, (greatest(0, least(e, ahi, bhi + d) - greatest(s, alo, blo + d)), -greatest(s, alo, blo + d), d)) AS x
      FROM mw w JOIN mr r ON r.p = w.p AND (least(e, ahi, bhi + d) > greatest(s, alo, blo + d) OR (d = alo - blo AND fs <= alo AND fe > alo)) WHERE alo < ahi AND blo < bhi GROUP BY ALL), (SELECT unnest([0, 1]) AS side)),
  ratios AS (SELECT mw.p, 2.0::DOUBLE * sum(size) / any_value(n + m) AS ratio FROM mw JOIN mb ON mb.p = mw.p GROUP BY mw.p)"""
