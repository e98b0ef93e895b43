"""Operator 13: words that are one edit apart, grouped under the far more frequent one.

One edit leaves a half of a word as it is. So words are laid out in blocks of one shared first half and of one shared last
half, as in a dictionary sorted forward and one sorted backward; a block that is too large is divided again by the halves
of what is left between its shared ends. Tasks scan sorted blocks and verify neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Fixed values of the contract: letters of a run, length and number of a word, which runs lose a letter, how much more frequent a form is.
RUN, LENGTH, LEAST, EVERY, TIMES = r"[a-zÀ-ÿ]+", 6, 5, 199, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A block of more words than this is divided.
BLOCK = 192
#: Bytes of the letter matrix that a task compares at once, beyond one block.
CELLS = 1 << 21


def dictionary(docs: DataFrame) -> DataFrame:
    """(word, n): the words of all texts. A null text has none; a null doc_id counts as ''."""
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.filter(F.length("run") >= LENGTH)
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = F.pmod(h, F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(F.pmod(h, F.lit(EVERY)) == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= LENGTH)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST)


def _divided(rows: DataFrame) -> DataFrame:
    """Each row twice: its block's first half of what is left shared as well (p), and its last half (s)."""
    half = F.floor(F.col("r") / 2).cast("int")
    ways = F.array(F.struct(F.lit("p").alias("way"), half.alias("more_a"), F.lit(0).alias("more_b")), F.struct(F.lit("s").alias("way"), F.lit(0).alias("more_a"), half.alias("more_b")))
    rows = rows.select("word", "n", "m", "path", "a", "b", "r", F.inline(ways))
    rows = rows.select("word", "n", "m", F.concat("path", "way").alias("path"), (F.col("a") + F.col("more_a")).alias("a"), (F.col("b") + F.col("more_b")).alias("b"), (F.col("r") - F.col("more_a") - F.col("more_b")).alias("r"))
    shared = F.concat(F.substring("word", F.lit(1), F.col("a")), F.lit("|"), F.right("word", F.col("b")))
    return rows.withColumn("key", F.when(F.col("b") == 0, F.concat(F.substring("word", F.lit(1), F.col("a")), F.lit("|"))).otherwise(shared))


def blocks(words: DataFrame, most: int = BLOCK) -> DataFrame:
    """(word, n, m, path, a, b, r, key): the blocks in which pairs are verified.

    m: length of the shorter of two words, so a word is in the classes of its own length and of one less. path: which half
    is shared at each division. A block has `most` words at most, or its words differ in one place only (r = 1), of which
    there are no more than the alphabet and its square. Each round divides only blocks that are too large and halves
    r, so rounds are the logarithm of the longest word.
    """
    length = F.length("word")
    rows = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("m")).filter(F.col("m") >= LENGTH)
    rows = table(_divided(rows.select("word", "n", "m", F.lit("").alias("path"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.col("m").alias("r"))))
    done, block = [], ["m", "path", "key"]
    while True:
        large = table(rows.filter("r > 1").groupBy(*block).agg(F.count("*").alias("words")).filter(F.col("words") > most).drop("words"))
        if large.isEmpty():
            return reduce(DataFrame.unionByName, [*done, rows])
        done.append(rows.join(large, block, "left_anti"))
        rows = table(_divided(rows.join(large, block, "left_semi")))


def _found(m: int, block: np.ndarray, words: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the two words of each near pair among rows of class m; a pair counts only in the one block its own path leads to."""
    letters = np.array([w.encode("latin-1") for w in words], f"S{m + 1}").view(np.uint8).reshape(len(words), m + 1)
    longer = letters[:, m] != 0
    back = np.zeros_like(letters)  # the same letters, right aligned and read from the end
    back[longer], back[~longer, :m] = letters[longer, ::-1], letters[~longer, m - 1 :: -1] if m else letters[~longer, :0]
    depth = np.array([len(p) for p in paths])
    ways = np.array([p.encode() for p in paths], f"S{max(1, depth.max())}").view(np.uint8).reshape(len(paths), -1) == ord("p")
    out = []
    for k in range(1, len(words)):
        i = np.flatnonzero(block[:-k] == block[k:])
        if not len(i):
            break
        i = i[~(longer[i] & longer[i + k])]
        before, after = (letters[i] != letters[i + k]).argmax(1), (back[i] != back[i + k]).argmax(1)
        near = before + after >= m - 1 + (longer[i] | longer[i + k])
        i, before = i[near], before[near]
        a, r, own = np.zeros(len(i), int), np.full(len(i), m), np.ones(len(i), bool)
        for step in range(ways.shape[1]):
            half, on = r // 2, step < depth[i]
            first = before >= a + half
            own &= ~on | (first == ways[i, step])
            a, r = a + half * (first & on), r - half * on
        i = i[own]
        out += [(i, i + k)]
    pairs = [np.concatenate(x) if x else np.zeros(0, int) for x in zip(*out)] or [np.zeros(0, int)] * 2
    return pairs[0], pairs[1]


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block; a block that a batch leaves open waits for the next one."""

    def links(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        words, paths, n, ms = rows["word"].to_pylist(), rows["path"].to_pylist(), rows["n"].to_numpy(), rows["m"].to_numpy()
        block = _numbers(rows)
        starts = np.flatnonzero(np.diff(block, prepend=-1))
        ends = np.append(starts[1:], len(block))
        i = 0
        while i < len(starts):
            j, m = i, ms[starts[i]]
            while j + 1 < len(starts) and ms[starts[j + 1]] == m and (ends[j + 1] - starts[i]) * (m + 1) <= CELLS:
                j += 1
            s, e = starts[i], ends[j]
            x, y = _found(int(m), block[s:e], words[s:e], paths[s:e])
            left, right = np.concatenate([x, y]) + s, np.concatenate([y, x]) + s
            if len(left):
                yield pa.RecordBatch.from_arrays([pa.array([words[k] for k in left]), pa.array([words[k] for k in right]), pa.array(n[right])], names=["word", "near", "near_n"])
            i = j + 1

    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        block = _numbers(rows)
        last = int(np.searchsorted(block, block[-1])) if len(block) else 0
        held = rows.slice(last).combine_chunks()
        yield from links(rows.slice(0, last))
    if held is not None:
        yield from links(held)


def _numbers(rows: pa.Table) -> np.ndarray:
    """The blocks of sorted rows, numbered."""
    if not rows.num_rows:
        return np.zeros(0, int)
    new = np.zeros(rows.num_rows, bool)
    for c in ("m", "path", "key"):
        x = rows[c].combine_chunks()
        new[1:] |= pc.not_equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False)
    return np.cumsum(new)


def links(words: DataFrame) -> DataFrame:
    """(word, near, near_n): every ordered pair of words one edit apart, once."""
    rows = blocks(words).select("word", "n", "m", "path", "key").repartition("m", "path", "key").sortWithinPartitions("m", "path", "key", "word")
    return rows.mapInArrow(_scanned, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of rows (word, form): the end of the chain of forms. Each round doubles the steps; a form is TIMES as frequent, so chains are short."""
    at = table(forms.select("word", F.col("form").alias("root")))
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        step = table(at.join(on, "root", "left").select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("__moved")))
        if step.filter("__moved").isEmpty():
            return step.select("word", "root")
        at = step.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the corpus; form and form_n are null where no near word is TIMES as frequent.

    Rows that repeat a doc_id are texts of their own; no text or only short runs give no words.
    """
    words = table(dictionary(docs.select("doc_id", "text")))
    best = links(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best"))
    far = -F.col("best.n") >= TIMES * F.col("n")
    rows = table(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(far, F.col("best.near")).alias("form"), F.when(far, -F.col("best.n")).alias("form_n")))
    ends = roots(rows.filter("form IS NOT NULL"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
d AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
r AS (SELECT id, run, count(*) AS k FROM d WHERE length(run) >= 6 GROUP BY ALL),
b AS (SELECT run, k, flatten(list_transform(string_split(id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END)) AS bytes FROM r),
h AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, crc[xor(c & 255, x) + 1])), 4294967295) AS h FROM b, t),
w AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (SELECT k, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h) WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
x AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS s FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT a.word, b.word AS near, b.n AS near_n FROM x a JOIN x b ON a.i = b.i AND a.s = b.s AND a.word <> b.word
  UNION SELECT x.word, w.word, w.n FROM x JOIN w ON x.s = w.word UNION SELECT w.word, x.word, x.n FROM x JOIN w ON x.s = w.word),
m AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near FROM p QUALIFY row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) = 1),
f AS (SELECT w.word, w.n, coalesce(m.n_near, 0) AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form, CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n FROM w LEFT JOIN m ON m.word = w.word),
c AS (SELECT word, word AS at, form AS next FROM f UNION ALL SELECT c.word, c.next, f.form FROM c JOIN f ON f.word = c.next)
SELECT f.word, f.form, c.at AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n FROM f JOIN c ON c.word = f.word AND c.next IS NULL
"""
