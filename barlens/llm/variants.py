"""Spelling variants by Gram matrices of letter counts.

A word's letters are counted into a vector.  One inserted, deleted or replaced letter moves the vector by a squared
distance of at most two, and two words have the same length or lengths that differ by one.  Words therefore meet only in
blocks of equal length, against the same or the next length.  A block is split further by the counts of four letter
classes (code point modulo four): one edit changes a single count by one, or takes one from a class and gives it to
another, so a block meets its eleven neighbours and nothing else.  For each pair of blocks NumPy
multiplies the count matrices; squared distances follow from the Gram matrix, pairs at most two apart are kept
and the edit itself is verified on the letters.  Blocks above a size are cut into tiles that spread over tasks.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlens.llm.common import staged

#: maximal runs of these are words of the default pattern
LETTERS = r"A-Za-zÀ-ÿ"
_CLASSES = 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(docs: DataFrame, least: int = 7, at_least: int = 2, thin: int = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n``: the distinct words of all texts with ``least`` code points and ``at_least`` occurrences.

    A word is a maximal run of ``LETTERS`` with A-Z lower-cased; if ``thin`` divides the CRC-32 of ``<id>:<word>``, the code
    point at that number modulo the length is left out (0: never).  Null texts have no word; a null id counts as an empty one."""
    runs = docs.select(F.col(id_col).cast("long").cast("string").alias("i"), F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))).alias("run"))
    low = runs.select("i", F.translate("run", _UPPER, _LOWER).alias("w"))
    if thin:
        h = F.crc32(F.concat(F.coalesce("i", F.lit("")), F.lit(":"), "w").cast("binary"))
        cut = low.withColumn("h", h).withColumn("p", F.when(F.col("h") % thin == 0, F.col("h") % F.char_length("w")).cast("int"))
        low = cut.select(F.when(F.col("p").isNull(), F.col("w")).otherwise(F.expr("concat(left(w, p), substr(w, p + 2))")).alias("w"))
    return low.groupBy(F.col("w").alias("word")).agg(F.count("*").alias("n")).where((F.char_length("word") >= least) & (F.col("n") >= at_least))


def _letter_rows(text: list[str]) -> np.ndarray:
    """Code points of words of one length, a row for each word."""
    return np.frombuffer("".join(text).encode("utf-32-le"), np.uint32).reshape(len(text), -1)


def _counts(rows: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Letter counts as floats; single precision as long as squared lengths, and so Gram entries, are exact in it."""
    at = np.searchsorted(letters, rows) + np.arange(len(rows))[:, None] * len(letters)
    got = np.bincount(at.ravel(), minlength=len(rows) * len(letters)).reshape(len(rows), len(letters))
    return got.astype(np.float32 if rows.shape[1] < 4096 else np.float64)


def one_edit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether row k of ``y`` comes from row k of ``x`` by replacing one code point, or by inserting one if rows of ``y``
    are one longer."""
    n = x.shape[1]
    if y.shape[1] == n:
        return (x != y).sum(1) == 1
    front = np.cumprod(x == y[:, :n], axis=1, dtype=np.int8).sum(1, dtype=np.int64)
    back = np.cumprod((x == y[:, 1:])[:, ::-1], axis=1, dtype=np.int8).sum(1, dtype=np.int64)
    return front + back >= n


def near(xs: list[str], ys: list[str] | None) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs of ``xs`` and ``ys`` (None: of ``xs`` with itself, each pair once) one edit apart.  Words of
    a list have one length; those of ``ys`` have the same one or one more."""
    x = _letter_rows(xs)
    y = x if ys is None else _letter_rows(ys)
    letters = np.union1d(x, y)
    u = _counts(x, letters)
    v = u if ys is None else _counts(y, letters)
    gram = u @ v.T
    close = (u * u).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2 * gram <= 2
    i, j = np.nonzero(np.triu(close, 1) if ys is None else close)
    step = max(1, (1 << 22) // max(1, x.shape[1]))
    keep = [one_edit(x[i[k:k + step]], y[j[k:k + step]]) for k in range(0, len(i), step)]
    keep = np.concatenate(keep) if keep else np.empty(0, bool)
    return i[keep], j[keep]


def near_pairs(vocabulary: DataFrame, tile: int = 2048, tile_letters: int = 1 << 18) -> DataFrame:
    """``a, b, n_a, n_b``: every pair of words one inserted, deleted or replaced code point apart, once.
    ``vocabulary`` is (word, n) with distinct words; null and empty words take no part."""
    letters = F.split("word", "")
    of = lambda k: F.size(F.filter(letters, lambda c: F.ascii(c) % _CLASSES == k))
    rows = vocabulary.where("word <> ''").select("word", "n", F.array(*[of(k) for k in range(_CLASSES)]).alias("block"), F.char_length("word").alias("len"))
    rows = staged(rows, "variant-words")
    room = F.greatest(F.lit(1), F.least(F.lit(tile), F.floor(F.lit(tile_letters) / F.max("len")))).cast("long")
    sizes = staged(rows.groupBy("block").agg(F.ceil(F.count("*") / room).cast("int").alias("tiles")), "variant-blocks")
    tiles = (rows.join(sizes, "block").withColumn("tile", F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int"))
             .groupBy("block", "tile").agg(F.collect_list("word").alias("words"), F.collect_list("n").alias("ns")))
    tiles = staged(tiles, "variant-tiles")

    def moved(*steps: tuple[int, int]):
        change = dict(steps)
        return F.array(*[F.col("block")[k] + change.get(k, 0) for k in range(_CLASSES)])

    pairs_of = [moved(), *[moved((i, -1), (j, 1)) for i, j in itertools.combinations(range(_CLASSES), 2)], *[moved((j, 1)) for j in range(_CLASSES)]]
    to = sizes.select(F.col("block").alias("to"), F.col("tiles").alias("to_tiles"))
    asks = tiles.withColumn("to", F.explode(F.array(*pairs_of))).join(to, "to")
    same = F.col("to") == F.col("block")
    asks = asks.withColumn("to_tile", F.explode(F.sequence(F.when(same, F.col("tile")).otherwise(0), F.col("to_tiles") - 1)))
    asks = asks.select("to", "to_tile", "words", "ns", (same & (F.col("tile") == F.col("to_tile"))).alias("own"))
    other = tiles.select(F.col("block").alias("to"), F.col("tile").alias("to_tile"), F.col("words").alias("to_words"), F.col("ns").alias("to_ns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for xs, ns, own, ys, ms in zip(*(batch.column(k) for k in range(5)), strict=True):
                own = own.as_py()
                i, j = near(xs.as_py(), None if own else ys.as_py())
                if len(i):
                    to, to_n = (xs, ns) if own else (ys, ms)
                    yield pa.RecordBatch.from_arrays([xs.values.take(pa.array(i)), to.values.take(pa.array(j)), ns.values.take(pa.array(i)), to_n.values.take(pa.array(j))], ["a", "b", "n_a", "n_b"])

    met = asks.join(other, ["to", "to_tile"]).select("words", "ns", "own", "to_words", "to_ns")
    return met.mapInArrow(run, "a string, b string, n_a long, n_b long")


def _last(form: DataFrame) -> DataFrame:
    """``word, root`` of (word, form) rows: the end of each chain.  Every round doubles the links followed; counts rise
    along a chain, so it ends, and the rounds are the logarithm of its length."""
    jump = staged(form.select("word", F.col("form").alias("root")), "variant-root-0")
    for k in itertools.count(1):
        then = jump.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = staged(jump.join(then, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"variant-root-{k}")
        jump = after.select("word", "root")
        if after.where("moved").isEmpty():
            return jump


def group_variants(vocabulary: DataFrame, ratio: int = 10) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` per word of ``vocabulary`` (word, n).

    ``n_near`` counts the words one edit apart.  ``form`` is the one of largest ``n`` (ties: smallest in code-point
    order) if that is at least ``ratio`` times the word's own, else null; ``root`` follows forms to the last."""
    vocabulary = staged(vocabulary, "variant-vocabulary")
    pairs = staged(near_pairs(vocabulary), "variant-pairs")
    sides = [pairs.select(F.col(x).alias("word"), F.struct((-F.col(f"n_{y}")).alias("m"), F.col(y).alias("w")).alias("o")) for x, y in ("ab", "ba")]
    found = sides[0].unionByName(sides[1]).groupBy("word").agg(F.count("*").alias("n_near"), F.min("o").alias("o"))
    best = vocabulary.join(found, "word", "left")
    takes = -F.col("o.m") >= F.lit(ratio) * F.col("n")
    best = staged(best.select("word", F.when(takes, F.col("o.w")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, -F.col("o.m")).alias("form_n")), "variant-forms")
    roots = _last(best.where("form is not null"))
    return best.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
