"""Exact quantiles of many columns by distributed selection.

A mergeable sketch brackets every wanted rank between two values; one pass counts what lies below and inside each
bracket; brackets that hold more than ``limit`` values are sketched again inside; the values of the others, a bounded
number, are counted and the wanted ones picked.  No task ever holds a column: the passes reduce their rows, batch by
batch, to one row per column or bracket.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ACCURACY = 2_000


@dataclass
class _Bracket:
    column: int
    rank: int  # 0-based, among all values of the column
    lo: float
    hi: float
    below: int
    inside: int


def _sizes(df: DataFrame) -> dict[int, tuple[int, float, float]]:
    """column -> (values, least, greatest)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = b.to_numpy(np.float64)
            has = ~np.isnan(x)
            yield pd.DataFrame({"k": np.arange(x.shape[1]), "n": has.sum(0), "lo": np.where(has, x, np.inf).min(0, initial=np.inf), "hi": np.where(has, x, -np.inf).max(0, initial=-np.inf)})

    rows = df.mapInPandas(run, "k int, n long, lo double, hi double").groupBy("k").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return {r["k"]: (r["n"], r["lo"], r["hi"]) for r in rows.collect()}  # a row per column


def _count(df: DataFrame, brackets: list[tuple[int, float, float]]) -> list[tuple[int, int]]:
    """(values below, values inside) of each (column, lo, hi)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        below, inside = np.zeros(len(brackets), np.int64), np.zeros(len(brackets), np.int64)
        for b in batches:
            x = b.to_numpy(np.float64)
            for k, (c, lo, hi) in enumerate(brackets):
                v = x[:, c]
                less = np.count_nonzero(v < lo)
                below[k] += less
                inside[k] += np.count_nonzero(v <= hi) - less
        yield pd.DataFrame({"k": np.arange(len(brackets)), "below": below, "inside": inside})

    rows = df.mapInPandas(run, "k int, below long, inside long").groupBy("k").agg(F.sum("below").alias("b"), F.sum("inside").alias("i")).collect()
    got = {r["k"]: (r["b"], r["i"]) for r in rows}  # a row per bracket
    return [got.get(k, (0, 0)) for k in range(len(brackets))]


def _values(df: DataFrame, brackets: list[_Bracket]) -> dict[int, list[tuple[float, int]]]:
    """bracket -> sorted (value, count) inside it."""
    spans = [(b.column, b.lo, b.hi) for b in brackets]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = b.to_numpy(np.float64)
            for k, (c, lo, hi) in enumerate(spans):
                v = x[:, c]
                value, n = np.unique(v[(v >= lo) & (v <= hi)], return_counts=True)
                if len(value):
                    yield pd.DataFrame({"k": np.full(len(value), k), "v": value, "n": n})

    rows = df.mapInPandas(run, "k int, v double, n long").groupBy("k", "v").agg(F.sum("n").alias("n"))
    out: dict[int, list[tuple[float, int]]] = {}
    for r in rows.collect():  # at most ``limit`` values a bracket
        out.setdefault(r["k"], []).append((r["v"], r["n"]))
    return {k: sorted(v) for k, v in out.items()}


def order_statistics(df: DataFrame, ranks: Callable[[str, int], list[int]], limit: int = 20_000) -> tuple[dict[str, int], dict[tuple[str, int], float]]:
    """(values per column, {(column, rank): value}).  ``ranks(column, n)`` lists the 0-based ranks wanted of a column
    with ``n`` values; nulls and NaN don't count.  The table is read four times: for sizes, sketch, counts and the values
    of the brackets; further sketches are only for columns with huge brackets."""
    cols = list(df.columns)
    df = df.selectExpr(*[f"cast(`{c}` AS double) AS c{i}" for i, c in enumerate(cols)])
    sizes = _sizes(df)
    size = {c: sizes.get(i, (0, 0.0, 0.0))[0] for i, c in enumerate(cols)}
    open_ = [_Bracket(i, r, sizes[i][1], sizes[i][2], 0, size[c]) for i, c in enumerate(cols) if size[c] for r in sorted(set(ranks(c, size[c])))]
    ready: list[_Bracket] = []
    while open_:
        by: dict[tuple, list[_Bracket]] = {}
        for b in open_:
            by.setdefault((b.column, b.lo, b.hi, b.below, b.inside), []).append(b)
        sketches = []
        for (i, lo, hi, below, inside), bs in by.items():
            at = [min(max((b.rank - below) / max(inside - 1, 1) + e, 0.0), 1.0) for b in bs for e in (-2.0 / _ACCURACY, 2.0 / _ACCURACY)]
            held = f"CASE WHEN NOT isnan(c{i}) AND c{i} BETWEEN double('{lo!r}') AND double('{hi!r}') THEN c{i} END"
            sketches.append(F.expr(f"percentile_approx({held}, array({', '.join(f'{p!r}D' for p in at)}), {_ACCURACY})").alias(f"s{len(sketches)}"))
        got = df.agg(*sketches).first()
        tried = [(b, g[2 * k], g[2 * k + 1]) for g, bs in zip(got, by.values(), strict=True) for k, b in enumerate(bs)]
        counts = _count(df, [(b.column, lo, hi) for b, lo, hi in tried])
        open_ = []
        for (b, lo, hi), (below, inside) in zip(tried, counts, strict=True):
            t = _Bracket(b.column, b.rank, lo, hi, below, inside)
            if not below <= b.rank < below + inside:
                t = b  # the sketch missed the rank: its bracket stays as it was
            if t.lo == t.hi or t.inside <= limit:
                ready.append(t)
            else:
                open_.append(t if t.inside < b.inside else _halved(df, b))
    found = {(b.column, b.rank): b.lo for b in ready if b.lo == b.hi}
    rest = [b for b in ready if b.lo != b.hi]
    inside = _values(df, rest) if rest else {}
    for k, b in enumerate(rest):
        left = b.rank - b.below
        for v, n in inside[k]:
            if left < n:
                found[(b.column, b.rank)] = v
                break
            left -= n
    return size, {(cols[i], r): v for (i, r), v in found.items()}


def _halved(df: DataFrame, b: _Bracket) -> _Bracket:
    """One half of a bracket that a sketch did not narrow."""
    lo, hi = max(b.lo, -1.7e308), min(b.hi, 1.7e308)
    mid = lo / 2 + hi / 2
    (_, n), = _count(df, [(b.column, b.lo, mid)])
    if b.rank < b.below + n:
        return _Bracket(b.column, b.rank, b.lo, mid, b.below, n)
    return _Bracket(b.column, b.rank, math.nextafter(mid, math.inf), b.hi, b.below + n, b.inside - n)


def quantiles(df: DataFrame, probs: list[float]) -> dict[str, list[float | None]]:
    """Per column the interpolated quantiles (None for a column without values), like ``percentile`` over the column."""
    spots = lambda n: [p * (n - 1) for p in probs]
    size, got = order_statistics(df, lambda c, n: [f(x) for x in spots(n) for f in (math.floor, math.ceil)])
    out: dict[str, list[float | None]] = {}
    for c, n in size.items():
        pairs = [(got[(c, math.floor(x))], got[(c, math.ceil(x))], x - math.floor(x)) for x in spots(n)] if n else []
        out[c] = [lo + (hi - lo) * part for lo, hi, part in pairs] if n else [None] * len(probs)
    return out
