"""Column builders for per-series (ticker, date) windows.

Conventions (pandas-compatible semantics, NULL instead of NaN/inf):

* ``W`` orders one series by date; every trailing window counts *rows*, never calendar days.
* ``roll(agg, x, k)`` is NULL unless the last k rows all hold a value (pandas ``min_periods=k``).
* ``div`` is ``try_divide`` (ANSI on: a zero divisor gives NULL, never an error or inf).
* ``corr_k`` is covariance / (sigma * sigma) over jointly non-null pairs, NULL on zero variance
  (Spark's built-in ``corr`` raises DIVIDE_BY_ZERO in that case under ANSI).
"""

from __future__ import annotations

import math
from typing import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

KEY = "ticker"
ORDER = "date"


def W(key: str | list[str] = KEY, order: str = ORDER) -> WindowSpec:
    keys = [key] if isinstance(key, str) else list(key)
    return Window.partitionBy(*keys).orderBy(order)


def R(k: int, key: str | list[str] = KEY, order: str = ORDER) -> WindowSpec:
    """Trailing frame of k rows ending at the current row."""
    return W(key, order).rowsBetween(-(k - 1), 0)


def CUM(key: str | list[str] = KEY, order: str = ORDER) -> WindowSpec:
    return W(key, order).rowsBetween(Window.unboundedPreceding, 0)


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def div(a, b) -> Column:
    return F.try_divide(col(a), col(b))


def lag(x, n: int = 1, key=KEY) -> Column:
    return F.lag(col(x), n).over(W(key))


def lead(x, n: int = 1, key=KEY) -> Column:
    return F.lead(col(x), n).over(W(key))


def pct(x, n: int = 1, key=KEY) -> Column:
    """pandas ``pct_change(n)``: x / x[t-n] - 1."""
    return div(col(x), lag(x, n, key)) - F.lit(1.0)


def full(x, k: int, key=KEY) -> Column:
    """True when the last k rows all hold a value for x."""
    return F.count(col(x)).over(R(k, key)) == F.lit(k)


def roll(agg: Callable[[Column], Column], x, k: int, key=KEY) -> Column:
    """pandas ``rolling(k).agg()`` with ``min_periods=k``."""
    return F.when(full(x, k, key), agg(col(x)).over(R(k, key)))


def sma(x, k: int, key=KEY) -> Column:
    return roll(F.avg, x, k, key)


def std(x, k: int, key=KEY) -> Column:
    return roll(F.stddev_samp, x, k, key)


def rsum(x, k: int, key=KEY) -> Column:
    return roll(F.sum, x, k, key)


def rmax(x, k: int, key=KEY) -> Column:
    return roll(F.max, x, k, key)


def rmin(x, k: int, key=KEY) -> Column:
    return roll(F.min, x, k, key)


def _joint(x, y):
    x, y = col(x), col(y)
    return F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)


def cov_k(x, y, k: int, key=KEY) -> Column:
    xj, yj = _joint(x, y)
    return F.when(F.count(xj).over(R(k, key)) == k, F.covar_samp(xj, yj).over(R(k, key)))


def corr_k(x, y, k: int, key=KEY) -> Column:
    xj, yj = _joint(x, y)
    w = R(k, key)
    return F.when(
        F.count(xj).over(w) == k,
        F.try_divide(F.covar_samp(xj, yj).over(w), F.stddev_samp(xj).over(w) * F.stddev_samp(yj).over(w)),
    )


def var_k(x, k: int, key=KEY) -> Column:
    return roll(F.var_samp, x, k, key)


def quantile_k(x, q: float, k: int, key=KEY) -> Column:
    """pandas ``rolling(k).quantile(q)`` (linear interpolation) == Spark exact ``percentile``."""
    return F.when(full(x, k, key), F.percentile(col(x), F.lit(q)).over(R(k, key)))


def rank_in_window(x, k: int, key=KEY) -> Column:
    """pandas ``rolling(k).rank()`` (average ties): rank of the current value inside its frame."""
    xs = F.collect_list(col(x)).over(R(k, key))
    v = col(x)
    below = F.size(F.filter(xs, lambda e: e < v))
    equal = F.size(F.filter(xs, lambda e: e == v))
    return F.when(full(x, k, key), below + (equal + F.lit(1)) / F.lit(2.0))


# --- recursive smoothing -----------------------------------------------------------------------
# y_t = a*x_t + (1-a)*y_{t-1} by blocks of rows, blocks of blocks and so on, as plain JVM window expressions.

def with_ewm(df, outs: dict[str, tuple[str, float]], key=KEY, order: str = ORDER, block: int = 32):
    """``df`` plus, per ``name: (column, alpha)``, the recursive EWM (pandas ``adjust=False``) over all earlier
    non-null values, seeded with the first; a null row carries the last value.

    Exact at any length: inside a block of rows the recursion is an affine map of the value that enters it.  Maps of
    ``block`` blocks are composed into the map of a larger block, twice, so that the value that enters a row follows
    from at most ``block`` maps on each of two levels and one map per ``block ** 3`` rows: work grows with the number
    of rows, not with its square.
    """
    keys = [key] if isinstance(key, str) else list(key)
    w, pos = W(key, order), F.col("_pos")
    t = df.withColumn("_pos", F.row_number().over(w) - 1)
    t = t.withColumns({**{f"_s_{o}": F.struct(F.col(x).cast("double").alias("v"), (F.count(x).over(CUM(key, order)) == 1).alias("first"))
                          for o, (x, _) in outs.items()},
                       "_g2": F.floor(pos / block ** 2), "_g3": F.floor(pos / block ** 3)})
    near, before = w.rowsBetween(-(block - 1), 0), (Window.unboundedPreceding, -1)
    one, none = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("c")), F.lit(None).cast("double")

    def block_map(rows: Column, alpha: float) -> Column:
        step = lambda m, e: (F.when(e["v"].isNull(), m)
                             .when(e["first"], F.struct(F.lit(0.0).alias("a"), e["v"].alias("c")))
                             .otherwise(F.struct((m["a"] * (1.0 - alpha)).alias("a"), (alpha * e["v"] + (1.0 - alpha) * m["c"]).alias("c"))))
        return F.aggregate(rows, one, step)

    def composed(maps: Column) -> Column:
        after = lambda m, n: (F.when(n["a"] == 0.0, n)
                              .otherwise(F.struct((n["a"] * m["a"]).alias("a"), (n["a"] * m["c"] + n["c"]).alias("c"))))
        return F.aggregate(maps, one, after)

    def fold(rows: Column, y: Column, alpha: float) -> Column:
        return F.aggregate(rows, y, lambda acc, e: F.when(e["v"].isNull(), acc).when(acc.isNull(), e["v"]).otherwise(alpha * e["v"] + (1.0 - alpha) * acc))

    ends = lambda size: pos % size == size - 1
    t = t.withColumns({f"_r_{o}": F.slice(F.collect_list(f"_s_{o}").over(near), -(pos % block + 1), pos % block + 1) for o in outs})
    t = t.withColumns({f"_m_{o}": F.when(ends(block), block_map(F.col(f"_r_{o}"), alpha)) for o, (_, alpha) in outs.items()})
    second, third = (Window.partitionBy(*keys, g).orderBy(order).rowsBetween(*before) for g in ("_g2", "_g3"))
    t = t.withColumns({f"_a_{o}": F.collect_list(f"_m_{o}").over(second) for o in outs})
    t = t.withColumns({f"_n_{o}": F.when(ends(block ** 2), composed(F.concat(f"_a_{o}", F.array(f"_m_{o}")))) for o in outs})
    t = t.withColumns({f"_b_{o}": F.collect_list(f"_n_{o}").over(third) for o in outs})
    t = t.withColumns({f"_p_{o}": F.when(ends(block ** 3), composed(F.concat(f"_b_{o}", F.array(f"_n_{o}")))) for o in outs})
    enter = lambda y, m: F.when(m["a"] == 0.0, m["c"]).otherwise(m["a"] * y + m["c"])
    maps = lambda o: F.concat(F.collect_list(f"_p_{o}").over(w.rowsBetween(*before)), F.col(f"_b_{o}"), F.col(f"_a_{o}"))
    t = t.withColumns({f"_y_{o}": F.aggregate(maps(o), none, enter) for o in outs})
    t = t.withColumns({o: fold(F.col(f"_r_{o}"), F.col(f"_y_{o}"), alpha) for o, (_, alpha) in outs.items()})
    return t.drop("_pos", "_g2", "_g3", *[f"_{p}_{o}" for o in outs for p in "srmanbpy"])


def with_extremes(df, outs: dict[str, tuple[str, str, int]], key=KEY, order: str = ORDER):
    """``df`` plus, per ``name: (function, column, k)`` with function ``max`` or ``min``, that extreme of the last k rows
    (NULL unless all of them hold a value).  Rows are cut into blocks of k: the last k rows are the tail of one block
    and the head of the next, whose running extremes cost one step a row however large k is."""
    keys = [key] if isinstance(key, str) else list(key)
    w = W(key, order)
    agg = {"max": (F.max, F.greatest), "min": (F.min, F.least)}
    t = df.withColumn("_pos", F.row_number().over(w) - 1)
    t = t.withColumns({f"_k{k}": F.floor(F.col("_pos") / k) for k in sorted({k for *_, k in outs.values()})})
    cols = sorted({x for _, x, _ in outs.values()})
    t = t.withColumns({f"_z_{x}": F.max(F.when(F.col(x).isNull(), F.col("_pos"))).over(CUM(key, order)) for x in cols})  # the last null row
    running = lambda f, x, k, by: agg[f][0](x).over(Window.partitionBy(*keys, f"_k{k}").orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
    t = t.withColumns({f"_h_{o}": running(f, x, k, F.col(order)) for o, (f, x, k) in outs.items()})
    t = t.withColumns({f"_t_{o}": running(f, x, k, F.col(order).desc()) for o, (f, x, k) in outs.items()})
    whole = lambda x, k: F.col("_pos") - F.coalesce(F.col(f"_z_{x}"), F.lit(-1)) >= k
    t = t.withColumns({o: F.when(whole(x, k), agg[f][1](F.col(f"_h_{o}"), F.lag(f"_t_{o}", k - 1).over(w)) if k > 1 else F.col(x)) for o, (f, x, k) in outs.items()})
    made = {"_pos", *[f"_k{k}" for *_, k in outs.values()], *[f"_z_{x}" for x in cols], *[f"_{p}_{o}" for o in outs for p in "ht"]}
    return t.drop(*made)


def seen(x, key=KEY) -> Column:
    """Number of non-null values of x so far in the series (pandas ewm ``min_periods``)."""
    return F.count(col(x)).over(CUM(key))


def with_ema(df, outs: dict[str, tuple[str, int]], key=KEY):
    """``df`` plus, per ``name: (column, span)``, ``ewm(span, adjust=False, min_periods=span).mean()``."""
    t = with_ewm(df, {o: (x, 2.0 / (span + 1.0)) for o, (x, span) in outs.items()}, key)
    ready = {o: F.when(seen(x, key) >= span, F.col(o)) for o, (x, span) in outs.items()}
    return t.withColumns(ready)


def reuse(df, name: str, expr: Column) -> Column:
    """``name`` when an earlier step already produced that exact column, else ``expr``: the merged
    feature table then evaluates each shared window (e.g. the 20-row close SMA) once."""
    return F.col(name) if name in df.columns else expr


def round_half_away(x, digits: int = 6) -> Column:
    """round(x, digits) as std::round(x * 10^d) / 10^d (half away from zero on the scaled double).

    Spark's ``round`` goes through a decimal representation and can differ on exact ties; this form
    is plain IEEE arithmetic, so any engine computing the same double rounds it identically.
    """
    m = float(10 ** digits)
    y = col(x) * F.lit(m)
    r = F.when(F.abs(y) >= F.lit(2.0 ** 52), y).otherwise(
        F.signum(y) * F.floor(F.abs(y) + F.lit(0.5)).cast("double"))
    return r / F.lit(m)


def rnd(df, digits: int = 6, keep=("ticker", "date")):
    """Round every double column (cross-engine value comparison) like ``round_half_away``.  The projection is SQL text:
    for wide tables that is built much faster than one column object per operator."""
    m = f"{10 ** digits}.0D"
    out = []
    for f in df.schema.fields:
        c = f"`{f.name}`"
        if f.dataType.typeName() in ("double", "float") and f.name not in keep:
            y = f"{c} * {m}"
            out.append(f"CASE WHEN abs({y}) >= 4503599627370496.0D THEN {y} ELSE signum({y}) * cast(floor(abs({y}) + 0.5D) AS double) END / {m} AS {c}")
        else:
            out.append(c)
    return df.selectExpr(*out)
