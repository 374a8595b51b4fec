"""Cleansing and gating operators (row filters, per-ticker gates, fills, imputation)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlens.functions.series import KEY, W

PRICE_COLS = ["open", "high", "low", "close"]
OHLCV = PRICE_COLS + ["volume"]

# Fixed gate values of the reference configuration.
MIN_TRADING_DAYS = 30
MAX_MISSING_RATIO = 0.1
MIN_VOLUME_THRESHOLD = 1000
SPARSE_RATIO = 0.5


def min_history(df: DataFrame, min_rows: int = MIN_TRADING_DAYS, key: str = KEY) -> DataFrame:
    """Keep tickers with at least ``min_rows`` rows (counted before any row filter)."""
    return df.select("*", F.count("*").over(Window.partitionBy(key)).alias("_n")).filter(F.col("_n") >= min_rows).drop("_n")


def missing_ratio(df: DataFrame, cols=OHLCV, key: str = KEY) -> DataFrame:
    """Per ticker: null cells / (rows * len(cols))."""
    nulls = sum((F.sum(F.col(c).isNull().cast("int")) for c in cols), F.lit(0))
    return df.groupBy(key).agg((nulls / (F.count("*") * F.lit(len(cols)))).alias("null_ratio"))


def missing_ratio_gate(df: DataFrame, cols=OHLCV, max_ratio: float = MAX_MISSING_RATIO, key: str = KEY) -> DataFrame:
    """Drop tickers whose null-cell ratio exceeds ``max_ratio`` (semi join on the passing tickers)."""
    ok = missing_ratio(df, cols, key).filter(F.col("null_ratio") <= max_ratio).select(key)
    return df.join(ok, key, "left_semi")


def valid_price(df: DataFrame) -> DataFrame:
    """All four prices > 0 (a NULL price fails the comparison and the row is dropped)."""
    cond = F.lit(True)
    for c in PRICE_COLS:
        cond = cond & F.coalesce(F.col(c) > 0, F.lit(False))
    return df.filter(cond)


def min_volume(df: DataFrame, threshold: float = MIN_VOLUME_THRESHOLD) -> DataFrame:
    return df.filter(F.coalesce(F.col("volume") >= threshold, F.lit(False)))


def ffill_bars(df: DataFrame, cols=OHLCV, key: str = KEY) -> DataFrame:
    w = W(key).rowsBetween(Window.unboundedPreceding, 0)
    return df.select(*[F.last(c, ignorenulls=True).over(w).alias(c) if c in cols else F.col(c) for c in df.columns])


def drop_null_rows(df: DataFrame, cols=None) -> DataFrame:
    return df.na.drop(how="any", subset=cols)


def asof_cutoff(df: DataFrame, as_of) -> DataFrame:
    d = as_of if isinstance(as_of, _dt.date) else _dt.date.fromisoformat(str(as_of))
    return df.filter(F.col("date") <= F.lit(d))


def recent_start(dates: DataFrame, days: int, col: str = "date") -> _dt.date | None:
    """``days`` before the newest date, as a value that a scan can push down; None without a date."""
    last = dates.select(F.to_date(F.max(col))).first()[0]  # one value
    return None if last is None else last - _dt.timedelta(days=days)


def ticker_subset(df: DataFrame, n: int, seed: int = 42, key: str = KEY) -> DataFrame:
    """Deterministic seeded sample of ``n`` tickers: order by md5(ticker || seed), keep the first n."""
    tick = df.select(key).distinct()
    pick = tick.orderBy(F.md5(F.concat(F.col(key), F.lit(f":{seed}"))), key).limit(n)
    return df.join(pick, key, "left_semi")


def bfill_features(df: DataFrame, cols, key: str = KEY) -> DataFrame:
    """Backward fill per ticker (the reference default; it leaks later values into warm-up rows).

    Written as a running ``last(ignorenulls)`` in descending date order: Spark evaluates a growing
    frame incrementally (O(n)), whereas a ``current row .. unbounded following`` frame is re-aggregated
    for every row (O(n^2) per ticker)."""
    w = Window.partitionBy(key).orderBy(F.col("date").desc()).rowsBetween(Window.unboundedPreceding, 0)
    cs = set(cols)
    return df.select(*[F.last(c, ignorenulls=True).over(w).alias(c) if c in cs else F.col(c) for c in df.columns])


def feature_null_ratio(df: DataFrame, cols, key: str | None = KEY) -> DataFrame:
    """Long table (ticker, feature, null_ratio) -- one conditional-count pass, then unpivot."""
    keys = [key] if key else []
    agg = df.groupBy(*keys).agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols])
    return agg.unpivot(keys, list(cols), "feature", "null_ratio") if keys else agg.unpivot([], list(cols), "feature", "null_ratio")


def drop_sparse_features(df: DataFrame, cols, max_ratio: float = SPARSE_RATIO, key: str = KEY) -> DataFrame:
    """Null out, per ticker, every feature whose null ratio exceeds ``max_ratio`` (a static-schema
    equivalent of dropping the column per ticker before a ragged concat)."""
    w = Window.partitionBy(key)
    out = []
    cs = set(cols)
    for c in df.columns:
        if c in cs:
            ratio = F.avg(F.col(c).isNull().cast("double")).over(w)
            out.append(F.when(ratio <= max_ratio, F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def median_impute(df: DataFrame, cols, key: str | None = KEY, exact: bool = True,
                  accuracy: int = 100000) -> DataFrame:
    """Fill nulls with the per-ticker (or global) median of the column.

    Per-ticker groups are bounded by the calendar (one row per date), so the exact interpolated
    percentile over a ticker partition stays small.  A global exact median is found by distributed
    selection (``quantiles``); ``exact=False`` takes the mergeable sketch (``percentile_approx``) instead.
    """
    cs = set(cols)
    if key:
        w = Window.partitionBy(key)
        return df.select(*[F.coalesce(F.col(c), F.percentile(c, 0.5).over(w)).alias(c) if c in cs else F.col(c)
                           for c in df.columns])

    med = fit_medians(df, list(cols), exact, accuracy)
    return df.selectExpr(*[f"coalesce(`{c}`, double('{med[c]!r}')) AS `{c}`" if c in cs and med[c] is not None else f"`{c}`" for c in df.columns])


def fill_chain(df: DataFrame, cols, block: str, max_ratio: float = SPARSE_RATIO, key: str = KEY) -> DataFrame:
    """``bfill_features``, ``drop_sparse_features`` and ``median_impute`` in one, for series that are cut into ``block``s of
    consecutive rows: a gap at the end of a block takes the first later value from the heads of the blocks after it
    (one row per series and block), so a series spreads over tasks; ratios and medians are one aggregate per series.
    The projections are SQL text, which is built much faster than column objects for wide tables."""
    other = [c for c in df.columns if c not in set(cols)]
    fields = lambda expr: ", ".join(f"'{c}', {expr(f'`{c}`')}" for c in cols)
    near = df.selectExpr(*other, *[f"last(`{c}`, true) OVER (PARTITION BY {key}, {block} ORDER BY date DESC ROWS UNBOUNDED PRECEDING) AS `{c}`" for c in cols])
    heads = near.groupBy(key, block).agg(F.expr(f"min_by(named_struct({fields(str)}), date)").alias("_h"))
    later = f"(PARTITION BY {key} ORDER BY {block} DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    carry = heads.selectExpr(key, block, f"named_struct({fields(lambda c: f'last(_h.{c}, true) OVER {later}')}) AS _c")
    filled = near.join(carry, [key, block]).selectExpr(*other, *[f"coalesce(`{c}`, _c.`{c}`) AS `{c}`" for c in cols])
    filled = filled.checkpoint(eager=True)
    stats = filled.groupBy(key).agg(F.expr(f"named_struct({fields(lambda c: f'avg(cast({c} IS NULL AS double))')})").alias("_n"),
                                    F.expr(f"named_struct({fields(lambda c: f'percentile({c}, 0.5D)')})").alias("_m"))
    return filled.join(stats, key).selectExpr(*other, *[f"CASE WHEN _n.`{c}` <= {float(max_ratio)}D THEN coalesce(`{c}`, _m.`{c}`) END AS `{c}`" for c in cols])


def fit_medians(df: DataFrame, cols, exact: bool = True, accuracy: int = 100000) -> dict:
    """Column medians (an Imputer-style fit: one number per column): exact ones by distributed selection, or the
    mergeable sketch in one pass."""
    if exact:
        from barlens.operators.quantiles import quantiles

        return {c: q[0] for c, q in quantiles(df.select(*cols), [0.5]).items()}
    row = df.agg(*[F.percentile_approx(c, 0.5, accuracy).alias(f"m_{i}") for i, c in enumerate(cols)]).first()
    return {c: row[f"m_{i}"] for i, c in enumerate(cols)}


def inf_to_null(df: DataFrame, cols) -> DataFrame:
    cs, types = set(cols), dict(df.dtypes)
    return df.selectExpr(*[f"CASE WHEN abs(`{c}`) < double('Infinity') THEN `{c}` END AS `{c}`" if c in cs and types[c] in ("double", "float")
                           else f"`{c}`" for c in df.columns])


def quality_report(df: DataFrame, feature_cols, label_col: str = "outperforms") -> DataFrame:
    """Per feature: null ratio, >50 % flag and inf count; plus label nulls and an overall score
    (total - problem features) / total, as one row per feature."""
    cells = ", ".join(f"named_struct('feature', '{c}', 'null_ratio', avg(double(`{c}` IS NULL)), 'inf_count', count_if(abs(double(`{c}`)) = double('Infinity')))" for c in feature_cols)
    one = df.agg(F.expr(f"array({cells})").alias("r"), F.expr(f"count_if(`{label_col}` IS NULL)").alias("label_nulls"))
    rows = one.selectExpr("explode(r) AS r", "label_nulls").select("r.*", "label_nulls")
    problem = (F.col("null_ratio") > SPARSE_RATIO) | (F.col("inf_count") > 0)
    w = Window.partitionBy()  # one row per feature
    n_bad = F.sum(problem.cast("int")).over(w)
    total = F.count("*").over(w)
    return rows.select("*", problem.alias("is_problem"),
                       ((total - n_bad) / total).alias("quality_score"),
                       (F.col("label_nulls") == 0).alias("labels_ok"))


def source_quality(bars: DataFrame, as_of, min_tickers: int = 20, max_stale_days: int = 2,
                   max_null_ratio: float = 0.1) -> DataFrame:
    """Plan-level data checks: ticker count, staleness of the latest bar, worst per-ticker null ratio."""
    d = as_of if isinstance(as_of, _dt.date) else _dt.date.fromisoformat(str(as_of))
    nr = missing_ratio(bars).agg(F.max("null_ratio").alias("worst_null_ratio"))
    s = bars.agg(F.countDistinct("ticker").alias("n_tickers"), F.max("date").alias("last_date"))
    s = s.select("*", F.datediff(F.lit(d), F.col("last_date")).alias("stale_days"),
                 nr.scalar().alias("worst_null_ratio"))
    return s.select("*", ((F.col("n_tickers") >= min_tickers) & (F.col("stale_days") <= max_stale_days)
                          & (F.col("worst_null_ratio") < max_null_ratio)).alias("passed"))


def cache_compat(cached: DataFrame, requested: DataFrame, min_overlap: float = 0.8) -> DataFrame:
    """Compare a cached bar set with a requested one: ticker sets (missing / extra), date overlap as a
    share of the cached span, and a compatibility flag -- one summary row."""
    ct = cached.select("ticker").distinct()
    rt = requested.select("ticker").distinct()
    missing = rt.join(ct, "ticker", "left_anti").agg(F.count("*").alias("missing_tickers"))
    extra = ct.join(rt, "ticker", "left_anti").agg(F.count("*").alias("extra_tickers"))
    cspan = cached.agg(F.min("date").alias("c_start"), F.max("date").alias("c_end"))
    rspan = requested.agg(F.min("date").alias("r_start"), F.max("date").alias("r_end"))
    s = cspan.select(
        "*", rspan.select("r_start").scalar().alias("r_start"), rspan.select("r_end").scalar().alias("r_end"),
        missing.scalar().alias("missing_tickers"), extra.scalar().alias("extra_tickers"))
    overlap = F.greatest(F.datediff(F.least("c_end", "r_end"), F.greatest("c_start", "r_start")), F.lit(0))
    span = F.datediff("c_end", "c_start")
    s = s.select("*", F.try_divide(overlap.cast("double"), span.cast("double")).alias("overlap_ratio"))
    return s.select("*", ((F.col("missing_tickers") == 0) & (F.col("extra_tickers") == 0)
                          & F.coalesce(F.col("overlap_ratio") >= min_overlap, F.lit(False))).alias("compatible"))
