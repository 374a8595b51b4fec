"""Feature selection and matrix preparation: correlation pruning, ANOVA F, binned mutual information,
train-fitted standardisation, trained-column alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlens.operators.quantiles import order_statistics


def to_long(df: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """Unpivot wide features to (keys..., feature, value)."""
    return df.selectExpr(*keys, *[f"cast(`{c}` AS double) AS `{c}`" for c in features]).unpivot(keys, features, "feature", "value")


def gram(df: DataFrame, features: list[str]) -> DataFrame:
    """Pairwise-complete moments of all column pairs, ``i <= j`` (positions in ``features``): ``n`` rows that hold both,
    sums ``si, sj``, squares ``qi, qj`` and product ``p`` of the values less their column's mean.

    A task multiplies its rows as matrices and leaves one row per pair; Spark adds these up.  Memory of a task is four
    square matrices of the number of columns, whatever the number of rows."""
    mean = df.agg(*[F.expr(f"avg(cast(`{c}` AS double))").alias(f"m{i}") for i, c in enumerate(features)]).first()
    center = np.array([0.0 if m is None else m for m in mean])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = len(center)
        both, sums, squares, products = (np.zeros((k, k)) for _ in range(4))
        for b in batches:
            x = b.to_numpy(np.float64)
            has = ~np.isnan(x)
            x, m = np.where(has, x - center, 0.0), has.astype(np.float64)
            both += m.T @ m
            sums += x.T @ m  # row i, column j: the sum of i where j has a value
            squares += (x * x).T @ m
            products += x.T @ x
        i, j = np.triu_indices(k)
        yield pd.DataFrame({"i": i, "j": j, "n": both[i, j], "si": sums[i, j], "sj": sums[j, i], "qi": squares[i, j], "qj": squares[j, i], "p": products[i, j]})

    wide = df.selectExpr(*[f"cast(`{c}` AS double) AS c{i}" for i, c in enumerate(features)])
    parts = wide.mapInPandas(run, "i int, j int, n double, si double, sj double, qi double, qj double, p double")
    return parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "si", "sj", "qi", "qj", "p")])


def gram_corr(moments: DataFrame) -> DataFrame:
    """``moments`` of different columns with ``corr`` (NULL without variance or with less than two rows)."""
    spread = lambda q, s: F.col(q) - F.try_divide(F.col(s) * F.col(s), F.col("n"))
    vi, vj = spread("qi", "si"), spread("qj", "sj")
    cov = F.col("p") - F.try_divide(F.col("si") * F.col("sj"), F.col("n"))
    return moments.where("i < j").withColumn("corr", F.when((F.col("n") > 1) & (vi > 0) & (vj > 0), F.try_divide(cov, F.sqrt(vi) * F.sqrt(vj))))


def corr_matrix(df: DataFrame, features: list[str]) -> DataFrame:
    """Correlations of all column pairs as a long table ``a, b, corr``, ``a`` before ``b`` in ``features``."""
    names = F.array(*[F.lit(c) for c in features])
    return gram_corr(gram(df, features)).select(names[F.col("i")].alias("a"), names[F.col("j")].alias("b"), "corr")


def corr_prune(df: DataFrame, features: list[str], threshold: float = 0.95, max_null: float = 0.5) -> DataFrame:
    """Keep features with null ratio < ``max_null``; drop feature j when any earlier kept-candidate i
    (i < j in the given order) has |corr(i, j)| > threshold (upper triangle, not iterative).

    Output: feature, ordinal, null_ratio, max_abs_corr_prior, keep.
    """
    moments = gram(df, features).checkpoint(eager=True)  # one row per pair of columns
    rows = df.count()
    own = moments.where("i = j").select(F.col("i").alias("ordinal"), (F.lit(1.0) - F.try_divide(F.col("n"), F.lit(float(rows)))).alias("null_ratio"))
    ok = own.where(F.col("null_ratio") < max_null).select("ordinal")
    pairs = gram_corr(moments).join(ok.withColumnRenamed("ordinal", "i"), "i", "leftsemi").join(ok.withColumnRenamed("ordinal", "j"), "j", "leftsemi")
    # the later column of each pair is the one tested against its predecessors
    worst = pairs.groupBy(F.col("j").alias("ordinal")).agg(F.max(F.abs("corr")).alias("max_abs_corr_prior"))
    keep = (F.col("null_ratio") < max_null) & F.coalesce(F.col("max_abs_corr_prior") <= threshold, F.lit(True))
    names = F.array(*[F.lit(c) for c in features])
    return own.join(worst, "ordinal", "left").select(names[F.col("ordinal")].alias("feature"), "ordinal", "null_ratio", "max_abs_corr_prior", keep.alias("keep"))


def f_score(df: DataFrame, features: list[str], label: str = "outperforms") -> DataFrame:
    """One-way ANOVA F statistic of each feature across label classes (rows with a value only)."""
    long = to_long(df, features, [label]).filter(F.col("value").isNotNull())
    g = long.groupBy("feature", label).agg(F.count("*").alias("n_g"), F.avg("value").alias("m_g"),
                                           F.var_pop("value").alias("v_g"))
    w = Window.partitionBy("feature")
    n = F.sum("n_g").over(w)
    m = F.sum(F.col("n_g") * F.col("m_g")).over(w) / n
    t = g.select("feature", "n_g", "m_g", "v_g", n.alias("n"), m.alias("m"), F.count("*").over(w).alias("k"))
    a = t.groupBy("feature", "n", "k").agg(F.sum(F.col("n_g") * ((F.col("m_g") - F.col("m")) * (F.col("m_g") - F.col("m")))).alias("ssb"),
                                           F.sum(F.col("n_g") * F.col("v_g")).alias("ssw"))
    fval = F.try_divide(F.try_divide(F.col("ssb"), (F.col("k") - 1).cast("double")), F.try_divide(F.col("ssw"), (F.col("n") - F.col("k")).cast("double")))
    return a.select("feature", "n", "ssb", "ssw", fval.alias("f_score"))


def ntile_positions(long: DataFrame, bins: int, key: str = "feature", value: str = "value",
                    tiebreak: tuple[str, str] = ("ticker", "date")) -> DataFrame:
    """``ntile(bins) OVER (PARTITION BY key ORDER BY value, ticker, date)`` without a per-key window.

    A row's 0-based position is (rows of its key with a smaller value) + (its rank among rows with the
    same value, by ticker then date).  Both parts are bucketed prefix sums, so neither a whole column
    nor a large tie group ever sits in one task; ntile's bucket sizes then follow from the position.
    """
    from barlens.operators.metrics import prefix_sums

    t_name, d_name = tiebreak
    tick = long.select(t_name).distinct()
    tick = tick.select(t_name, (F.row_number().over(Window.orderBy(t_name)) - 1).cast("long").alias("_tord"))
    # numeric tie-break key ordered like (ticker, date): ticker ordinal * 2^20 + epoch day
    rows = long.join(tick, t_name).select(
        "*", (F.col("_tord") * (1 << 20) + F.datediff(F.col(d_name), F.lit("1970-01-01").cast("date"))).alias("_tk"),
        F.lit(1).cast("long").alias("_one"))
    vals = rows.groupBy(key, value).agg(F.count("*").alias("_nv"))
    below = prefix_sums(vals, value, ["_nv"], [key], inclusive=False).select(key, value, F.col("cum__nv").alias("_below"))
    within = prefix_sums(rows, "_tk", ["_one"], [key, value], inclusive=False).withColumnRenamed("cum__one", "_within")
    n = vals.groupBy(key).agg(F.sum("_nv").alias("_n"))
    t = within.join(below, [key, value]).join(F.broadcast(n), key)
    pos = F.col("_below") + F.col("_within")
    q = F.floor(F.col("_n") / bins)
    r = F.col("_n") - q * bins
    big = r * (q + 1)
    b = F.when(pos < big, F.floor(pos / (q + 1))).otherwise(r + F.floor((pos - big) / q)) + 1
    return t.select(*long.columns, b.cast("int").alias("bin"))


def mutual_info(df: DataFrame, features: list[str], label: str = "outperforms", bins: int = 10,
                keys: tuple[str, ...] = ("ticker", "date")) -> DataFrame:
    """MI(feature bin; label) with equal-frequency bins (ntile over the feature's non-null values)."""
    long = to_long(df, features, [*keys, label]).filter(F.col("value").isNotNull())
    b = ntile_positions(long, bins, tiebreak=keys).select("feature", label, "bin")
    j = b.groupBy("feature", "bin", label).agg(F.count("*").alias("n_xy"))
    w = Window.partitionBy("feature")
    t = j.select("*", F.sum("n_xy").over(w).alias("n"),
                 F.sum("n_xy").over(Window.partitionBy("feature", "bin")).alias("n_x"),
                 F.sum("n_xy").over(Window.partitionBy("feature", label)).alias("n_y"))
    term = (F.col("n_xy") / F.col("n")) * F.log((F.col("n_xy") * F.col("n")) / (F.col("n_x") * F.col("n_y")))
    return t.groupBy("feature").agg(F.sum(term).alias("mutual_info"))


def mutual_info_binned(df: DataFrame, features: list[str], label: str = "outperforms", bins: int = 10) -> DataFrame:
    """MI(feature bin; label) with bins between the feature's quantiles: the value of rank ``floor((n - 1) k / bins)``
    bounds bin k - 1 from above, so equal values share a bin.  The bounds come from distributed selection, the
    contingency counts from one pass over the wide table: a task sums its rows per (feature, bin, label) before it sends
    anything."""
    ranks = lambda c, n: [(n - 1) * k // bins for k in range(1, bins)]
    size, got = order_statistics(df.selectExpr(*[f"cast(`{c}` AS double) AS `{c}`" for c in features]), ranks)
    cells = []
    for i, c in enumerate(features):
        if size[c]:
            bounds = [got[(c, r)] for r in ranks(c, size[c])]
            bin_ = " + ".join(f"int(`{c}` > double('{b!r}'))" for b in bounds)
            cells.append(f"CASE WHEN `{c}` IS NOT NULL THEN {i * bins} + {bin_} END")
    long = df.selectExpr(f"`{label}` AS label", f"explode(filter(array({', '.join(cells)}), x -> x IS NOT NULL)) AS cell")
    j = long.groupBy("cell", "label").agg(F.count("*").alias("n_xy")).withColumn("i", F.floor(F.col("cell") / bins).cast("int"))
    w = Window.partitionBy("i")  # from here on a few rows per feature
    t = j.select("*", F.sum("n_xy").over(w).alias("n"), F.sum("n_xy").over(Window.partitionBy("i", "cell")).alias("n_x"),
                 F.sum("n_xy").over(Window.partitionBy("i", "label")).alias("n_y"))
    term = (F.col("n_xy") / F.col("n")) * F.log((F.col("n_xy") * F.col("n")) / (F.col("n_x") * F.col("n_y")))
    names = F.array(*[F.lit(c) for c in features])
    return t.groupBy("i").agg(F.sum(term).alias("mutual_info")).select(names[F.col("i")].alias("feature"), "mutual_info")


def select_top(scores: DataFrame, score: str, n: int, name: str = "feature") -> DataFrame:
    """The n best-scoring features (SelectKBest): score rounded to 9 dp for the order, so an ulp
    between two identical columns cannot reorder them; ties by name."""
    from barlens.functions.series import round_half_away

    return scores.orderBy(round_half_away(score, 9).desc_nulls_last(), name).limit(n)


def fit_scale(df: DataFrame, features: list[str], fit_filter=None) -> dict[str, tuple[float | None, float]]:
    """``feature -> (mean, sigma)`` over the ``fit_filter`` rows: one aggregate pass, two numbers per feature come to
    the driver.  Sigma has ddof 0; a sigma of 0 (or none) is 1, a mean without any value is None."""
    fit = df.filter(fit_filter) if fit_filter is not None else df
    st = fit.agg(*[F.avg(c).alias(f"mu_{i}") for i, c in enumerate(features)],
                 *[F.stddev_pop(c).alias(f"sd_{i}") for i, c in enumerate(features)]).first()
    return {c: (st[f"mu_{i}"], st[f"sd_{i}"] or 1.0) for i, c in enumerate(features)}


def apply_scale(df: DataFrame, scale: dict[str, tuple[float | None, float]]) -> DataFrame:
    """``(x - mean) / sigma`` of the columns in ``scale`` (unchanged where the mean is None), a projection with literals:
    no per-feature subquery runs the input plan again."""
    z = lambda c, mu, sd: F.col(c) if mu is None else (F.col(c) - F.lit(mu)) / F.lit(sd)
    return df.select(*[z(c, *scale[c]).alias(c) if c in scale else F.col(c) for c in df.columns])


def standardize(df: DataFrame, features: list[str], fit_filter=None) -> DataFrame:
    """(x - mean) / sigma, fitted on ``fit_filter`` rows (e.g. the train split)."""
    return apply_scale(df, fit_scale(df, features, fit_filter))


def align_feature_columns(df: DataFrame, trained: list[str], keys: list[str]) -> DataFrame:
    """Project onto the trained column list in order: absent names become 0.0, extra columns are
    dropped, NULLs take the column's median (0.0 when the column has no value at all)."""
    from barlens.operators.clean import fit_medians

    have = [c for c in trained if c in df.columns]
    med = fit_medians(df, have) if have else {}
    return df.selectExpr(*keys, *[f"coalesce(cast(`{c}` AS double), double('{med[c] if med[c] is not None else 0.0!r}')) AS `{c}`" if c in med else f"0.0D AS `{c}`" for c in trained])


def model_rows(df: DataFrame, trained: list[str], scale: dict[str, tuple[float | None, float]], keys: list[str]) -> DataFrame:
    """Raw feature rows as input of a model fitted on ``trained`` columns scaled by ``scale``: columns that ``df`` lacks
    (those of a benchmark that cannot be had) are 0 and nulls the column's median, then all are scaled alike."""
    return apply_scale(align_feature_columns(df, trained, keys), {c: scale[c] for c in trained}).fillna(0.0, trained)


def prepare_matrix(df: DataFrame, features: list[str]) -> DataFrame:
    """Drop keys, map +-inf/NaN to NULL, fill with the global column median."""
    from barlens.operators.clean import inf_to_null, median_impute

    t = inf_to_null(df.select(*features), features)
    return median_impute(t, features, key=None)
