"""Click-rate encodings: per-key label statistics with Bayesian smoothing.

Scale notes
-----------
* Raw rows are aggregated once per (key, fold) with map-side partial
  aggregation; the leave-one-fold-out statistics come from subtraction on
  that small table instead of k separate group-bys.
* The prior has one row per fold (k rows), a proven size bound, so it is
  broadcast; the full-train prior is a scalar subquery.  The per-key table is joined with a plain equi-join; AQE picks
  broadcast or sort-merge from runtime sizes and splits a hot key's partition
  (``spark.sql.adaptive.skewJoin.enabled``).
* Nothing is collected to the driver; the prior is a one-row DataFrame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_FOLDS = 5


def _keys(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def prefix(keys) -> str:
    return "_".join(_keys(keys))


def _not_null(keys) -> Column:
    cond = F.lit(True)
    for k in _keys(keys):
        cond = cond & F.col(k).isNotNull()
    return cond


def key_label_stats(df: DataFrame, keys, label: str = "label") -> DataFrame:
    """Per key: ``<p>_count``, ``<p>_rate`` (mean label), ``<p>_click_number``.

    Rows with a missing key are dropped, as a pivot table does.
    """
    p = prefix(keys)
    return (df.where(_not_null(keys))
            .groupBy(*_keys(keys))
            .agg(F.count(F.lit(1)).alias(f"{p}_count"),
                 F.avg(label).alias(f"{p}_rate"),
                 F.sum(label).cast("long").alias(f"{p}_click_number")))


def cross_label_stats(df: DataFrame, keys: Sequence[str], label: str = "label") -> dict[str, DataFrame]:
    """``key_label_stats`` for every pair i<j of ``keys``."""
    ks = list(keys)
    return {f"{a}_{b}": key_label_stats(df, [a, b], label)
            for i, a in enumerate(ks) for b in ks[i + 1:]}


def prior_columns(m: Column, v: Column) -> tuple[Column, Column]:
    """Method-of-moments Beta prior from mean ``m`` and sample variance ``v``.

    ``v == 0`` or undefined gives NULL; negative values are kept as computed.
    """
    spread = m * (1 - m) - v
    alpha = F.try_divide(m, v) * spread
    beta = F.try_divide(1 - m, v) * spread
    return alpha, beta


def bayes_prior(stats: DataFrame, rate_col: str, by: Sequence[str] = ()) -> DataFrame:
    """``m = avg(rate)``, ``v = var_samp(rate)`` over keys (unweighted) -> alpha, beta."""
    agg = stats.groupBy(*by).agg(F.avg(rate_col).alias("prior_mean"),
                                 F.var_samp(rate_col).alias("prior_var"))
    a, b = prior_columns(F.col("prior_mean"), F.col("prior_var"))
    return agg.select(*by, "prior_mean", "prior_var", a.alias("alpha"), b.alias("beta"))


def smoothed_rate(clicks: Column, count: Column, alpha: Column, beta: Column) -> Column:
    """``(clicks + alpha) / (count + alpha + beta)``."""
    return F.try_divide(clicks + alpha, count + alpha + beta)


def rate_table(train: DataFrame, keys, label: str = "label") -> DataFrame:
    """Full-train smoothed rate table: one row per key."""
    p = prefix(keys)
    st = key_label_stats(train, keys, label)
    prior = bayes_prior(st, f"{p}_rate")
    ab = prior.select(F.struct("alpha", "beta")).scalar()                   # one row
    return st.select(*_keys(keys), f"{p}_count", f"{p}_click_number",
                     smoothed_rate(F.col(f"{p}_click_number"), F.col(f"{p}_count"),
                                   ab["alpha"], ab["beta"]).alias(f"{p}_rate"))


def apply_rate(train: DataFrame, test: DataFrame, keys, label: str = "label") -> DataFrame:
    """Left-join the full-train rate table onto ``test`` (unseen key -> NULLs)."""
    return test.join(rate_table(train, keys, label), _keys(keys), "left")


def oof_rate_table(df: DataFrame, keys, fold: str = "fold", label: str = "label",
                   k: int = DEFAULT_FOLDS) -> DataFrame:
    """Leave-one-fold-out statistics per (key, fold), smoothed with a per-fold prior.

    For fold f the statistics of a key are those of all rows outside f; a key
    that occurs only inside f gets no row (its rows receive NULLs).  Every key
    is expanded to all k folds because the prior of fold f averages over every
    key present outside f.
    """
    ks = _keys(keys)
    p = prefix(keys)
    per_fold = (df.where(_not_null(keys))
                .groupBy(*ks, fold)
                .agg(F.count(F.lit(1)).alias("_n"), F.sum(label).cast("long").alias("_c")))
    totals = per_fold.groupBy(*ks).agg(F.sum("_n").alias("_tn"), F.sum("_c").alias("_tc"))
    expanded = totals.select(*ks, "_tn", "_tc",
                             F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias(fold))
    out = (expanded.join(per_fold, [*ks, fold], "left")
           .select(*ks, fold,
                   (F.col("_tn") - F.coalesce(F.col("_n"), F.lit(0))).alias(f"{p}_count"),
                   (F.col("_tc") - F.coalesce(F.col("_c"), F.lit(0))).alias(f"{p}_click_number"))
           .where(F.col(f"{p}_count") > 0)
           .withColumn("_raw", F.col(f"{p}_click_number") / F.col(f"{p}_count")))
    prior = bayes_prior(out, "_raw", by=[fold])          # k rows
    return (out.join(F.broadcast(prior.select(fold, "alpha", "beta")), fold, "left")
            .select(*ks, fold, f"{p}_count", f"{p}_click_number",
                    smoothed_rate(F.col(f"{p}_click_number"), F.col(f"{p}_count"),
                                  F.col("alpha"), F.col("beta")).alias(f"{p}_rate")))


def oof_rate(df: DataFrame, keys, fold: str = "fold", label: str = "label",
             k: int = DEFAULT_FOLDS) -> DataFrame:
    """Out-of-fold train encoding: each row gets statistics of the other folds."""
    return df.join(oof_rate_table(df, keys, fold, label, k), [*_keys(keys), fold], "left")


def oof_rates_all(df: DataFrame, keys: Sequence[str], fold: str = "fold",
                  label: str = "label", k: int = DEFAULT_FOLDS, cross: bool = True) -> DataFrame:
    """Single-key encodings for every key, and pair encodings for every i<j."""
    out = df
    ks = list(keys)
    for key in ks:
        out = oof_rate(out, key, fold, label, k)
    if cross:
        for i, a in enumerate(ks):
            for b in ks[i + 1:]:
                out = oof_rate(out, [a, b], fold, label, k)
    return out


def attach_counts(df: DataFrame, keys, name: str) -> DataFrame:
    """Rows sharing ``keys``, on every row (``count(*) over (partition by keys)``).

    Written as a partial aggregate joined back instead of a window: a window
    puts a hot key's rows into one task, the aggregate combines map-side and
    the join is split by AQE when a key is skewed.  A NULL key gets NULL.
    """
    ks = _keys(keys)
    counts = df.where(_not_null(ks)).groupBy(*ks).agg(F.count(F.lit(1)).alias(name))
    return df.join(counts, ks, "left")
