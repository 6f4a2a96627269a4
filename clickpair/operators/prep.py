"""Projections, cleaning, scaling, slicing, sampling, stacking and ordering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickpair.operators.sequence import prefix_sums

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
            T.DecimalType)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, _NUMERIC) and f.name not in exclude]


def dedup_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Full-row (or ``cols``) distinct; a partial aggregate before the shuffle."""
    return df.dropDuplicates(list(cols)) if cols else df.dropDuplicates()


def fill_missing(df: DataFrame, value=-1, cols: Sequence[str] | None = None) -> DataFrame:
    """Replace NULL (and NaN) of numeric columns by ``value``."""
    cols = list(cols) if cols else numeric_columns(df)
    return df.na.fill(value, subset=cols)


def column_minmax(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: ``<c>_min`` and ``<c>_max`` for every column."""
    aggs = []
    for c in cols:
        aggs += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    return df.agg(*aggs)


def minmax_scale(df: DataFrame, cols: Sequence[str], fill=-1.0) -> DataFrame:
    """``(x − min)/(max − min)`` per column; 0/0 and NULL become ``fill``.

    All minima and maxima come from one aggregate, a single struct-valued
    scalar subquery projected once (one copy of the input plan, one job).
    """
    st = df.agg(F.struct(*[e for c in cols for e in (F.min(c).alias(f"{c}_min"),
                                                      F.max(c).alias(f"{c}_max"))])).scalar()
    d = df.withColumn("_mm", st)
    scaled = {}
    for c in cols:
        lo, hi = F.col(f"_mm.{c}_min").cast("double"), F.col(f"_mm.{c}_max").cast("double")
        scaled[c] = F.coalesce(F.try_divide(F.col(c).cast("double") - lo, hi - lo), F.lit(float(fill)))
    return d.withColumns(scaled).drop("_mm")


def row_index(df: DataFrame, order: str, name: str = "row_idx") -> DataFrame:
    """0-based position in ``order`` (distinct values), without a global window."""
    ps = prefix_sums(df.withColumn("_one", F.lit(1).cast("long")), order, "_one")
    return ps.withColumnRenamed("_one_before", name).drop("_one")


def split_by_position(df: DataFrame, order: str, n_train: int = 15000,
                      name: str = "split") -> DataFrame:
    """First ``n_train`` rows in ``order`` are 'train', the rest 'test'."""
    ix = row_index(df, order, "_ix")
    return ix.withColumn(name, F.when(F.col("_ix") < n_train, "train").otherwise("test")).drop("_ix")


def slice_rows(df: DataFrame, order: str, chunk_size: int, keep: Sequence[int]) -> DataFrame:
    """Cut rows (in ``order``) into chunks of ``chunk_size`` and keep the listed
    chunk numbers (0-based), e.g. ``keep=(0, 9)`` for the first and tenth."""
    ix = row_index(df, order, "_ix")
    return (ix.withColumn("chunk", F.floor(F.col("_ix") / chunk_size).cast("long"))
            .where(F.col("chunk").isin(list(keep))).drop("_ix"))


def sample_rows(df: DataFrame, n: int, key: str = "pair_id", seed: int = 2019) -> DataFrame:
    """``n`` rows without replacement, reproducibly: smallest md5(seed:key).

    ``limit`` after a global ``orderBy`` runs as a distributed top-k
    (TakeOrderedAndProject): each partition keeps n rows, then one merge.
    """
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return df.withColumn("_h", h).orderBy("_h", key).limit(n).drop("_h")


def filter_predictors(df: DataFrame, exclude: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in set(exclude)])


def select_rename_drop(df: DataFrame, rename: dict[str, str] | None = None,
                       drop: Sequence[str] = ()) -> DataFrame:
    out = df.drop(*drop)
    return out.withColumnsRenamed(rename) if rename else out


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def avg_predictions(frames: Sequence[DataFrame], key: str = "pair_id",
                    pred: str = "prediction") -> DataFrame:
    """Mean prediction per key over several scored frames (folds × chunks)."""
    stacked = union_all([f.select(key, F.col(pred).cast("double").alias(pred)) for f in frames])
    return stacked.groupBy(key).agg(F.avg(pred).alias(pred), F.count(F.lit(1)).alias("n_models"))


def sort_by_index(df: DataFrame, col: str = "pair_id") -> DataFrame:
    """Total order on the id; only meaningful right before a sink."""
    return df.orderBy(col)


def limit_rows(df: DataFrame, n: int, order: str = "pair_id") -> DataFrame:
    """First ``n`` rows in ``order`` (a distributed top-k, not a collect)."""
    return df.orderBy(order).limit(n)
