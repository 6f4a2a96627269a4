"""Pair scoring job B: edit and alignment features.

Levenshtein is Spark's built-in expression.  The other kernels have no
built-in form and run as Arrow-batched pandas UDFs (one Python call per
batch, a tight loop inside).  ``ratio`` and its padded variant are column
arithmetic on the LCS length, so no second pass over the strings is needed.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickpair.functions import edit as K

# DataType objects (not DDL strings): workers re-import this module without a session
EDIT_STRUCT = T.StructType([
    T.StructField("lcseque_lens", T.IntegerType()),
    T.StructField("lcsubstr_lens", T.IntegerType()),
    T.StructField("jaro", T.DoubleType()),
    T.StructField("jaro_winkler", T.DoubleType()),
    T.StructField("list_dis", T.DoubleType()),
])


def _pairs(a: pd.Series, b: pd.Series):
    return zip(a.fillna("").tolist(), b.fillna("").tolist())


@F.pandas_udf(T.IntegerType())
def lcs_seq_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([K.lcs_seq(x, y) for x, y in _pairs(a, b)], dtype="int32")


@F.pandas_udf(T.IntegerType())
def lcs_substr_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([K.lcs_substr(x, y) for x, y in _pairs(a, b)], dtype="int32")


@F.pandas_udf(T.DoubleType())
def jaro_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([K.jaro(x, y) for x, y in _pairs(a, b)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def jaro_winkler_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([K.jaro_winkler(x, y) for x, y in _pairs(a, b)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def seq_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([K.seq_ratio(x.split(" "), y.split(" ")) for x, y in _pairs(a, b)],
                     dtype="float64")


@F.pandas_udf(EDIT_STRUCT)
def edit_struct_udf(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    x, y = a.fillna("").tolist(), b.fillna("").tolist()
    out = pd.DataFrame(dict(zip(["lcseque_lens", "lcsubstr_lens", "jaro", "jaro_winkler"], K.text_kernels(x, y))))
    out["list_dis"] = pd.Series([K.seq_ratio(p.split(" "), q.split(" ")) for p, q in zip(x, y)], dtype="float64")
    return out.astype({"lcseque_lens": "int32", "lcsubstr_lens": "int32"})


def ratio_from_lcs(lcs: Column, la: Column, lb: Column) -> Column:
    """Indel ratio ``2·LCS/(|a|+|b|)``; two empty strings give 1."""
    total = la + lb
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * lcs / total)


def ratio_padded_from_lcs(lcs: Column, la: Column, lb: Column) -> Column:
    """Hand-written variant: ``(2 + 2·LCS)/(|a|+|b|+2)``; an empty side returns
    the length of the other side."""
    return (F.when(la == 0, lb.cast("double")).when(lb == 0, la.cast("double"))
            .otherwise((2.0 + 2.0 * lcs) / (la + lb + 2)))


def combo(a: Column, b: Column, name: str) -> list[Column]:
    """Mean, product and absolute difference of two float32 features."""
    a, b = a.cast("float").cast("double"), b.cast("float").cast("double")
    return [((a + b) / 2).cast("float").alias(f"{name}_mean"),
            (a * b).cast("float").alias(f"{name}_product"),
            F.abs(a - b).cast("float").alias(f"{name}_subtraction")]


def edit_features(df: DataFrame, q: str = "query", t: str = "title", keep=("pair_id",)) -> DataFrame:
    """All §2.9 features in one Arrow pass per batch."""
    s = df.select(*keep, F.col(q).alias("_a"), F.col(t).alias("_b"),
                  edit_struct_udf(F.col(q), F.col(t)).alias("_e"))
    la, lb = F.length("_a"), F.length("_b")
    lcs = F.col("_e.lcseque_lens")
    return s.select(
        *keep,
        lcs.alias("lcseque_lens"),
        F.col("_e.lcsubstr_lens").alias("lcsubstr_lens"),
        ratio_from_lcs(lcs, la, lb).cast("float").alias("ratio"),
        ratio_padded_from_lcs(lcs, la, lb).cast("float").alias("ratio_padded"),
        F.col("_e.jaro").cast("float").alias("jaro"),
        F.col("_e.jaro_winkler").cast("float").alias("jaro_winkler"),
        F.levenshtein("_a", "_b").alias("levenshtein"),
        F.col("_e.list_dis").cast("float").alias("list_dis"),
        *combo(F.col("_e.jaro"), F.col("_e.jaro_winkler"), "jaroWinkler_jaro"))
