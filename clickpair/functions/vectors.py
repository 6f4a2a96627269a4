"""Distances between two ``ARRAY<DOUBLE>`` columns.

The family is a table of sums and extremes over the paired elements and of
closed forms over them: one pass gives all sums of a row.  Rows whose elements
are all positive numbers are summed by numpy, a batch at a time; the others by
one native ``aggregate``, which also says what zeros, NULLs and NaN give.
Formulas are kept exactly as the reference codes them (for example Sorensen is
signed and Soergel uses ``Σx − n·min(y)`` as denominator).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(v) -> Column:
    return F.transform(_c(v), lambda e: e.cast("double"))


def minmax_shift(v) -> Column:
    """``(v − min)/(max − min) + 1`` per vector; NULL for a constant vector.

    min and max come from one ``aggregate`` pass and reach the rescaling
    lambda as variables of the finish function: an array-level expression
    written inside a lambda would be re-evaluated for every element.
    """
    v = as_double(v)
    init = F.struct(F.lit(float("inf")).alias("lo"), F.lit(float("-inf")).alias("hi"))

    def step(acc, e):
        return F.struct(F.least(acc["lo"], e).alias("lo"), F.greatest(acc["hi"], e).alias("hi"))

    def finish(acc):
        lo, hi = acc["lo"], acc["hi"]
        return F.when(hi > lo, F.transform(v, lambda e: (e - lo) / (hi - lo) + 1))

    return F.aggregate(v, init, step, finish)


def _sum(x, y, f) -> Column:
    return F.aggregate(F.zip_with(x, y, f), F.lit(0.0), lambda a, b: a + b)


def _sum1(x, f) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, e: a + f(e))


def dot(x, y) -> Column:
    return _sum(x, y, lambda a, b: a * b)


def norm(x) -> Column:
    return F.sqrt(_sum1(x, lambda e: e * e))


def cosine(x, y) -> Column:
    nx, ny = norm(x), norm(y)
    return F.when((nx != 0) & (ny != 0), dot(x, y) / (nx * ny)).otherwise(F.lit(0.0))


# Sums over the paired elements (a, b) that the distances are made of.
SUMS: dict[str, Callable[[Column, Column], Column]] = {
    "xy": lambda a, b: a * b,
    "xx": lambda a, b: a * a,
    "yy": lambda a, b: b * b,
    "x": lambda a, b: a,
    "plus": lambda a, b: a + b,
    "minus": lambda a, b: a - b,
    "gap": lambda a, b: F.abs(a - b),
    "square": lambda a, b: (a - b) * (a - b),
    "larger": lambda a, b: F.greatest(a, b),
    "smaller": lambda a, b: F.least(a, b),
    "share": lambda a, b: F.abs(a - b) / F.greatest(a, b),
    "kl": lambda a, b: a * F.log(a / b),
    "both_kl": lambda a, b: (a - b) * F.log(a / b),
    "x_mid": lambda a, b: a * F.log(2 * a / (a + b)),
    "y_mid": lambda a, b: b * F.log(2 * b / (a + b)),
    "entropy": lambda a, b: (a * F.log(a) + b * F.log(b)) - ((a + b) / 2) * F.log((a + b) / 2),
}
# Extremes over the paired elements: (value, which one is kept).
EXTREMES = {
    "widest": (lambda a, b: F.abs(a - b), F.greatest),
    "least_y": (lambda a, b: b, F.least),
}


#: ``SUMS`` and ``EXTREMES`` over the rows of matrices of positive numbers.
BATCH_SUMS = {
    "xy": lambda a, b: a * b,
    "xx": lambda a, b: a * a,
    "yy": lambda a, b: b * b,
    "x": lambda a, b: a,
    "plus": lambda a, b: a + b,
    "minus": lambda a, b: a - b,
    "gap": lambda a, b: np.abs(a - b),
    "square": lambda a, b: (a - b) * (a - b),
    "larger": np.maximum,
    "smaller": np.minimum,
    "share": lambda a, b: np.abs(a - b) / np.maximum(a, b),
    "kl": lambda a, b: a * np.log(a / b),
    "both_kl": lambda a, b: (a - b) * np.log(a / b),
    "x_mid": lambda a, b: a * np.log(2 * a / (a + b)),
    "y_mid": lambda a, b: b * np.log(2 * b / (a + b)),
    "entropy": lambda a, b: (a * np.log(a) + b * np.log(b)) - ((a + b) / 2) * np.log((a + b) / 2),
}
BATCH_EXTREMES = {"widest": lambda a, b: np.abs(a - b).max(axis=1), "least_y": lambda a, b: b.min(axis=1)}
#: Elements of one side that numpy works on at once.
BATCH_ELEMENTS = 1 << 17


def _over_norms(s):
    nx, ny = F.sqrt(s["xx"]), F.sqrt(s["yy"])
    return F.when((nx != 0) & (ny != 0), s["xy"] / (nx * ny)).otherwise(F.lit(0.0))


# name -> (sums it needs, f(sums, number of components)); the reference
# computes the first three twice under two names (city block = manhattan
# etc.), they are aliases here.
DISTANCES: dict[str, tuple[tuple[str, ...], Callable]] = {
    "cosine_w2v": (("xy", "xx", "yy"), lambda s, n: _over_norms(s)),
    "manhattan": (("gap",), lambda s, n: s["gap"]),
    "euclidean": (("square",), lambda s, n: F.sqrt(s["square"])),
    "chebyshev": (("widest",), lambda s, n: s["widest"]),
    "sorensen": (("minus", "plus"), lambda s, n: F.try_divide(s["minus"], s["plus"])),
    "gower": (("gap",), lambda s, n: s["gap"] / n),
    # sum over i of max over j of (x_i - y_j) = sum of x - n * min(y)
    "soergel": (("gap", "x", "least_y"), lambda s, n: F.try_divide(s["gap"], s["x"] - n * s["least_y"])),
    "intersection": (("gap",), lambda s, n: s["gap"] / 2),
    "wave_hedges": (("share",), lambda s, n: s["share"]),
    "czekanowski": (("gap", "plus"), lambda s, n: F.try_divide(s["gap"], s["plus"])),
    "motyka": (("larger", "plus"), lambda s, n: F.try_divide(s["larger"], s["plus"])),
    "kulczynski": (("smaller", "plus"), lambda s, n: F.try_divide(s["smaller"], s["plus"])),
    "ruzicka": (("smaller", "larger"), lambda s, n: F.try_divide(s["smaller"], s["larger"])),
    "kullback_leibler": (("kl",), lambda s, n: s["kl"]),
    "jeffreys": (("both_kl",), lambda s, n: s["both_kl"]),
    "k_divergence": (("x_mid",), lambda s, n: s["x_mid"]),
    "topsoe": (("x_mid", "y_mid"), lambda s, n: s["x_mid"] + s["y_mid"]),
    "jensen_shannon": (("x_mid", "y_mid"), lambda s, n: (s["x_mid"] + s["y_mid"]) / 2),
    "jensen_difference": (("entropy",), lambda s, n: s["entropy"]),
}
ALIASES = {"city_block": "manhattan"}


def pair_sums(x, y, names) -> Column:
    """Struct of the named sums and extremes, from one pass over the pair."""
    init = F.struct(*[F.lit(None if k in EXTREMES else 0.0).cast("double").alias(k) for k in names])

    def step(acc, e):
        a, b = e["a"], e["b"]
        return F.struct(*[(EXTREMES[k][1](acc[k], EXTREMES[k][0](a, b)) if k in EXTREMES
                           else acc[k] + SUMS[k](a, b)).alias(k) for k in names])

    pairs = F.zip_with(_c(x), _c(y), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.aggregate(pairs, init, step)


def positive_sums(x: pa.Array, y: pa.Array, names) -> pa.StructArray:
    """``pair_sums`` of the rows whose vectors are equally long, not empty and of
    positive finite numbers; NULL for the others."""
    out, none = np.zeros((len(names), len(x))), np.ones(len(x), bool)
    lens = [pc.fill_null(pc.list_value_length(v), 0).to_numpy() for v in (x, y)]
    size = np.where(lens[0] == lens[1], lens[0], 0)
    first = [np.concatenate(([0], np.cumsum(n))) for n in lens]
    flat = [pc.fill_null(v.flatten(), np.nan).to_numpy() for v in (x, y)]
    for n in np.unique(size[size > 0]):
        rows = np.flatnonzero(size == n)
        step = max(1, BATCH_ELEMENTS // int(n))
        for lo in range(0, len(rows), step):
            at = rows[lo:lo + step]
            a, b = (v[f[at][:, None] + np.arange(n)] for v, f in zip(flat, first))
            fine = np.isfinite(a).all(axis=1) & np.isfinite(b).all(axis=1) & (a > 0).all(axis=1) & (b > 0).all(axis=1)
            at, a, b = at[fine], a[fine], b[fine]
            none[at] = False
            for i, k in enumerate(names):
                out[i, at] = BATCH_EXTREMES[k](a, b) if k in EXTREMES else BATCH_SUMS[k](a, b).sum(axis=1)
    return pa.StructArray.from_arrays([pa.array(v) for v in out], names=list(names), mask=pa.array(none))


def with_distances(df: DataFrame, x: str, y: str, names=None, keep=()) -> DataFrame:
    """Columns ``keep`` and one per distance (all of them by default).

    The sums that the distances share are computed once per row, in one pass
    over the two vectors; NULL vectors give NULL (cosine: 0)."""
    names = list(names or DISTANCES)
    needs = sorted({k for n in names for k in DISTANCES[ALIASES.get(n, n)][0]})
    s = F.col("_sums")
    batch = F.arrow_udf(lambda a, b: positive_sums(a, b, needs), T.StructType([T.StructField(k, T.DoubleType()) for k in needs]))
    rows = df.select(*keep, as_double(x).alias("_x"), as_double(y).alias("_y"))
    return rows.select(*keep, F.size("_x").alias("_size"),
                       F.coalesce(batch("_x", "_y"), pair_sums("_x", "_y", needs)).alias("_sums")).select(
        *keep, *[DISTANCES[ALIASES.get(n, n)][1](s, F.col("_size")).alias(n) for n in names])
