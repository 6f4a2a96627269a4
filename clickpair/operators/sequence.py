"""Ordered successor lookup that survives a hot group.

``lead(x) over (partition by g order by o)`` puts every row of a group into a
single task.  When one group holds a large share of all rows that task is the
whole job.  ``next_in_group`` splits each large group into ranges of the (integral)
ordering column, runs the window inside each range, and stitches the range
boundaries through a per-range summary that has one row per (group, range).
Groups of at most ``bucket_width`` rows stay whole, in the same window, so the
per-task row count is bounded by ``bucket_width`` instead of by the
group size, and small groups pay for nothing but one shuffle.
"""

from __future__ import annotations

from pyspark.ml.feature import QuantileDiscretizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hot_groups(sizes: DataFrame, groups: list[str], above: int) -> DataFrame:
    """(group columns renamed _g0.., _hot) of groups with more than ``above`` rows;
    ``sizes`` holds a row of every group for each row of it, or more.  At most
    one in ``above`` rows is such a group, so the table is broadcast."""
    return F.broadcast(sizes.groupBy(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)])
                       .agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > above)
                       .select(*[f"_g{i}" for i in range(len(groups))], F.lit(True).alias("_hot")))


def mark_hot(df: DataFrame, groups: list[str], hot: DataFrame) -> DataFrame:
    """``df`` with ``_hot``: true in the groups of ``hot``, else NULL (null-safe)."""
    same = F.lit(True)
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return df.join(hot, same, "left").drop(*[f"_g{i}" for i in range(len(groups))])


def next_in_group(df: DataFrame, group, order: str, carry: dict[str, str],
                  bucket_width: int = 1 << 16, sizes: DataFrame | None = None) -> DataFrame:
    """Add, for every row, columns of the next row (by ``order``) of its group.

    ``carry`` maps a source column to the name of the new column.  ``order``
    must be integral and unique inside a group.  The last row of a group gets
    NULLs, exactly like ``lead``.  ``sizes`` is a cheaper table with the group
    columns and at least the rows of ``df`` (default: ``df``), from which the
    groups that need ranges are counted.
    """
    groups = [group] if isinstance(group, str) else list(group)
    hot = hot_groups(df if sizes is None else sizes, groups, bucket_width)
    base = mark_hot(df, groups, hot).withColumn(
        "_rng", F.when(F.col("_hot"), F.floor(F.col(order) / F.lit(bucket_width)).cast("long")))

    # successor inside the same range
    w = Window.partitionBy(*groups, "_rng").orderBy(order)
    inner = base.withColumn("_next_o", F.lead(order).over(w))
    for src, dst in carry.items():
        inner = inner.withColumn("_in_" + dst, F.lead(src).over(w))

    # large groups: first row of every range, then the first row of the following range
    firsts = (base.where("_hot").groupBy(*groups, "_rng")
              .agg(F.min(F.struct(order, *[c for c in carry if c != order])).alias("_first")))
    wr = Window.partitionBy(*groups).orderBy("_rng")
    succ = firsts.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_rng").alias("_srng"),
                         F.lead("_first").over(wr).alias("_succ"))
    same = F.col("_rng") == F.col("_srng")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))

    out = inner.join(succ, same, "left").drop("_srng", *[f"_g{i}" for i in range(len(groups))])
    has_inner = F.col("_next_o").isNotNull()
    for src, dst in carry.items():
        out = out.withColumn(dst, F.when(has_inner, F.col("_in_" + dst))
                             .otherwise(F.col("_succ")[src]))
    return out.drop("_rng", "_hot", "_next_o", "_succ", *["_in_" + d for d in carry.values()])


#: Ranges that a uniform hash is cut into, as leading bits.
HASH_RANGE_BITS = 10


def prefix_sums(df: DataFrame, order: str, values, groups=(), n_ranges: int | None = None,
                suffix: str = "_before", hash_bits: int | None = None) -> DataFrame:
    """Exclusive running sums of ``values`` in ``order`` inside ``groups``.

    A window ordered over the whole table (or over one hot group) runs in a
    single task.  Here the ordering column is cut into ``n_ranges`` ranges
    (default: as many as shuffle partitions, so they grow with the cluster) at
    approximate quantiles (``QuantileDiscretizer``); every (group,
    range) computes local running sums, the per-(group, range) totals give
    each range its offset, and a join on (group, range) adds it back.  The
    range id is a pure function of the value (fixed splits), so every branch of the plan
    agrees on it.  Where ``order`` is a uniform hash of ``hash_bits`` bits, its
    leading bits are the range: no job runs when the plan is built, and the
    ranges do not depend on the session.  ``order`` values should be distinct
    inside a group (aggregate ties first).
    """
    values = [values] if isinstance(values, str) else list(values)
    groups = list(groups)
    n = n_ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if hash_bits:
        ranged = df.withColumn("_rid", F.shiftright(order, hash_bits - HASH_RANGE_BITS).cast("int"))
    elif n > 1:
        # n + 1 split points from approximate quantiles (one eager pass over
        # the ordering column); ranges assigned by binary search on the JVM
        qd = QuantileDiscretizer(numBuckets=n, inputCol=order, outputCol="_rid_d",
                                 relativeError=1e-4, handleInvalid="keep")
        ranged = (qd.fit(df.select(F.col(order).cast("double").alias(order))).transform(df)
                  .withColumn("_rid", F.col("_rid_d").cast("int")).drop("_rid_d"))
    else:
        ranged = df.withColumn("_rid", F.lit(0))
    local = Window.partitionBy(*groups, "_rid").orderBy(order).rowsBetween(
        Window.unboundedPreceding, -1)
    with_local = ranged.select("*", *[F.coalesce(F.sum(v).over(local), F.lit(0)).alias("_l_" + v)
                                      for v in values])
    totals = ranged.groupBy(*groups, "_rid").agg(*[F.sum(v).alias("_t_" + v) for v in values])
    prev = Window.partitionBy(*groups).orderBy("_rid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*groups, "_rid",
                            *[F.coalesce(F.sum("_t_" + v).over(prev), F.lit(0)).alias("_o_" + v)
                              for v in values])
    # null-safe: rows whose group is NULL are a group too
    named = offsets.select(F.col("_rid").alias("_orid"), *[F.col(g).alias(f"_og{i}") for i, g in enumerate(groups)],
                           *["_o_" + v for v in values])
    same = F.col("_rid") == F.col("_orid")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_og{i}"))
    out = with_local.join(named, same).drop("_orid", *[f"_og{i}" for i in range(len(groups))])
    for v in values:
        out = out.withColumn(v + suffix, F.col("_l_" + v) + F.col("_o_" + v))
    return out.drop("_rid", *["_l_" + v for v in values], *["_o_" + v for v in values])
