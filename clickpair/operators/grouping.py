"""Per-query grouping of titles and per-text token counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickpair.functions.text import tokenize


def _ordered_join(items_col: str, sep: str) -> F.Column:
    # items are struct(pos, text); sort by pos and join the texts
    return F.array_join(F.transform(F.array_sort(F.collect_list(items_col)), lambda s: s["txt"]), sep)


def group_titles(df: DataFrame, group: str = "query_id", query: str = "query",
                 title: str = "title", pos: str = "pair_id", label: str = "label",
                 sep: str = " ", bucket_width: int = 1 << 12) -> DataFrame:
    """Per group: first query text, its distinct titles in order of first
    appearance joined by ``sep``, and ``max(label)``.

    Titles are first reduced to (group, title, first position) with a partial
    aggregate, so a group that repeats titles never materialises the repeats.
    The string is then built in two levels: pieces per (group, position
    range), then the pieces per group, so no single list is larger than the
    output row itself.
    """
    firsts = (df.where(F.col(title).isNotNull())
              .groupBy(group, title).agg(F.min(pos).alias("_p")))
    pieces = (firsts.withColumn("_r", F.floor(F.col("_p") / F.lit(bucket_width)))
              .withColumn("_it", F.struct(F.col("_p").alias("pos"), F.col(title).alias("txt")))
              .groupBy(group, "_r")
              .agg(F.struct(F.min("_p").alias("pos"),
                            _ordered_join("_it", sep).alias("txt")).alias("_piece")))
    concat = pieces.groupBy(group).agg(_ordered_join("_piece", sep).alias("title_concat"))
    head = df.groupBy(group).agg(F.min_by(query, pos).alias(query),
                                 F.max(label).cast("int").alias(label))
    return head.join(concat, group, "left").select(group, query, "title_concat", label)


def token_counts(df: DataFrame, text: str, keep=("pair_id",)) -> DataFrame:
    """(keep..., token, n) per distinct token of ``split(text, ' ')``.

    Counted inside the row (no shuffle): all tokens of a text live in one
    row already; sorting and run lengths make it O(n log n) per text.  The
    outer explode keeps Spark from filtering on the size of the runs first,
    which would work them out once more for every token; rows without text go
    after it.
    """
    from clickpair.operators.vectorspace import add_run_counts
    staged = add_run_counts(df.select(*keep, tokenize(text).alias("_toks")), "_toks", "_runs")
    return (staged.select(*keep, F.explode_outer("_runs").alias("_tc")).where("_tc.token is not null")
            .select(*keep, F.col("_tc.token").alias("token"), F.col("_tc.n").alias("n")))
