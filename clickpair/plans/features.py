"""The pair feature table: pair scoring jobs A-C in one plan.

Token arrays and count moments are projected once; every feature is column
arithmetic on them, so the whole table is one narrow stage over the pair
table (plus one Arrow pass when edit features are requested).  No self-join
on the pair id is needed to put features side by side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickpair.functions.text import clean_digits
from clickpair.functions.tokens import TOKEN_SET_FEATURES, token_set_columns, token_set_counts
from clickpair.operators import edit as E
from clickpair.operators import vectorspace as vs

VECTOR_SPACE_FEATURES = ["cosine_similarity", "pearson"]
EDIT_FEATURES = ["lcseque_lens", "lcsubstr_lens", "ratio", "jaro", "jaro_winkler", "levenshtein",
                 "list_dis"]


def pair_feature_table(pairs: DataFrame, keep=("pair_id", "query_id", "title_id", "label"),
                       with_edit: bool = False, clean: bool = True) -> DataFrame:
    """Pair table in; ids, label and the features out (digit-cleaned text)."""
    p = pairs
    if clean:
        p = p.withColumn("query", clean_digits("query")).withColumn("title", clean_digits("title"))
    staged = token_set_counts(p).select("*", vs.lower_tokens(F.col("query")).alias("_lq"),
                                        vs.lower_tokens(F.col("title")).alias("_lt"))
    staged = vs.add_count_moments(staged, "_lq", "_lt", prefix="_m_")
    mm = {k: F.col("_m_" + k) for k in ("sx", "sy", "sxx", "syy", "sxy", "n")}
    cos = vs.cosine_from_moments(mm["sxy"], mm["sxx"], mm["syy"])
    cols = [*keep, *token_set_columns(),  # the _m_ moments are projected, _lq/_lt dropped
            F.bround(cos, 2).cast("float").alias("cosine_similarity"),
            vs.pearson_from_moments(mm).alias("pearson")]
    if with_edit:
        cols.append(E.edit_struct_udf(F.col("query"), F.col("title")).alias("_e"))
        cols += [F.col("query").alias("_a"), F.col("title").alias("_b")]
    out = staged.select(*cols)
    if with_edit:
        la, lb = F.length("_a"), F.length("_b")
        lcs = F.col("_e.lcseque_lens")
        out = out.select(
            "*", lcs.alias("lcseque_lens"), F.col("_e.lcsubstr_lens").alias("lcsubstr_lens"),
            E.ratio_from_lcs(lcs, la, lb).cast("float").alias("ratio"),
            F.col("_e.jaro").cast("float").alias("jaro"),
            F.col("_e.jaro_winkler").cast("float").alias("jaro_winkler"),
            F.levenshtein("_a", "_b").alias("levenshtein"),
            F.col("_e.list_dis").cast("float").alias("list_dis")).drop("_e", "_a", "_b")
    out = vs.impute_mean(out, "pearson").withColumn("pearson", F.col("pearson").cast("float"))
    return out


def feature_names(with_edit: bool = False) -> list[str]:
    return TOKEN_SET_FEATURES + VECTOR_SPACE_FEATURES + (EDIT_FEATURES if with_edit else [])
