"""Token-set features of a (query, title) pair as native array expressions.

Tokens come from ``split(' ')`` and the sets include the empty token.  The
plan is staged so each array is built once per row: tokens, then the five
counts every feature derives from (nq, nt, |Q|, |T|, |Q∩T|), then the
features as integer arithmetic.  All of it stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickpair.functions.text import tokenize

INT_FEATURES = [
    "query_len", "title_len", "query_unique", "title_unique", "dif", "dif_unique",
    "query_title_same_len", "q_t_all_len", "q_t_unique_len", "q_t_all_word_len",
    "q_t_diff_len", "query_diff_title", "title_diff_query",
]
RATE_FEATURES = [
    "samelen_query_rate", "samelen_title_rate", "q_t_diff_q_rate", "q_t_diff_t_rate",
    "query_diff_title_q_rate", "query_diff_title_t_rate",
    "title_diff_query_q_rate", "title_diff_query_t_rate", "dice", "jaccard",
]
TOKEN_SET_FEATURES = INT_FEATURES + RATE_FEATURES


def _rate(num: Column, den: Column) -> Column:
    # computed in double, stored as float like the reference's float32 columns
    return (num.cast("double") / den).cast("float")


def token_set_counts(df: DataFrame, q: str = "query", t: str = "title") -> DataFrame:
    """Append ``_nq _nt _dq _dt _i`` (lengths, distinct sizes, intersection)."""
    tok = df.withColumn("_qt", tokenize(q)).withColumn("_tt", tokenize(t))
    return (tok.withColumn("_nq", F.size("_qt")).withColumn("_nt", F.size("_tt"))
            .withColumn("_dq", F.size(F.array_distinct("_qt")))
            .withColumn("_dt", F.size(F.array_distinct("_tt")))
            .withColumn("_i", F.size(F.array_intersect("_qt", "_tt")))
            .drop("_qt", "_tt"))


def token_set_columns() -> list[Column]:
    nq, nt, dq, dt, i = (F.col(c) for c in ("_nq", "_nt", "_dq", "_dt", "_i"))
    qu, tu = dq - i, dt - i           # |Q-T|, |T-Q|
    union = dq + dt - i               # |Q∪T|
    sym = qu + tu                     # |Q△T|
    cols = {
        "query_len": nq,
        "title_len": nt,
        "query_unique": qu,
        "title_unique": tu,
        "dif": F.abs(nq - nt),
        "dif_unique": F.abs(qu - tu),
        "query_title_same_len": i,
        "q_t_all_len": nq + nt,
        "q_t_unique_len": union,
        "q_t_all_word_len": union,
        "q_t_diff_len": sym,
        "query_diff_title": qu,
        "title_diff_query": tu,
        "samelen_query_rate": _rate(i, nq),
        "samelen_title_rate": _rate(i, nt),
        "q_t_diff_q_rate": _rate(sym, nq),
        "q_t_diff_t_rate": _rate(sym, nt),
        "query_diff_title_q_rate": _rate(qu, nq),
        "query_diff_title_t_rate": _rate(qu, nt),
        "title_diff_query_q_rate": _rate(tu, nq),
        "title_diff_query_t_rate": _rate(tu, nt),
        "dice": _rate(2 * i, dq + dt),
        "jaccard": _rate(i, union),
    }
    return [cols[k].cast("int").alias(k) if k in INT_FEATURES else cols[k].alias(k)
            for k in TOKEN_SET_FEATURES]


def token_set_features(df: DataFrame, q: str = "query", t: str = "title",
                       keep: tuple[str, ...] = ("pair_id",)) -> DataFrame:
    """Pair table in, ``keep`` columns + the 23 token-set features out."""
    return token_set_counts(df, q, t).select(*keep, *token_set_columns())
