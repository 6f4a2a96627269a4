"""Registered queries: pair scoring job A (token-set features) and text prep."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickpair.functions.text import clean_digits
from clickpair.functions.tokens import token_set_features
from clickpair.plans.catalog import register
from clickpair.plans.oracle_sql import with_fixtures
from clickpair.sources.fixtures import basket_pairs

TOKEN_SET_SQL = with_fixtures("basket_pairs", """
select pair_id,
  cast(nq as int) query_len, cast(nt as int) title_len,
  cast(dq - i as int) query_unique, cast(dt - i as int) title_unique,
  cast(abs(nq - nt) as int) dif, cast(abs((dq - i) - (dt - i)) as int) dif_unique,
  cast(i as int) query_title_same_len,
  cast(nq + nt as int) q_t_all_len,
  cast(dq + dt - i as int) q_t_unique_len, cast(dq + dt - i as int) q_t_all_word_len,
  cast(dq + dt - 2 * i as int) q_t_diff_len,
  cast(dq - i as int) query_diff_title, cast(dt - i as int) title_diff_query,
  cast(i / nq as float) samelen_query_rate, cast(i / nt as float) samelen_title_rate,
  cast((dq + dt - 2 * i) / nq as float) q_t_diff_q_rate,
  cast((dq + dt - 2 * i) / nt as float) q_t_diff_t_rate,
  cast((dq - i) / nq as float) query_diff_title_q_rate,
  cast((dq - i) / nt as float) query_diff_title_t_rate,
  cast((dt - i) / nq as float) title_diff_query_q_rate,
  cast((dt - i) / nt as float) title_diff_query_t_rate,
  cast(2 * i / (dq + dt) as float) dice,
  cast(i / (dq + dt - i) as float) jaccard
from c
""", extra="""
p as (select pair_id, string_split(regexp_replace(query, '[^0-9 ]', '', 'g'), ' ') q,
             string_split(regexp_replace(title, '[^0-9 ]', '', 'g'), ' ') t from basket_pairs),
c as (select pair_id, len(q) nq, len(t) nt, len(list_distinct(q)) dq, len(list_distinct(t)) dt,
             len(list_distinct(list_filter(q, lambda x: list_contains(t, x)))) i from p)
""")


def cleaned_pairs(spark, sf_dir):
    p = basket_pairs(spark, sf_dir)
    return p.withColumn("query", clean_digits("query")).withColumn("title", clean_digits("title"))


@register("token_set_features", TOKEN_SET_SQL)
def q_token_set_features(spark, sf_dir):
    """#50-#72 on F1 after digit cleaning (the reference's feature step)."""
    return token_set_features(cleaned_pairs(spark, sf_dir))


def _pair_feature_sql() -> str:
    from clickpair.plans.catalog import ORACLE
    edit_cols = ["lcseque_lens", "lcsubstr_lens", "ratio", "jaro", "jaro_winkler", "levenshtein",
                 "list_dis"]
    return with_fixtures("basket_pairs", f"""
select b.pair_id, b.query_id, b.title_id, b.label, f.* exclude (pair_id),
       c.cosine_similarity, p.pearson, {', '.join('e.' + c for c in edit_cols)}
from basket_pairs b
join ({TOKEN_SET_SQL}) f using (pair_id)
join ({ORACLE['cosine_similarity']}) c using (pair_id)
join ({ORACLE['impute_mean']}) p using (pair_id)
join ({ORACLE['edit_features']}) e using (pair_id)""")


@register("pair_feature_table")
def q_pair_feature_table(spark, sf_dir):
    """Flagship: token-set, vector-space and edit features of every basket
    pair in one plan (jobs A-C), ids and label kept."""
    from clickpair.plans.features import pair_feature_table
    return pair_feature_table(basket_pairs(spark, sf_dir), with_edit=True)


__all__ = ["q_token_set_features", "cleaned_pairs", "F"]
