"""Registered queries: scans, cleaning, projections, scaling, slicing, sampling,
stacking, ordering (§2.1-§2.3, §2.4 #36-#37, §2.7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickpair.functions import text as TX
from clickpair.functions.tokens import TOKEN_SET_FEATURES, token_set_features
from clickpair.operators import prep
from clickpair.operators import vectorspace as vs
from clickpair.plans.catalog import register
from clickpair.plans.oracle_sql import with_fixtures
from clickpair.plans.pair_queries import TOKEN_SET_SQL, cleaned_pairs, q_token_set_features
from clickpair.plans.rate_queries import _oof_sql, clicks_folded, q_oof_rate_1key, q_oof_rate_2key
from clickpair.plans.vector_queries import COS_SQL
from clickpair.sources.fixtures import basket_pairs, clicks, dialogue_pairs
from clickpair.operators import rates

PAIR_COLS = ["query_id", "query", "title_id", "title", "label"]


@register("scan_pairs", with_fixtures("basket_pairs",
                                      "select query_id, query, title_id, title, label from basket_pairs"))
def q_scan_pairs(spark, sf_dir):
    """#1-#2 the pair table with the fixed five-column schema."""
    return basket_pairs(spark, sf_dir).select(*PAIR_COLS)


@register("clean_digits", with_fixtures("dialogue_pairs", """
select pair_id, regexp_replace(query, '[^0-9 ]', '', 'g') query,
       regexp_replace(title, '[^0-9 ]', '', 'g') title from dialogue_pairs"""))
def q_clean_digits(spark, sf_dir):
    """#9 keep only digits and spaces."""
    d = dialogue_pairs(spark, sf_dir)
    return d.select("pair_id", TX.clean_digits("query").alias("query"),
                    TX.clean_digits("title").alias("title"))


@register("strip_tab", with_fixtures("dialogue_pairs", """
select pair_id, regexp_replace(title || chr(9), '\\t$', '') title from dialogue_pairs"""))
def q_strip_tab(spark, sf_dir):
    """#10 drop one trailing tab (the raw rows end in one, as unlabelled input does)."""
    d = dialogue_pairs(spark, sf_dir)
    return d.select("pair_id", TX.strip_tab(F.concat("title", F.lit("\t"))).alias("title"))


@register("dedup_rows", with_fixtures("basket_pairs",
                                      "select distinct query, title, label from basket_pairs"))
def q_dedup_rows(spark, sf_dir):
    """#11 distinct (query, title, label) rows."""
    return prep.dedup_rows(basket_pairs(spark, sf_dir).select("query", "title", "label"))


@register("fill_missing", f"""
select pair_id, key1, fold, label, coalesce(key1_count, -1) key1_count,
       coalesce(key1_click_number, -1) key1_click_number, coalesce(key1_rate, -1) key1_rate
from ({_oof_sql(['key1'])}) o""")
def q_fill_missing(spark, sf_dir):
    """#12 missing numeric values (unseen keys of the out-of-fold rate) -> -1."""
    return prep.fill_missing(q_oof_rate_1key(spark, sf_dir), -1)


@register("concat_text", with_fixtures("dialogue_pairs", """
select pair_id, query || ' ' || title text, query || title glued from dialogue_pairs"""))
def q_concat_text(spark, sf_dir):
    """#14 ``q + ' ' + t`` and the no-separator variant."""
    d = dialogue_pairs(spark, sf_dir)
    return d.select("pair_id", TX.concat_text("query", "title").alias("text"),
                    TX.concat_text("query", "title", None).alias("glued"))


@register("tokenize", with_fixtures("dialogue_pairs", """
select pair_id, string_split(query, ' ') tokens, cast(len(string_split(query, ' ')) as int) n_tokens
from dialogue_pairs"""))
def q_tokenize(spark, sf_dir):
    """#15 ``split(' ')`` keeping empty tokens."""
    d = dialogue_pairs(spark, sf_dir)
    return d.select("pair_id", TX.tokenize("query").alias("tokens"),
                    F.size(TX.tokenize("query")).alias("n_tokens"))


@register("pad_tokens", with_fixtures("dialogue_pairs", """
select pair_id, list_slice(list_concat(string_split(query || title, ' '),
                                       list_transform(range(50), lambda x: '')), 1, 50) padded
from dialogue_pairs"""))
def q_pad_tokens(spark, sf_dir):
    """#16 first 50 tokens of the glued text, padded with the empty token."""
    d = dialogue_pairs(spark, sf_dir)
    return d.select("pair_id", TX.pad_tokens(TX.tokenize(TX.concat_text("query", "title", None)))
                    .alias("padded"))


@register("select_rename_drop", with_fixtures("basket_pairs", """
select pair_id, query_id, query q, title t, label from basket_pairs"""))
def q_select_rename_drop(spark, sf_dir):
    """#17 drop a column and rename two."""
    return prep.select_rename_drop(basket_pairs(spark, sf_dir), {"query": "q", "title": "t"},
                                   drop=["title_id"])


_SCALE_COLS = ["query_len", "title_len", "query_title_same_len", "dice", "jaccard"]


@register("minmax_scale", f"""
select pair_id, {', '.join(f"coalesce((cast({c} as double) - min({c}) over ()) / nullif(cast(max({c}) over () as double) - min({c}) over (), 0), -1.0) {c}" for c in _SCALE_COLS)}
from ({TOKEN_SET_SQL}) f""")
def q_minmax_scale(spark, sf_dir):
    """#18 min-max scaling of token features; constant columns -> -1."""
    f = q_token_set_features(spark, sf_dir).select("pair_id", *_SCALE_COLS)
    return prep.minmax_scale(f, _SCALE_COLS)


@register("column_minmax", f"""
select {', '.join(f"min({c}) {c}_min, max({c}) {c}_max" for c in TOKEN_SET_FEATURES)}
from ({TOKEN_SET_SQL}) f""")
def q_column_minmax(spark, sf_dir):
    """#36 per-column min and max of the token features."""
    return prep.column_minmax(q_token_set_features(spark, sf_dir), TOKEN_SET_FEATURES)


@register("filter_predictors", f"""
select * exclude (query_len, title_len, q_t_all_word_len) from ({TOKEN_SET_SQL}) f""")
def q_filter_predictors(spark, sf_dir):
    """#21 keep the columns not on an exclusion list."""
    return prep.filter_predictors(q_token_set_features(spark, sf_dir),
                                  ["query_len", "title_len", "q_t_all_word_len"])


@register("split_by_position", with_fixtures("basket_pairs", """
select pair_id, case when row_number() over (order by pair_id) <= 15000 then 'train' else 'test' end split
from basket_pairs"""))
def q_split_by_position(spark, sf_dir):
    """#19 first 15,000 rows by id are train, the rest test."""
    return prep.split_by_position(basket_pairs(spark, sf_dir).select("pair_id"), "pair_id", 15000)


@register("slice_rows", with_fixtures("clicks", """
select pair_id, key1, key2, label, chunk from (
  select *, cast((row_number() over (order by pair_id) - 1) // 1000 as bigint) chunk from clicks)
where chunk in (0, 9)"""))
def q_slice_rows(spark, sf_dir):
    """#3 chunks of 1,000 events in id order; keep the first and the tenth."""
    return prep.slice_rows(clicks(spark, sf_dir), "pair_id", 1000, (0, 9))


@register("sample_rows", with_fixtures("basket_pairs", """
select pair_id, query, title, label from basket_pairs
order by md5('2019:' || cast(pair_id as varchar)), pair_id limit 1000"""))
def q_sample_rows(spark, sf_dir):
    """#20 1,000 pairs without replacement, reproducible by seed."""
    return prep.sample_rows(basket_pairs(spark, sf_dir).select("pair_id", "query", "title", "label"),
                            1000, "pair_id", 2019)


@register("avg_predictions", f"""
select pair_id, avg(prediction) prediction, count(prediction) n_models from (
  select pair_id, key1_rate prediction from ({_oof_sql(['key1'])}) a
  union all
  select pair_id, key1_key2_rate prediction from ({_oof_sql(['key1', 'key2'])}) b)
group by pair_id""")
def q_avg_predictions(spark, sf_dir):
    """#37 mean of two models' predictions (user rate, user-hour rate) per event."""
    a = q_oof_rate_1key(spark, sf_dir).select("pair_id", F.col("key1_rate").alias("prediction"))
    b = q_oof_rate_2key(spark, sf_dir).select("pair_id", F.col("key1_key2_rate").alias("prediction"))
    stacked = prep.union_all([a, b])
    return stacked.groupBy("pair_id").agg(F.avg("prediction").alias("prediction"),
                                          F.count("prediction").alias("n_models"))


@register("sort_by_index", with_fixtures("basket_pairs",
                                         "select pair_id, query, title from basket_pairs order by pair_id"))
def q_sort_by_index(spark, sf_dir):
    """#47 rows in id order."""
    return prep.sort_by_index(basket_pairs(spark, sf_dir).select("pair_id", "query", "title"))


@register("limit_rows", with_fixtures("basket_pairs", """
select pair_id, query, title, label from basket_pairs order by pair_id limit 20001"""))
def q_limit_rows(spark, sf_dir):
    """#48 the first 20,001 rows in id order (the export's stop rule)."""
    return prep.limit_rows(basket_pairs(spark, sf_dir).select("pair_id", "query", "title", "label"),
                           20001)


@register("union_all", with_fixtures(["basket_pairs", "dialogue_pairs"], """
select * from basket_pairs union all by name select * from dialogue_pairs"""))
def q_union_all(spark, sf_dir):
    """#49 stack two pair tables by column name."""
    return prep.union_all([basket_pairs(spark, sf_dir), dialogue_pairs(spark, sf_dir)])


@register("column_bind", f"""
select f.pair_id, f.jaccard, f.dice, c.cosine_similarity
from ({TOKEN_SET_SQL}) f join ({COS_SQL}) c using (pair_id)""")
def q_column_bind(spark, sf_dir):
    """#24 side-by-side features of two jobs joined on the pair id."""
    a = q_token_set_features(spark, sf_dir).select("pair_id", "jaccard", "dice")
    b = vs.vector_space_features(cleaned_pairs(spark, sf_dir)).select("pair_id", "cosine_similarity")
    return a.join(b, "pair_id")


__all__ = ["rates", "clicks_folded", "token_set_features"]
