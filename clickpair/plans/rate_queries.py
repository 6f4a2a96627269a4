"""Registered queries: click-rate encodings (§2.4), key joins (§2.3), counts (§2.6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickpair.operators import rates
from clickpair.operators.grouping import group_titles, token_counts
from clickpair.plans.catalog import register
from clickpair.plans.oracle_sql import with_fixtures
from clickpair.sources.fixtures import basket_pairs, clicks, labelled_docs

# Deterministic folds for oracle runs (FIXTURES.md): pair_id % 5.
K = 5


def clicks_folded(spark, sf_dir):
    return clicks(spark, sf_dir).withColumn("fold", F.col("pair_id") % K)


# ---------------------------------------------------------------- SQL helpers
def _stats_sql(src: str, keys: list[str]) -> str:
    p = "_".join(keys)
    k = ", ".join(keys)
    nn = " and ".join(f"{x} is not null" for x in keys)
    return (f"select {k}, count(*) {p}_count, avg(label) {p}_rate, "
            f"cast(sum(label) as bigint) {p}_click_number from {src} where {nn} group by {k}")


def _rate_table_sql(src: str, keys: list[str]) -> str:
    p = "_".join(keys)
    k = ", ".join(f"s.{x}" for x in keys)
    return f"""
(with s as ({_stats_sql(src, keys)}),
      pr as (select avg({p}_rate) m, var_samp({p}_rate) v from s),
      ab as (select m / nullif(v, 0) * (m * (1 - m) - v) a,
                    (1 - m) / nullif(v, 0) * (m * (1 - m) - v) b from pr)
 select {k}, s.{p}_count, s.{p}_click_number,
        (s.{p}_click_number + a) / nullif(s.{p}_count + a + b, 0) {p}_rate
 from s cross join ab)"""


def _oof_sql(keys: list[str], fixture: str = "clicks",
             base: str = "select pair_id, key1, key2, label, pair_id % 5 fold from clicks") -> str:
    p = "_".join(keys)
    k = ", ".join(keys)
    tk = ", ".join(f"t.{x}" for x in keys)
    on = " and ".join(f"t.{x} = s.{x}" for x in keys)
    nn = " and ".join(f"{x} is not null" for x in keys)
    sel = ", ".join(f"f4.{x}" for x in keys)
    return with_fixtures(fixture, f"""
select f4.pair_id, {sel}, f4.fold, f4.label,
       oo.n {p}_count, oo.c {p}_click_number,
       (oo.c + a) / nullif(oo.n + a + b, 0) {p}_rate
from f4 left join oo using ({k}, fold) left join ab using (fold)
""", extra=f"""
f4 as ({base}),
s as (select {k}, fold, count(*) n, cast(sum(label) as bigint) c from f4 where {nn} group by {k}, fold),
t as (select {k}, sum(n) n, sum(c) c from s group by {k}),
o as (select {tk}, f.fold, cast(t.n - coalesce(s.n, 0) as bigint) n, cast(t.c - coalesce(s.c, 0) as bigint) c
      from t cross join (select unnest(range(5)) fold) f
      left join s on {on} and s.fold = f.fold),
oo as (select * from o where n > 0),
pr as (select fold, avg(c / n::double) m, var_samp(c / n::double) v from oo group by fold),
ab as (select fold, m / nullif(v, 0) * (m * (1 - m) - v) a,
              (1 - m) / nullif(v, 0) * (m * (1 - m) - v) b from pr)
""")


# ------------------------------------------------------------ statistics
@register("key_label_stats", with_fixtures("clicks", _stats_sql("clicks", ["key1"])))
def q_key_label_stats(spark, sf_dir):
    """#26 per user: count, mean label, clicks."""
    return rates.key_label_stats(clicks(spark, sf_dir), "key1")


@register("cross_label_stats", with_fixtures("clicks", _stats_sql("clicks", ["key1", "key2"])))
def q_cross_label_stats(spark, sf_dir):
    """#27 per (user, hour) for the one pair of the key list [key1, key2]."""
    return rates.cross_label_stats(clicks(spark, sf_dir), ["key1", "key2"])["key1_key2"]


@register("bayes_prior", with_fixtures("clicks", """
select m prior_mean, v prior_var,
       m / nullif(v, 0) * (m * (1 - m) - v) alpha, (1 - m) / nullif(v, 0) * (m * (1 - m) - v) beta
from (select avg(key1_rate) m, var_samp(key1_rate) v from s)""",
                                          extra=f"s as ({_stats_sql('clicks', ['key1'])})"))
def q_bayes_prior(spark, sf_dir):
    """#28 one-row prior over per-user rates."""
    return rates.bayes_prior(rates.key_label_stats(clicks(spark, sf_dir), "key1"), "key1_rate")


@register("smoothed_rate", with_fixtures("clicks", "select * from r",
                                         extra=f"r as {_rate_table_sql('clicks', ['key1'])}"))
def q_smoothed_rate(spark, sf_dir):
    """#29 full-train smoothed rate table per user."""
    return rates.rate_table(clicks(spark, sf_dir), "key1")


# ------------------------------------------------------------ out-of-fold
@register("oof_rate_1key", _oof_sql(["key1"]))
def q_oof_rate_1key(spark, sf_dir):
    """#30 leave-one-fold-out smoothed rate per user."""
    df = clicks_folded(spark, sf_dir)
    return rates.oof_rate(df, "key1", "fold", k=K).select(
        "pair_id", "key1", "fold", "label", "key1_count", "key1_click_number", "key1_rate")


@register("oof_rate_2key", _oof_sql(["key1", "key2"]))
def q_oof_rate_2key(spark, sf_dir):
    """#31 leave-one-fold-out smoothed rate per (user, hour)."""
    df = clicks_folded(spark, sf_dir)
    return rates.oof_rate(df, ["key1", "key2"], "fold", k=K).select(
        "pair_id", "key1", "key2", "fold", "label",
        "key1_key2_count", "key1_key2_click_number", "key1_key2_rate")


# ------------------------------------------------------------ apply to rows
def _apply_sql(keys, src="clicks", cols="c.pair_id, c.key1, c.key2, c.label"):
    p = "_".join(keys)
    return with_fixtures(src, f"""
select {cols}, r.{p}_count, r.{p}_click_number, r.{p}_rate
from {src} c left join r using ({', '.join(keys)})""",
                         extra=f"r as {_rate_table_sql(src, keys)}")


@register("apply_rate_1key", _apply_sql(["key1"]))
def q_apply_rate_1key(spark, sf_dir):
    """#32 full-train rate per user joined to every event row."""
    c = clicks(spark, sf_dir)
    return rates.apply_rate(c, c, "key1").select(
        "pair_id", "key1", "key2", "label", "key1_count", "key1_click_number", "key1_rate")


@register("apply_rate_2key", _apply_sql(["key1", "key2"]))
def q_apply_rate_2key(spark, sf_dir):
    """#33 full-train rate per (user, hour) joined to every event row."""
    c = clicks(spark, sf_dir)
    return rates.apply_rate(c, c, ["key1", "key2"]).select(
        "pair_id", "key1", "key2", "label", "key1_key2_count", "key1_key2_click_number",
        "key1_key2_rate")


@register("rate_join_1key", _apply_sql(["query"], "basket_pairs", "c.pair_id, c.query, c.label"))
def q_rate_join_1key(spark, sf_dir):
    """#22 pair table left-joined with the rate table of the query text."""
    b = basket_pairs(spark, sf_dir)
    return rates.apply_rate(b, b, "query").select(
        "pair_id", "query", "label", "query_count", "query_click_number", "query_rate")


@register("rate_join_2key", _apply_sql(["query", "title"], "basket_pairs",
                                       "c.pair_id, c.query, c.title, c.label"))
def q_rate_join_2key(spark, sf_dir):
    """#23 pair table left-joined with the rate table of (query, title)."""
    b = basket_pairs(spark, sf_dir)
    return rates.apply_rate(b, b, ["query", "title"]).select(
        "pair_id", "query", "title", "label", "query_title_count", "query_title_click_number",
        "query_title_rate")


# ------------------------------------------------------------ per-key counts
def _count_sql(keys, name):
    return with_fixtures("basket_pairs", f"""
select pair_id, {', '.join(keys)}, count(*) over (partition by {', '.join(keys)}) {name}
from basket_pairs""")


def _count_query(keys, name):
    def q(spark, sf_dir):
        b = basket_pairs(spark, sf_dir).select("pair_id", *keys)
        return rates.attach_counts(b, keys, name)
    return q


register("query_count", _count_sql(["query"], "query_count"))(
    _count_query(["query"], "query_count"))
register("title_count", _count_sql(["title"], "title_count"))(
    _count_query(["title"], "title_count"))
register("query_label_click", _count_sql(["query", "label"], "query_label_click"))(
    _count_query(["query", "label"], "query_label_click"))
register("title_label_click", _count_sql(["title", "label"], "title_label_click"))(
    _count_query(["title", "label"], "title_label_click"))


# ------------------------------------------------------------ grouping
@register("group_titles", with_fixtures("basket_pairs", """
select q.query_id, q.query, g.title_concat, q.label
from q left join g using (query_id)""", extra="""
t as (select query_id, title, min(pair_id) pos from basket_pairs where title is not null group by 1, 2),
g as (select query_id, string_agg(title, ' ' order by pos) title_concat from t group by 1),
q as (select query_id, arg_min(query, pair_id) query, cast(max(label) as int) label
      from basket_pairs group by 1)"""))
def q_group_titles(spark, sf_dir):
    """#34 titles of each query id in order of first appearance."""
    return group_titles(basket_pairs(spark, sf_dir))


@register("token_counts", with_fixtures("basket_pairs", """
select pair_id, token, cast(count(*) as int) n
from (select pair_id, unnest(string_split(title, ' ')) token from basket_pairs)
group by pair_id, token"""))
def q_token_counts(spark, sf_dir):
    """#35 token frequencies of every title."""
    return token_counts(basket_pairs(spark, sf_dir), "title")


# ------------------------------------------------------------ documents
_DOC_BASE = "select pair_id, source, lang, label, pair_id % 5 fold from labelled_docs"


@register("doc_source_rate", _oof_sql(["source"], "labelled_docs", _DOC_BASE))
def q_doc_source_rate(spark, sf_dir):
    """#30 on labelled documents: leave-one-fold-out quality rate per source."""
    d = labelled_docs(spark, sf_dir).withColumn("fold", F.col("pair_id") % K)
    return rates.oof_rate(d, "source", "fold", k=K).select(
        "pair_id", "source", "fold", "label", "source_count", "source_click_number", "source_rate")


@register("doc_source_lang_rate", _oof_sql(["source", "lang"], "labelled_docs", _DOC_BASE))
def q_doc_source_lang_rate(spark, sf_dir):
    """#31 on labelled documents: leave-one-fold-out quality rate per (source, lang)."""
    d = labelled_docs(spark, sf_dir).withColumn("fold", F.col("pair_id") % K)
    return rates.oof_rate(d, ["source", "lang"], "fold", k=K).select(
        "pair_id", "source", "lang", "fold", "label",
        "source_lang_count", "source_lang_click_number", "source_lang_rate")
