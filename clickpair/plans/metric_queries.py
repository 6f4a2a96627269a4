"""Registered queries: evaluation metrics (§2.5).

Scores come from the data itself: the out-of-fold user click rate predicts
the click label of an event (F4), and the token Jaccard of a basket pair
scores its label inside each customer (F1).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from clickpair.functions.tokens import token_set_features
from clickpair.operators import metrics as M
from clickpair.plans.catalog import register
from clickpair.plans.oracle_sql import with_fixtures
from clickpair.plans.pair_queries import cleaned_pairs
from clickpair.plans.rate_queries import _oof_sql, q_oof_rate_1key
from clickpair.sources.fixtures import vector_pairs

_OOF = _oof_sql(["key1"])


def _oof_scored(spark, sf_dir):
    return q_oof_rate_1key(spark, sf_dir).select("pair_id", "label", F.col("key1_rate").alias("score"))


@register("auc", f"""
with sc as (select key1_rate score, sum(label) pos, sum(1 - label) neg
            from ({_OOF}) o where key1_rate is not null group by key1_rate),
ps as (select *, coalesce(sum(neg) over (order by score rows between unbounded preceding
                                          and 1 preceding), 0) nb from sc)
select sum(pos * (nb + neg / 2.0)) / nullif(sum(pos) * sum(neg), 0) auc,
       cast(sum(pos) as bigint) n_pos, cast(sum(neg) as bigint) n_neg from ps""")
def q_auc(spark, sf_dir):
    """#38 ROC AUC of the out-of-fold user rate for the click label."""
    return M.auc(_oof_scored(spark, sf_dir), "score", "label")


@register("log_loss", f"""
select avg(-(label * ln(p) + (1 - label) * ln(1 - p))) log_loss, count(*) n
from (select label, least(greatest(key1_rate, 1e-15), 1 - 1e-15) p
      from ({_OOF}) o where key1_rate is not null)""")
def q_log_loss(spark, sf_dir):
    """#40 binary log loss of the out-of-fold user rate."""
    d = _oof_scored(spark, sf_dir).withColumnRenamed("score", "prob")
    return M.log_loss(d, "prob", "label")


@register("accuracy", f"""
select avg(cast(cast(key1_rate > 0.5 as int) = label as double)) accuracy, count(*) n
from ({_OOF}) o where label is not null""")
def q_accuracy(spark, sf_dir):
    """#41 share of rows whose thresholded rate equals the label (NULL rate = miss)."""
    d = _oof_scored(spark, sf_dir).withColumn("pred", (F.col("score") > 0.5).cast("int"))
    return M.accuracy(d, "pred", "label")


@register("q_auc", with_fixtures("basket_pairs", """
select avg(case when p > 0 and n > 0 then u / (p * n) else 0.5 end) q_auc,
       cast(sum(case when p > 0 and n > 0 then 0 else 1 end) as bigint) invalid_count,
       count(*) n_groups
from g""", extra="""
tp as (select pair_id, query_id, label,
              string_split(regexp_replace(query, '[^0-9 ]', '', 'g'), ' ') q,
              string_split(regexp_replace(title, '[^0-9 ]', '', 'g'), ' ') t from basket_pairs),
tc as (select query_id, label, len(list_distinct(q)) dq, len(list_distinct(t)) dt,
              len(list_distinct(list_filter(q, lambda x: list_contains(t, x)))) i from tp),
f as (select query_id, label, cast(i / (dq + dt - i) as float) score from tc),
sc as (select query_id, score, sum(label) pos, sum(1 - label) neg from f group by 1, 2),
ps as (select *, coalesce(sum(neg) over (partition by query_id order by score
                  rows between unbounded preceding and 1 preceding), 0) nb from sc),
g as (select query_id, sum(pos * (nb + neg / 2.0)) u, sum(pos) p, sum(neg) n from ps group by 1)"""))
def q_q_auc(spark, sf_dir):
    """#39 mean per-customer AUC of the Jaccard score for the basket label."""
    pairs = cleaned_pairs(spark, sf_dir)
    scored = token_set_features(pairs, keep=("pair_id", "query_id", "label")) \
        .select("pair_id", "query_id", "label", F.col("jaccard").alias("score"))
    return M.q_auc(scored, "query_id", "score", "label")


@register("contrastive_loss", with_fixtures("vector_pairs", """
select avg((1 - label) * d * d + label * pow(greatest(2.0 - d, 0.0), 2)) contrastive_loss, count(*) n
from (select label, sqrt(list_sum(list_transform(range(1, len(x_raw) + 1), lambda i:
          (x_raw[i]::double - y_raw[i]::double + 1e-6) * (x_raw[i]::double - y_raw[i]::double + 1e-6)))) d
      from vector_pairs)"""))
def q_contrastive_loss(spark, sf_dir):
    """#42 contrastive loss over consecutive embedding pairs, margin 2."""
    return M.contrastive_loss(vector_pairs(spark, sf_dir), "x_raw", "y_raw", "label")
