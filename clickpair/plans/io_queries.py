"""Registered queries: sinks (§2.1 #4-#7) and streaming jobs (§2.14).

Sink queries write through the sink and read the result back, so the check
covers the round trip.  Output goes under the shared checkpoint folder.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from clickpair.plans.catalog import ORACLE, register
from clickpair.plans.oracle_sql import with_fixtures
from clickpair.plans.pair_queries import TOKEN_SET_SQL
from clickpair.plans.prep_queries import q_avg_predictions
from clickpair.plans.rate_queries import _oof_sql
from clickpair.session import checkpoint_dir
from clickpair.sources import sinks
from clickpair.sources.fixtures import basket_pairs
from clickpair.sources.tables import table
from clickpair.streaming import jobs


def _out(spark, name):
    return os.path.join(checkpoint_dir(spark), "sinks", name, uuid.uuid4().hex)


@register("export_labeled_text", with_fixtures("basket_pairs", """
select printf('__label__%d %s %s', label, query, title) value
from basket_pairs order by pair_id limit 20001"""))
def q_export_labeled_text(spark, sf_dir):
    """#4 ``__label__{label} {query} {title}`` lines, first 20,001 pairs by id."""
    path = _out(spark, "labeled_text")
    sinks.export_labeled_text(basket_pairs(spark, sf_dir), path)
    return spark.read.text(path)


@register("sink_predictions", f"""
select key1 query_id, pair_id query_title_id, prediction from (
  select p.pair_id, c.key1, avg(p.prediction) prediction from (
    select pair_id, key1_rate prediction from ({_oof_sql(['key1'])}) a
    union all
    select pair_id, key1_key2_rate prediction from ({_oof_sql(['key1', 'key2'])}) b) p
  join (select event_id pair_id, user_id key1 from events) c using (pair_id)
  group by p.pair_id, c.key1)""")
def q_sink_predictions(spark, sf_dir):
    """#5 averaged predictions written as a headerless CSV and read back."""
    preds = q_avg_predictions(spark, sf_dir)
    ev = table(spark, sf_dir, "events").select(F.col("event_id").alias("pair_id"),
                                                F.col("user_id").alias("query_id"))
    path = _out(spark, "predictions")
    sinks.sink_predictions(preds.join(ev, "pair_id"), path)
    return sinks.read_predictions(spark, path)


@register("sink_features", f"""
select f.*, case when b.label = 1 then 'train' else 'test' end split
from ({TOKEN_SET_SQL}) f join (select o_orderkey pair_id, cast(o_orderstatus = 'F' as int) label
                               from orders) b using (pair_id)""")
def q_sink_features(spark, sf_dir):
    """#6-#7 feature table written as parquet partitioned by split, read back."""
    from clickpair.plans.pair_queries import q_token_set_features
    f = q_token_set_features(spark, sf_dir)
    lab = basket_pairs(spark, sf_dir).select("pair_id", "label")
    f = f.join(lab, "pair_id").withColumn(
        "split", F.when(F.col("label") == 1, "train").otherwise("test")).drop("label")
    path = _out(spark, "features")
    sinks.sink_features(f, path)
    return spark.read.parquet(path)


def _clicks_transform(src):
    return src.select(F.col("event_id").alias("pair_id"), F.col("user_id").alias("key1"),
                      F.hour("ts").alias("key2"),
                      (F.col("event_type") == "click").cast("int").alias("label"))


@register("stream_key_rates")
def q_stream_key_rates(spark, sf_dir):
    """#134 running per-user counts over the event stream -> smoothed rates."""
    path = f"{sf_dir.rstrip('/')}/events.parquet"
    schema = spark.read.parquet(path).schema
    q, out = jobs.key_stats_stream(spark, path, schema, "key1", transform=_clicks_transform)
    q.awaitTermination()
    return jobs.rates_from_stats(jobs.current_key_stats(spark, out, "key1"), "key1")


@register("stream_pair_features")
def q_stream_pair_features(spark, sf_dir):
    """#135 token-set features of pairs arriving in a landing folder."""
    landing = _out(spark, "landing")
    basket_pairs(spark, sf_dir).write.parquet(landing)
    schema = spark.read.parquet(landing).schema
    q, out = jobs.pair_features_stream(spark, landing, schema)
    q.awaitTermination()
    return spark.read.parquet(out)


# The streaming results must equal the batch queries: reuse their oracles.
ORACLE["stream_key_rates"] = ORACLE["smoothed_rate"]
ORACLE["stream_pair_features"] = ORACLE["token_set_features"]
