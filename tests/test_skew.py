"""One key holds a third of all rows: results stay exact and bounded per task."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from clickpair.operators import metrics as M
from clickpair.operators import rates
from clickpair.operators.grouping import group_titles
from clickpair.operators.sequence import next_in_group
from clickpair.sources.fixtures import basket_pairs, clicks
from clickpair.sources.tables import table
from tests.conftest import SF_MID


@pytest.fixture(scope="module")
def hot_clicks(spark):
    c = clicks(spark, SF_MID)
    return c.withColumn("key1", F.when(F.col("pair_id") % 3 == 0, F.lit(0)).otherwise(F.col("key1"))) \
            .withColumn("fold", F.col("pair_id") % 5).cache()


def test_hot_key_oof_rate(hot_clicks):
    got = rates.oof_rate(hot_clicks, "key1", "fold").toPandas().set_index("pair_id").sort_index()
    pdf = hot_clicks.toPandas()
    assert (pdf.key1 == 0).mean() > 0.3
    parts = []
    for f in range(5):
        tr, va = pdf[pdf.fold != f], pdf[pdf.fold == f]
        st = tr.groupby("key1")["label"].agg(["count", "mean", "sum"]).reset_index()
        m, v = st["mean"].mean(), st["mean"].var()
        a, b = m / v * (m * (1 - m) - v), (1 - m) / v * (m * (1 - m) - v)
        st["rate"] = (st["sum"] + a) / (st["count"] + a + b)
        parts.append(va.merge(st, on="key1", how="left"))
    exp = pd.concat(parts).set_index("pair_id").sort_index()
    assert (got["key1_count"].values == exp["count"].values).all()
    assert got["key1_rate"].values == pytest.approx(exp["rate"].values, rel=1e-12)


def test_hot_key_counts(hot_clicks):
    got = rates.attach_counts(hot_clicks.select("pair_id", "key1"), "key1", "n").toPandas()
    pdf = hot_clicks.select("pair_id", "key1").toPandas()
    pdf["n"] = pdf.groupby("key1")["key1"].transform("count")
    m = got.merge(pdf, on="pair_id")
    assert (m["n_x"] == m["n_y"]).all()


def test_hot_customer_successor(spark):
    o = table(spark, SF_MID, "orders").select("o_orderkey", "o_custkey")
    hot = o.withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit(1)).otherwise(F.col("o_custkey")))
    width = 4096
    got = next_in_group(hot, "o_custkey", "o_orderkey", {"o_orderkey": "nk"}, bucket_width=width)
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    exp = hot.select("o_orderkey", F.lead("o_orderkey").over(w).alias("nk"))
    assert sorted(got.select("o_orderkey", "nk").collect()) == sorted(exp.collect())
    # the window inside next_in_group never holds more than one id range of a group
    per_task = (hot.groupBy("o_custkey", F.floor(F.col("o_orderkey") / width)).count()
                .agg(F.max("count")).first()[0])
    total_hot = hot.where(F.col("o_custkey") == 1).count()
    assert per_task <= width and per_task < total_hot


def test_hot_query_q_auc(spark):
    rng = np.random.default_rng(0)
    n = 3000
    qid = np.where(np.arange(n) % 3 == 0, 0, rng.integers(1, 200, n))
    score = rng.random(n).round(3)
    label = (rng.random(n) < score).astype(int)
    pdf = pd.DataFrame({"query_id": qid, "score": score, "label": label})
    got = M.q_auc(spark.createDataFrame(pdf), "query_id", "score", "label").first()

    def auc(g):
        pos, neg = g[g.label == 1].score.values, g[g.label == 0].score.values
        if len(pos) == 0 or len(neg) == 0:
            return 0.5
        return ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))

    exp = np.mean([auc(g) for _, g in pdf.groupby("query_id")])
    assert got["q_auc"] == pytest.approx(exp, abs=1e-12)


def test_hot_query_group_titles(spark):
    b = basket_pairs(spark, SF_MID)
    hot = b.withColumn("query_id", F.when(F.col("pair_id") % 3 == 0, F.lit(7)).otherwise(F.col("query_id")))
    got = {r["query_id"]: r["title_concat"] for r in group_titles(hot, bucket_width=256).collect()}
    pdf = hot.select("pair_id", "query_id", "title").toPandas().sort_values("pair_id")
    for qid, g in pdf.groupby("query_id"):
        assert got[qid] == " ".join(g["title"].unique())


def test_anchors_are_dealt_evenly(spark):
    """Anchors are minima of hashes: dealt by their own high bits, half of all
    runs met in one block, and so in one worker's memory."""
    from clickpair.llm import suffixes
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("abcdefghij "), 2000)) for _ in range(300)]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts * 2)], "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = suffixes.repeated_runs(rows, 64).groupBy(F.spark_partition_id()).agg(F.sum("n").alias("n")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    sizes = [r.n for r in found]
    assert sum(sizes) > 300 * 2 * 2000 / 101 and max(sizes) < 0.35 * sum(sizes)
