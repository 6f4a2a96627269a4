"""Skew-safe replacements of windows equal the plain window results."""

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from clickpair.operators.grouping import group_titles
from clickpair.operators.prep import row_index
from clickpair.operators.sequence import next_in_group, prefix_sums
from tests.conftest import SF_SMALL


def test_next_in_group_small_buckets(spark):
    rows = [(g, o, f"v{g}_{o}") for g in (1, 2) for o in (0, 3, 4, 9, 10, 11, 25)] + [(3, 5, "x")]
    df = spark.createDataFrame(rows, "g long, o long, v string")
    got = next_in_group(df, "g", "o", {"o": "no", "v": "nv"}, bucket_width=4)
    w = Window.partitionBy("g").orderBy("o")
    exp = df.select("g", "o", F.lead("o").over(w).alias("no"), F.lead("v").over(w).alias("nv"))
    assert sorted(got.select("g", "o", "no", "nv").collect()) == sorted(exp.collect())


def test_prefix_sums_groups(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), F.col("id").alias("o"),
                                 (F.col("id") % 7).alias("v"))
    got = prefix_sums(df, "o", "v", groups=["g"], n_ranges=5).toPandas().sort_values("o")
    pdf = df.toPandas().sort_values("o")
    pdf["exp"] = pdf.groupby("g")["v"].cumsum() - pdf["v"]
    assert list(got["v_before"]) == list(pdf["exp"])


def test_row_index(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    got = row_index(df, "k").toPandas()
    assert (got["row_idx"] == got["k"]).all()


def test_group_titles_vs_pandas(spark):
    rows = [(i, i % 4, f"q{i % 4}", f"t{(i * 7) % 5}", i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "pair_id long, query_id long, query string, title string, label int")
    got = {r["query_id"]: r for r in group_titles(df, bucket_width=3).collect()}
    pdf = pd.DataFrame(rows, columns=["pair_id", "query_id", "query", "title", "label"]).sort_values("pair_id")
    for qid, g in pdf.groupby("query_id"):
        assert got[qid]["title_concat"] == " ".join(g["title"].unique())
        assert got[qid]["query"] == g["query"].iloc[0]
        assert got[qid]["label"] == g["label"].max()


def test_oof_equals_five_pass(spark):
    """Leave-one-fold-out by subtraction equals five separate group-bys."""
    from clickpair.operators import rates
    from clickpair.sources.fixtures import clicks
    df = clicks(spark, SF_SMALL).withColumn("fold", F.col("pair_id") % 5)
    got = rates.oof_rate(df, "key1", "fold").toPandas().set_index("pair_id").sort_index()
    pdf = df.toPandas()
    parts = []
    for f in range(5):
        tr, va = pdf[pdf.fold != f], pdf[pdf.fold == f]
        st = tr.groupby("key1")["label"].agg(["count", "mean", "sum"]).reset_index()
        m, v = st["mean"].mean(), st["mean"].var()
        a = m / v * (m * (1 - m) - v)
        b = (1 - m) / v * (m * (1 - m) - v)
        st["rate"] = (st["sum"] + a) / (st["count"] + a + b)
        parts.append(va.merge(st, on="key1", how="left"))
    exp = pd.concat(parts).set_index("pair_id").sort_index()
    assert (got["key1_count"].fillna(-1) == exp["count"].fillna(-1)).all()
    assert got["key1_rate"].values == pytest.approx(exp["rate"].values, rel=1e-12, nan_ok=True)
