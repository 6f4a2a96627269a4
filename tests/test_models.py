"""What the boosted trees learn, and rows that must not get lost."""

from pyspark.sql import functions as F

from __spark_entry__ import queries
from clickpair.functions.text import tokenize
from clickpair.functions.vectors import minmax_shift, with_distances
from clickpair.operators import embed as EM
from clickpair.operators import ml as ML
from clickpair.operators.metrics import auc


def _labelled(spark, noise: bool):
    """400 rows; the label is ``x > y``, or a hash of the id for ``noise``."""
    h = [(F.abs(F.xxhash64("pair_id", F.lit(i))) % 1000 / 1000.0) for i in range(3)]
    d = spark.range(400).withColumnRenamed("id", "pair_id").select(
        "pair_id", h[0].alias("x"), h[1].alias("y"), h[2].alias("z"))
    label = F.col("z") > 0.5 if noise else F.col("x") > F.col("y")
    d = d.withColumn("label", label.cast("int"))
    return ML.assemble(d, ["x", "y"], "features").cache()


def test_best_round():
    assert ML.best_round([5, 4, 3, 2], 2) == (4, False)
    assert ML.best_round([5, 3, 4, 4, 1], 2) == (2, True)
    assert ML.best_round([5, 3, 4, 2, 1], 2) == (5, False)
    assert ML.best_round([1.0], 3) == (1, False)


def test_boosting_learns_a_separable_label(spark):
    d = _labelled(spark, noise=False)
    fit, hold = d.where("pair_id % 4 <> 0"), d.where("pair_id % 4 = 0")
    m = ML.fit_boosted(fit, hold, max_iter=60, patience=30)
    assert m.getNumTrees > 50
    scored = ML.positive_probability(m.transform(hold))
    assert auc(scored, "prediction", "label").first()["auc"] > 0.9


def test_boosting_stops_on_noise_and_keeps_all_rounds_without_validation(spark):
    d = _labelled(spark, noise=True)
    fit, hold = d.where("pair_id % 4 <> 0"), d.where("pair_id % 4 = 0")
    assert ML.fit_boosted(fit, hold, max_iter=40, patience=3).getNumTrees < 40
    assert ML.fit_boosted(fit, hold.limit(0), max_iter=4, patience=2).getNumTrees == 4


def test_rows_without_a_vector_stay(spark):
    df = spark.createDataFrame([(1, "a b b"), (2, "zz"), (3, ""), (4, None)], "pair_id long, query string")
    vecs = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0])], "word string, vector array<double>")
    got = {r.pair_id: (r.vec_sum, r.n_known) for r in EM.sum_known_vectors(df, tokenize("query"), vecs).collect()}
    assert got == {1: ([1.0, 4.0], 3), 2: (None, 0), 3: (None, 0), 4: (None, 0)}


def test_constant_vectors_give_null_distances(spark):
    df = spark.createDataFrame([([1.0, 2.0], [2.0, 5.0]), ([3.0, 3.0], [1.0, 2.0])],
                               "x array<double>, y array<double>")
    v = df.select(minmax_shift("x").alias("x"), minmax_shift("y").alias("y"))
    rows = with_distances(v, "x", "y").collect()
    assert rows[0].manhattan == 0.0
    # the cosine is 0 where a norm is missing or zero
    assert {k: x for k, x in rows[1].asDict().items() if x is not None} == {"cosine_w2v": 0.0}


def test_queries_ask_for_all_rounds(spark, monkeypatch):
    asked, fit = [], ML.fit_boosted

    def few(train, valid, max_iter=ML.GBT_ROUNDS, patience=ML.GBT_PATIENCE, **kw):
        asked.append((max_iter, patience, valid.isEmpty()))
        return fit(train, valid, max_iter=2, patience=1, **kw)
    monkeypatch.setattr(ML, "fit_boosted", few)
    for name in ("train_gbt", "feature_importance"):
        assert queries()[name](spark, "/root/testdata/sf0.001").count() > 0
    assert asked == [(2000, 300, False)] * 2
