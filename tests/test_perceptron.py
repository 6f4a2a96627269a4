"""The perceptron over packed blocks: gradient, and Spark's trainer beside it."""

import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from __spark_entry__ import queries
from clickpair.operators import ml as ML
from clickpair.operators import perceptron as P
from clickpair.sources.fixtures import basket_pairs
from tests.conftest import SF_SMALL


def _rows(spark, n, width=6, parts=4):
    """Rows whose label is whether the first column times the second is above the third."""
    cols = [((F.abs(F.xxhash64("id", F.lit(i))) % 2000) / 1000.0 - 1).alias(f"c{i}") for i in range(width)]
    d = spark.range(0, n, 1, parts).select("id", *cols).withColumn("label", (F.col("c0") * F.col("c1") > F.col("c2")).cast("int"))
    return ML.assemble(d, [f"c{i}" for i in range(width)], "features")


def _loss(model, rows):
    p = vector_to_array(F.col("probability"))[F.col("label")]
    return model.transform(rows).agg(F.avg(-F.log(F.greatest(p, F.lit(1e-12)))).alias("l")).first()["l"]


def test_gradient_is_that_of_the_loss():
    rng, layers = np.random.default_rng(3), [5, 4, 3, 2]
    x, y = rng.normal(size=(50, 5)).astype(np.float32), rng.integers(0, 2, 50)
    w = P.start_weights(layers, 1)
    _, grad = P.loss_and_gradient(x, y, P.unpacked(w, layers))
    for k in rng.choice(len(w), 20, replace=False):
        step = np.zeros(len(w))
        step[k] = 1e-2
        up, down = (P.loss_and_gradient(x, y, P.unpacked(w + s, layers))[0] for s in (step, -step))
        assert abs((up - down) / 2e-2 - grad[k]) < 2e-2 * max(1, abs(grad[k]))


def test_sums_do_not_depend_on_how_rows_are_dealt(spark, monkeypatch):
    rows, layers = _rows(spark, 5000), [6, 4, 2]
    w = P.start_weights(layers, 1)
    blocks = P.packed(rows, "features", "label")
    assert blocks.count() < 10
    loss, grad = P.summed(blocks, 4, layers, w)
    monkeypatch.setattr(P, "MEET", 2)
    again, same = P.summed(P.packed(rows.repartition(7), "features", "label"), 7, layers, w)
    assert abs(loss - again) < 1e-3 * loss and np.allclose(grad, same, atol=1e-3 * np.abs(grad).max())


def test_learns_as_well_as_sparks_trainer(spark):
    rows = _rows(spark, 20_000).cache()
    spark_mlp = MultilayerPerceptronClassifier(featuresCol="features", labelCol="label", layers=[6, 64, 32, 2], maxIter=30, seed=2019)
    own, other = (_loss(trainer.fit(rows), rows) for trainer in (ML.mlp(6, max_iter=30), spark_mlp))
    assert own < 1.3 * other and own < 0.1


def test_query_scores_every_pair(spark):
    got = queries()["train_mlp"](spark, SF_SMALL).collect()
    want = {r.pair_id: r.label for r in basket_pairs(spark, SF_SMALL).collect()}
    assert {r.pair_id: r.label for r in got} == want and len(got) == len(want)
    assert all(0 <= r.prediction <= 1 and r.split in ("train", "test") for r in got)


def test_a_table_without_rows_and_labels_that_are_null(spark):
    rows = _rows(spark, 300)
    assert ML.mlp(6).fit(rows.limit(0)).transform(rows).count() == 300
    some = rows.withColumn("label", F.when(F.col("id") % 3 > 0, F.col("label")))
    got = ML.positive_probability(ML.mlp(6, max_iter=15).fit(some).transform(some)).select("prediction").collect()
    assert len(got) == 300 and all(0 <= r.prediction <= 1 for r in got)


@pytest.mark.parametrize("start", [[-1.2, 1.0], [3.0, -2.0]])
def test_lbfgs_finds_the_minimum_of_a_bent_valley(start):
    def f(x):
        a, b = x
        return 100 * (b - a * a) ** 2 + (1 - a) ** 2, np.array([-400 * a * (b - a * a) - 2 * (1 - a), 200 * (b - a * a)])
    assert np.allclose(P.lbfgs(f, np.array(start), 200, 1e-12), [1, 1], atol=1e-3)
