"""The three entry points run end to end on CSV files cut from the fixtures."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from clickpair.plans import entrypoints as EP
from clickpair.sources.fixtures import basket_pairs
from clickpair.sources.sinks import read_predictions
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def files(spark):
    d = tempfile.mkdtemp(prefix="clickpair-entry-")
    b = basket_pairs(spark, SF_SMALL)
    cols = ["query_id", "query", "title_id", "title"]
    b.where(F.col("pair_id") % 4 != 0).select(*cols, "label").write.csv(os.path.join(d, "train"))
    b.where(F.col("pair_id") % 4 == 0).select(*cols).write.csv(os.path.join(d, "test"))
    return d, b.where(F.col("pair_id") % 4 == 0).count()


def test_build_models(spark, files):
    d, n_test = files
    out = EP.build_models(spark, os.path.join(d, "train"), os.path.join(d, "test"), n_train=600,
                          rounds=20, patience=5)
    assert out["predictions"].count() == n_test
    m = out["metrics"]
    assert 1 <= m["gbt_trees"] <= 20 and 0.0 <= m["gbt_auc"] <= 1.0 and m["lr_log_loss"] > 0
    assert out["importance"].count() > 30


def test_linear_ensemble(spark, files):
    d, n_test = files
    res = EP.linear_ensemble(spark, os.path.join(d, "train"), os.path.join(d, "test"),
                             os.path.join(d, "pred"), chunk_size=500, k=2, C=0.2)
    back = read_predictions(spark, os.path.join(d, "pred"))
    assert back.count() == n_test and res["fold_auc"].count() >= 2


def test_extract_features(spark, files):
    d, n_test = files
    feats = EP.extract_features(spark, os.path.join(d, "train"), os.path.join(d, "test"),
                                os.path.join(d, "feat"), chunk_size=100)
    back = spark.read.option("header", "true").csv(os.path.join(d, "feat"))
    assert back.count() == feats.count() and "jaccard" in back.columns
