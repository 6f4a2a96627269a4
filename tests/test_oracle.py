"""Every query with oracle SQL equals DuckDB on the smallest fixtures."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tests.oracle_compare import compare

ORACLE_KEYS = sorted(E.oracle_sql())
ROWS_ONLY_FAST = ["hashed_ngrams", "list_dis", "edit_features", "edit_features_prose", "pca",
                  "w2v_train", "train_lr_l1", "train_nb", "train_text_linear"]


@pytest.mark.parametrize("key", ORACLE_KEYS)
def test_matches_duckdb(spark, key):
    res = compare(spark, SF_SMALL, [key], verbose=False)
    assert res[key][0] == "ok", res[key]


@pytest.mark.parametrize("key", ROWS_ONLY_FAST)
def test_rows_only_runs(spark, key):
    df = E.queries()[key](spark, SF_SMALL)
    assert df.count() > 0


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "jaccard" in df.columns and "list_dis" in df.columns
