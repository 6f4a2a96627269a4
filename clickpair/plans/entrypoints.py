"""The reference's three entry points as Spark jobs over user files.

A ``build_models``     click rates + pair features -> scaled matrix -> trees and
                       L1-LR on a positional split, with AUC, log loss and
                       feature importance (§3.1)
B ``linear_ensemble``  chunked n-gram vectorizer + 5-fold L1-LR, averaged test
                       predictions written as a headerless CSV (§3.2)
C ``extract_features`` strip the title tab, first + tenth chunk of train with
                       test, fill, pair features, feature CSV (§3.3)

Every step is an operator of this package; the driver only sequences model
fits and reads back scalar metrics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickpair.functions.text import strip_tab
from clickpair.operators import ml as ML
from clickpair.operators import prep, rates
from clickpair.operators.folds import stratified_kfold
from clickpair.operators.metrics import auc, log_loss
from clickpair.plans.features import feature_names, pair_feature_table
from clickpair.session import cut_lineage
from clickpair.sources import sinks
from clickpair.sources.tables import scan_pairs

RATE_KEYS = ["query", "title"]


def _with_ids(df: DataFrame) -> DataFrame:
    # a stable row id from the file's own ids (query_id, title_id)
    return df.withColumn("pair_id", F.xxhash64("query_id", "title_id", "query", "title"))


def rate_features(train: DataFrame, test: DataFrame, keys=RATE_KEYS, k: int = 5) -> DataFrame:
    """Out-of-fold rates on train, full-train rates on test, stacked with a split column."""
    tr = stratified_kfold(train, k, "pair_id", "label")
    tr = rates.oof_rates_all(tr, keys, "fold", "label", k).drop("fold")
    te = test
    for key in keys:
        te = rates.apply_rate(train, te, key)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            te = rates.apply_rate(train, te, [a, b])
    stacked = prep.union_all([tr.withColumn("split", F.lit("train")),
                              te.withColumn("split", F.lit("test"))])
    return prep.fill_missing(stacked, -1)


def build_models(spark: SparkSession, train_path: str, test_path: str, n_train: int = 15000,
                 fmt: str = "csv", rounds: int = ML.GBT_ROUNDS,
                 patience: int = ML.GBT_PATIENCE) -> dict:
    """Entry point A.  Returns predictions for the test file, hold-out AUC and
    log loss of both models, the number of trees, and a feature-importance
    table.  ``n_train`` bounds the rows the models are fitted on; the other
    labelled rows are the hold-out, which also picks the number of trees
    (``rounds`` at most, ``patience`` without a gain)."""
    train = _with_ids(scan_pairs(spark, train_path, True, fmt))
    test = _with_ids(scan_pairs(spark, test_path, False, fmt)).withColumn("label", F.lit(None).cast("int"))
    stacked = rate_features(train, test)
    feats = pair_feature_table(stacked, keep=tuple(c for c in stacked.columns
                                                   if c not in ("query", "title")), with_edit=True)
    groups = list(RATE_KEYS) + [f"{a}_{b}" for i, a in enumerate(RATE_KEYS) for b in RATE_KEYS[i + 1:]]
    rate_cols = [f"{g}_{s}" for g in groups for s in ("count", "click_number", "rate")]
    names = feature_names(with_edit=True) + rate_cols
    scaled = cut_lineage(prep.fill_missing(prep.minmax_scale(feats, names), -1, names))
    labelled = prep.split_by_position(scaled.where(F.col("split") == "train"), "pair_id", n_train,
                                      "part")
    data = cut_lineage(ML.assemble(labelled, names, "features"))
    fit_rows = data.where(F.col("part") == "train")
    hold = data.where(F.col("part") == "test")
    gbt = ML.fit_boosted(fit_rows, hold, max_iter=rounds, patience=patience)
    lr = ML.lr_l1(fit_rows.count(), ML.LR_C).fit(fit_rows)
    metrics = {"gbt_trees": gbt.getNumTrees}
    for name, m in (("gbt", gbt), ("lr", lr)):
        p = ML.positive_probability(m.transform(hold))
        metrics[f"{name}_auc"] = auc(p, "prediction", "label").first()["auc"]
        metrics[f"{name}_log_loss"] = log_loss(p, "prediction", "label").first()["log_loss"]
    test_rows = ML.assemble(scaled.where(F.col("split") == "test"), names, "features")
    preds = ML.positive_probability(gbt.transform(test_rows)).select(
        "pair_id", "query_id", "title_id", "prediction")
    importance = spark.createDataFrame(ML.feature_importance(names, gbt, lr),
                                       "feature string, gbt double, lr double")
    return {"predictions": preds, "metrics": metrics, "importance": importance}


def linear_ensemble(spark: SparkSession, train_path: str, test_path: str, out_path: str,
                    chunk_size: int = 5_000_000, k: int = 5, C: float = 0.2,
                    fmt: str = "csv") -> dict:
    """Entry point B.  Writes ``query_id, query_title_id, prediction`` (no
    header) and returns the table of validation AUCs per chunk and fold."""
    def terms(df):
        return df.withColumn("terms", ML.ngram_terms(F.concat_ws(" ", "query", "title")))
    train = terms(_with_ids(scan_pairs(spark, train_path, True, fmt)))
    test = terms(_with_ids(scan_pairs(spark, test_path, False, fmt)))
    preds, aucs = ML.cv_ensemble(train, test, "pair_id", "terms", "label", chunk_size, k, C)
    out = test.select("pair_id", "query_id", "title_id").join(preds, "pair_id")
    sinks.sink_predictions(out.select("query_id", F.col("title_id").alias("pair_id"), "prediction"),
                           out_path)
    return {"fold_auc": aucs}


def extract_features(spark: SparkSession, train_path: str, test_path: str, out_path: str,
                     chunk_size: int = 100_000_000, fmt: str = "csv",
                     keep_chunks: tuple[int, ...] | None = None) -> DataFrame:
    """Entry point C.  The train rows (or only the chunks named, as the
    reference's first and tenth: ``(0, 9)``) plus the test rows (title
    tab stripped), missing values -1, pair features, written as CSV with a
    header.  Aggregates are global, not per slice."""
    train = _with_ids(scan_pairs(spark, train_path, True, fmt))
    test = _with_ids(scan_pairs(spark, test_path, False, fmt)).withColumn("title", strip_tab("title"))
    picked = train if keep_chunks is None else prep.slice_rows(
        train, "pair_id", chunk_size, keep_chunks).drop("chunk")
    both = prep.fill_missing(prep.union_all([picked.withColumn("split", F.lit("train")),
                                             test.withColumn("split", F.lit("test"))]), -1)
    feats = pair_feature_table(both, keep=("pair_id", "query_id", "title_id", "label", "split"),
                               with_edit=True)
    sinks.sink_features(feats, out_path, fmt="csv", partition_by=())
    return feats
