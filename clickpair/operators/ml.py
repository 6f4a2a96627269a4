"""Vectorizers, matrix transforms and model training (Spark ML).

Relational forms (long ``(key, term, value)`` tables) are used wherever a
result has to be inspected or joined, and for text models, whose vocabulary and
weights stay distributed (``blocklinear``); Spark ML estimators are used on the
fixed feature columns.  Nothing here collects data to the driver except what a
fitted Spark ML model itself holds (coefficients of those columns, trees).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.feature import (PCA, CountVectorizer, HashingTF,  # noqa: F401
                                PolynomialExpansion, VectorAssembler)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickpair.functions.text import tokenize, word_tokens
from clickpair.operators import blocklinear, boosting, perceptron
from clickpair.operators.boosting import best_round  # noqa: F401
from clickpair.operators.folds import HASH_BITS, seeded_hash, stratified_kfold
from clickpair.operators.joins import heavy_join
from clickpair.operators.prep import row_index
from clickpair.operators.sequence import prefix_sums
from clickpair.session import written

# Fixed values of the reference's models and vectorizers.
NGRAM_MIN_DF = 50            # word 1-2-gram counts
HASHED_DIM = 200             # hashed 1-2-grams
TOKEN_ID_SPACE = 1_000_000   # bag of integer token ids
TFIDF_MAX_DF = 0.5           # word TF-IDF document-frequency cap
LR_C = 0.3                   # L1 logistic regression inverse strength
GBT_ROUNDS, GBT_RATE, GBT_DEPTH, GBT_SUBSAMPLE, GBT_FEATURES = 2000, 0.01, 6, 0.8, 0.8
GBT_PATIENCE = 300           # rounds without a lower validation loss
TEXT_EPOCHS = 25             # supervised linear text classifier
PCA_K = 50
AUGMENT_T = 2


# ------------------------------------------------------------- vectorizers
def ngram_terms(text) -> Column:
    """Word unigrams followed by bigrams ('a b') of the lower-cased text."""
    def finish(tok):
        # ``tok`` is a lambda variable here, so the tokens are extracted once
        n = F.size(tok)
        bigrams = F.zip_with(F.slice(tok, 1, F.greatest(n - 1, F.lit(1))),
                             F.slice(tok, 2, F.greatest(n - 1, F.lit(1))),
                             lambda a, b: F.concat_ws(" ", a, b))
        return F.concat(tok, F.when(n >= 2, bigrams).otherwise(F.array().cast("array<string>")))
    return F.aggregate(F.array(word_tokens(text)), F.array().cast("array<string>"),
                       lambda acc, t: t, finish)


def term_document_frequency(df: DataFrame, key: str, terms: str) -> DataFrame:
    return (df.select(key, F.explode(F.array_distinct(terms)).alias("term"))
            .groupBy("term").agg(F.count(F.lit(1)).alias("df")))


def ngram_counts_long(df: DataFrame, key: str, terms: str, min_df: int = NGRAM_MIN_DF,
                      fit: DataFrame | None = None) -> DataFrame:
    """(key, term, n) for vocabulary terms; the vocabulary (df ≥ min_df) is
    fitted on ``fit`` (default: ``df`` itself) and applied to ``df``."""
    vocab = term_document_frequency(fit if fit is not None else df, key, terms) \
        .where(F.col("df") >= min_df).select("term")
    ex = df.select(key, F.explode(terms).alias("term"))
    return (ex.join(vocab, "term").groupBy(key, "term")
            .agg(F.count(F.lit(1)).cast("int").alias("n")))


def count_vectorizer(terms: str = "terms", out: str = "features", min_df: int = NGRAM_MIN_DF):
    return CountVectorizer(inputCol=terms, outputCol=out, minDF=float(min_df),
                           vocabSize=2**31 - 1)       # no cap but min_df


def hashed_ngrams(df: DataFrame, terms: str = "terms", out: str = "features",
                  dim: int = HASHED_DIM) -> DataFrame:
    return HashingTF(inputCol=terms, outputCol=out, numFeatures=dim).transform(df)


def token_id_bag(df: DataFrame, key: str, text, space: int = TOKEN_ID_SPACE) -> DataFrame:
    """(key, idx, n): counts of tokens that parse as an integer in [0, space)."""
    ex = df.select(key, F.explode(tokenize(text)).alias("_t"))
    idx = ex.select(key, F.expr("try_cast(_t as int)").alias("idx"))
    return (idx.where((F.col("idx") >= 0) & (F.col("idx") < space))
            .groupBy(key, "idx").agg(F.count(F.lit(1)).cast("int").alias("n")))


def word_tfidf_long(df: DataFrame, key: str, terms: str, max_df: float = TFIDF_MAX_DF) -> DataFrame:
    """(key, term, weight): sublinear tf ``1 + ln(c)``, smoothed idf
    ``ln((1+N)/(1+df)) + 1``, terms in more than ``max_df``·N rows dropped,
    rows L1-normalised."""
    n_docs = df.agg(F.count(F.lit(1))).scalar()                  # scalar subquery
    dfreq = term_document_frequency(df, key, terms)
    idf = (dfreq.where(F.col("df") <= F.lit(max_df) * n_docs)
           .select("term", (F.log((1 + n_docs) / (1 + F.col("df"))) + 1).alias("idf")))
    counts = df.select(key, F.explode(terms).alias("term")).groupBy(key, "term").agg(
        F.count(F.lit(1)).alias("c"))
    w = counts.join(idf, "term").select(key, "term", ((1 + F.log("c")) * F.col("idf")).alias("w"))
    tot = w.groupBy(key).agg(F.sum("w").alias("_tot"))
    return w.join(tot, key).select(key, "term", (F.col("w") / F.col("_tot")).alias("weight"))


def index_values(df: DataFrame, col: str, name: str = "index") -> DataFrame:
    """Dense 0-based index of the distinct values of a numeric column in
    ascending order, without collecting the labels to the driver."""
    distinct = df.select(col).where(F.col(col).isNotNull()).distinct()
    return row_index(distinct, col, name)


def one_hot(df: DataFrame, col: str, out: str = "one_hot") -> DataFrame:
    """``index_values`` joined back, then a sparse one-hot vector, NULL where
    the value is.  One more place than values, the last for unseen ones, as
    ``OneHotEncoder`` has it with ``handleInvalid="keep"``; the encoder itself
    names every place in the metadata of its column, on the driver."""
    idx = index_values(df, col, "_idx")
    n = df.agg(F.count_distinct(col)).scalar()
    j = df.join(idx, col, "left").withColumn("_idx", F.col("_idx").cast("double"))
    hot = F.udf(lambda i, n: None if i is None else SparseVector(n + 1, [int(i)], [1.0]), VectorUDT())
    return j.withColumn(out, hot("_idx", n.cast("int"))).withColumnRenamed("_idx", col + "_index")


# ------------------------------------------------------------- matrices
def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep").transform(df)


def poly_expand(df: DataFrame, cols: Sequence[str], degree: int = 2, out: str = "poly") -> DataFrame:
    """Degree-2 polynomial features without bias, as ``ARRAY<DOUBLE>``."""
    a = assemble(df, cols, "_v")
    p = PolynomialExpansion(degree=degree, inputCol="_v", outputCol="_p").transform(a)
    return p.withColumn(out, vector_to_array("_p")).drop("_v", "_p")


def standardize(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Zero mean, unit population standard deviation; a constant column maps to 0."""
    # all statistics in one aggregate, used as one struct-valued scalar subquery
    st = df.agg(F.struct(*[e for c in cols for e in (F.avg(c).alias(f"{c}_m"),
                                                      F.stddev_pop(c).alias(f"{c}_s"))])).scalar()
    d = df.withColumn("_ms", st)                                  # the subquery appears once
    out = {}
    for c in cols:
        m, s = F.col(f"_ms.{c}_m"), F.col(f"_ms.{c}_s")
        out[c] = (F.col(c) - m) / F.when(s == 0, F.lit(1.0)).otherwise(s)
    return d.withColumns(out).drop("_ms")


def pca(df: DataFrame, vec: str, k: int = PCA_K, out: str = "pca") -> DataFrame:
    """Principal components (not centred by Spark: standardize first)."""
    m = PCA(k=k, inputCol=vec, outputCol="_pc").fit(df)
    return m.transform(df).withColumn(out, vector_to_array("_pc")).drop("_pc")


def augment_shuffle(df: DataFrame, cols: Sequence[str], key: str = "pair_id", label: str = "label",
                    t: int = AUGMENT_T, seed: int = 2019) -> DataFrame:
    """Append ``t`` copies of the positive rows and ``t // 2`` of the negative
    rows in which every feature column is permuted independently inside its
    class.  Copy j takes column c of its row r from the row ranked r under the
    hash (seed, j, c).

    One pass for all permutations: every row is emitted once per (copy,
    column), all orderings are ranked together by one grouped ``prefix_sums``
    (group = class, copy, column), and one aggregation on (class, copy, rank)
    reassembles the copies.
    """
    cols = list(cols)
    pos = [(j, ci) for j in range(t) for ci in range(len(cols))]
    neg = [(j, ci) for j in range(t // 2) for ci in range(len(cols))]

    def orders(pairs):
        return F.array(*[F.struct(F.lit(j).alias("copy"), F.lit(ci).alias("ci"),
                                  seeded_hash(key, seed * 1000 + j * 97 + ci + 1).alias("h"))
                         for j, ci in pairs]) if pairs else F.array().cast(
            "array<struct<copy:int,ci:int,h:bigint>>")

    rows = df.select(key, label, F.struct(*cols).alias("_row"))
    ex = (rows.select(label, "_row",
                      F.explode(F.when(F.col(label) == 1, orders(pos)).otherwise(orders(neg))).alias("_o"))
          .select(label, "_row", F.col("_o.copy").alias("_copy"), F.col("_o.ci").alias("_ci"),
                  F.col("_o.h").alias("_h"), F.lit(1).cast("long").alias("_one")))
    ranked = prefix_sums(ex, "_h", "_one", groups=[label, "_copy", "_ci"], hash_bits=HASH_BITS)
    copies = (ranked.groupBy(label, "_copy", F.col("_one_before").alias("_r"))
              .agg(*[F.max(F.when(F.col("_ci") == ci, F.col("_row")[c])).alias(c)
                     for ci, c in enumerate(cols)]))
    aug = copies.select(F.lit(None).cast("long").alias(key), F.col(label).cast(df.schema[label].dataType),
                        *cols, (F.col("_copy") + 1).alias("copy"))
    return df.select(key, label, *cols).withColumn("copy", F.lit(0)).unionByName(aug)


# ------------------------------------------------------------- models
def lr_l1(n_rows: int, C: float = LR_C, features: str = "features", label: str = "label",
          max_iter: int = 100) -> LogisticRegression:
    """L1 logistic regression equal in objective to ``C·Σloss + ||w||₁``."""
    return LogisticRegression(featuresCol=features, labelCol=label, elasticNetParam=1.0,
                              regParam=1.0 / (C * max(n_rows, 1)), standardization=False,
                              maxIter=max_iter)


def fit_boosted(train: DataFrame, valid: DataFrame, features: str = "features", label: str = "label",
                max_iter: int = GBT_ROUNDS, patience: int = GBT_PATIENCE, seed: int = 2018):
    """Boosted trees cut at the best validation loss: training ends once
    ``patience`` rounds pass without a lower one, or at ``max_iter``.  Without
    validation rows all rounds are kept."""
    return boosting.fit(train, valid, features, label, max_iter, patience, GBT_RATE, GBT_DEPTH, GBT_SUBSAMPLE,
                        GBT_FEATURES, seed)


def positive_probability(pred: DataFrame, col: str = "probability", out: str = "prediction") -> DataFrame:
    return pred.withColumn(out, vector_to_array(col)[1])


def feature_importance(names: Sequence[str], gbt_model=None, lr_model=None) -> list[tuple]:
    """(feature, gbt importance, lr coefficient) rows; small, one per feature."""
    gi = gbt_model.featureImportances.toArray().tolist() if gbt_model is not None else [None] * len(names)
    lc = lr_model.coefficients.toArray().tolist() if lr_model is not None else [None] * len(names)
    return [(n, float(g) if g is not None else None, float(c) if c is not None else None)
            for n, g, c in zip(names, gi, lc)]


def mlp(n_features: int, hidden: Sequence[int] = (64, 32), features: str = "features",
        label: str = "label", max_iter: int = 100, seed: int = 2019):
    """A perceptron to be fitted; see ``perceptron``."""
    return perceptron.Perceptron([n_features, *hidden, 2], features, label, max_iter, seed=seed)


def naive_bayes(features: str = "features", label: str = "label") -> NaiveBayes:
    return NaiveBayes(featuresCol=features, labelCol=label, modelType="multinomial")


def naive_bayes_scores(train: DataFrame, rows: DataFrame, terms: str = "terms", label: str = "label",
                       smoothing: float = 1.0, out: str = "prediction") -> DataFrame:
    """Multinomial naive Bayes without a vocabulary on the driver: the counts of
    a term under both labels are a table, joined with the terms of ``rows``.
    Only terms of ``train`` count; class sums are scalar subqueries.  ``rows``
    need a unique ``row`` column."""
    y = F.col(label)
    counts = train.where(y.isNotNull()).select(label, F.explode(terms).alias("term")).groupBy("term").agg(
        F.sum((y == 1).cast("double")).alias("c1"), F.sum((y == 0).cast("double")).alias("c0"), F.count(F.lit(1)).alias("n"))
    counts = written(counts, "term-labels")
    sums = counts.agg(F.struct(F.sum("c1").alias("c1"), F.sum("c0").alias("c0"), F.count(F.lit(1)).alias("v"))).scalar()
    prior = train.agg(F.struct(F.sum((y == 1).cast("double")).alias("c1"), F.sum((y == 0).cast("double")).alias("c0"))).scalar()
    odds = lambda a, b: F.log((a + smoothing) / (b + smoothing))
    table = counts.select("term", "n", odds(F.col("c1"), F.col("c0")).alias("w"))
    ex = rows.select("row", F.explode(terms).alias("term"))
    each = heavy_join(ex, table, "term", "n").groupBy("row").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("k"))
    # a term's share is (count + s) / (class sum + s * vocabulary)
    share = F.log((F.col("_s.c0") + smoothing * F.col("_s.v")) / (F.col("_s.c1") + smoothing * F.col("_s.v")))
    z = odds(F.col("_p.c1"), F.col("_p.c0")) + F.coalesce(F.col("w") + F.col("k") * share, F.lit(0.0))
    return rows.join(each, "row", "left").withColumn("_s", sums).withColumn("_p", prior).withColumn(
        out, 1 / (1 + F.exp(-z))).drop("w", "k", "_s", "_p")


def numbered_rows(df: DataFrame, order: str = "row") -> DataFrame:
    """``df`` stored with ``order``, the 0-based position of a row in it: the
    rows of a partition are counted, and offsets come from one count a
    partition."""
    ids = written(df.withColumn("_id", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_id", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)            # one row a partition
    first = ids.groupBy(part.alias("_part")).count().select(
        "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    within = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return ids.withColumn("_part", part).join(first, "_part").withColumn(order, F.col("_first") + within).drop(
        "_id", "_part", "_first")


def fit_text_linear(train: DataFrame, score: DataFrame, terms: str = "terms", label: str = "label",
                    min_count: int = NGRAM_MIN_DF, epochs: int = TEXT_EPOCHS, out: str = "prediction") -> DataFrame:
    """Fit #130 on ``train`` and add ``prediction`` to ``score``: a linear
    classifier on n-grams of ``min_count`` rows, ``epochs`` rounds, whose
    vocabulary and weights stay distributed.  If no n-gram reaches ``min_count``
    the intercept is what is fitted.  ``score`` needs a unique ``row`` column."""
    one = numbered_rows(train.select(label, terms)).select(
        F.lit(0).cast("long").alias("chunk"), "row", F.col(label).alias("label"), F.lit(0).alias("fold"), F.col(terms).alias("terms"))
    model = blocklinear.fit(one, "terms", folds=1, min_df=min_count, rounds=epochs)
    return score.join(model.score(score, terms).select("row", F.col("prediction").alias(out)), "row", "left")


def cv_ensemble(df: DataFrame, score_df: DataFrame, key: str = "pair_id", terms: str = "terms",
                label: str = "label", chunk_size: int = 5_000_000, k: int = 5, C: float = 0.2,
                min_df: int = NGRAM_MIN_DF, rounds: int = blocklinear.ROUNDS):
    """Chunks of ``chunk_size`` rows in file order, each with its own n-gram
    vocabulary; per stratified fold an L1 model of the other folds; the
    prediction of a row of ``score_df`` is the mean over chunks and folds.

    All chunks and folds are trained together (``blocklinear.fit``), so the
    plan does not grow with them, and averaged where they are scored
    (``mean_scores``).  Returns (predictions: ``key``, ``prediction``,
    ``n_models``; the held-out AUC per chunk and fold).  Rows are told apart by
    position, so repeated rows and ids are scored once each.
    """
    from clickpair.operators.metrics import grouped_auc
    rows = numbered_rows(df.select(F.col(label).alias("label"), F.col(terms).alias("terms")).where("label is not null"))
    rows = rows.withColumn("chunk", F.floor(F.col("row") / chunk_size))
    rows = stratified_kfold(rows, k, "row", "label", within=["chunk"])
    model = blocklinear.fit(rows, "terms", folds=k, min_df=min_df, l1=1.0 / C, rounds=rounds)
    scored = numbered_rows(score_df.select(key, F.col(terms).alias("terms")))
    return (scored.join(model.mean_scores(scored), "row").select(key, "prediction", "n_models"),
            grouped_auc(model.held_out(), ["chunk", "fold"], "prediction", "label"))
