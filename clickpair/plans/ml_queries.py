"""Registered queries: vectorizers, matrix transforms, folds and models (§2.12-§2.13).

Model queries return a prediction for every row (train and test) with a
``split`` column; the split is the stratified hash fold 0.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from clickpair.functions.tokens import TOKEN_SET_FEATURES, token_set_features
from clickpair.operators import ml as ML
from clickpair.operators.folds import kfold, stratified_kfold
from clickpair.operators.metrics import auc
from clickpair.plans.catalog import register
from clickpair.plans.features import feature_names, pair_feature_table
from clickpair.plans.oracle_sql import with_fixtures
from clickpair.plans.pair_queries import TOKEN_SET_SQL, cleaned_pairs, q_token_set_features
from clickpair.session import cut_lineage, written
from clickpair.sources.fixtures import basket_pairs, dialogue_pairs
from clickpair.streaming import online

_HASH_SQL = "('0x' || substr(md5('2019:' || cast(pair_id as varchar)), 1, 15))::bigint"
_TERMS_SQL = """
tok as (select pair_id, label, regexp_extract_all(lower(query || ' ' || title), '[\\p{L}\\p{N}_]{2,}') t
        from dialogue_pairs),
terms as (select pair_id, label, list_concat(t, list_transform(range(1, len(t)),
                   lambda i: t[i] || ' ' || t[i + 1])) terms from tok)"""


def _text_terms(spark, sf_dir):
    d = dialogue_pairs(spark, sf_dir)
    return d.select("pair_id", "label", ML.ngram_terms(F.concat_ws(" ", "query", "title")).alias("terms"))


def _features(spark, sf_dir):
    """The pair features with their split.  Pairs and features are stored: means,
    ranks and models read them again."""
    f = written(pair_feature_table(written(basket_pairs(spark, sf_dir), "pairs")), "pair-features")
    f = stratified_kfold(f, 5, "pair_id", "label")
    return f.withColumn("split", F.when(F.col("fold") == 0, "test").otherwise("train"))


# ------------------------------------------------------------- vectorizers
@register("ngram_counts", with_fixtures("dialogue_pairs", """
select e.pair_id, e.term, cast(count(*) as int) n
from (select pair_id, unnest(terms) term from terms) e
join (select term from (select distinct pair_id, unnest(terms) term from terms)
      group by term having count(*) >= 50) v using (term)
group by e.pair_id, e.term""", extra=_TERMS_SQL))
def q_ngram_counts(spark, sf_dir):
    """#115 word 1-2-gram counts over vocabulary terms in ≥ 50 rows."""
    return ML.ngram_counts_long(_text_terms(spark, sf_dir), "pair_id", "terms", ML.NGRAM_MIN_DF)


@register("hashed_ngrams")
def q_hashed_ngrams(spark, sf_dir):
    """#116 1-2-grams hashed into 200 buckets: non-zeros and total per row."""
    h = ML.hashed_ngrams(_text_terms(spark, sf_dir), "terms", "features", ML.HASHED_DIM)
    arr = F.col("arr")
    return (h.select("pair_id", ML.vector_to_array("features").alias("arr"))
            .select("pair_id", F.size(F.filter(arr, lambda x: x != 0)).alias("nnz"),
                    F.aggregate(arr, F.lit(0.0), lambda a, x: a + x).alias("total")))


@register("token_id_bag", with_fixtures("basket_pairs", """
select pair_id, idx, cast(count(*) as int) n from (
  select pair_id, try_cast(unnest(string_split(query || ' ' || title, ' ')) as int) idx
  from basket_pairs)
where idx >= 0 and idx < 1000000 group by pair_id, idx"""))
def q_token_id_bag(spark, sf_dir):
    """#117 counts of integer token ids below 1,000,000 in query + title."""
    b = basket_pairs(spark, sf_dir)
    return ML.token_id_bag(b, "pair_id", F.concat_ws(" ", "query", "title"))


@register("word_tfidf", with_fixtures("dialogue_pairs", """
select w.pair_id, w.term, w.w / t.tot weight
from w join (select pair_id, sum(w) tot from w group by pair_id) t using (pair_id)""",
                                      extra=_TERMS_SQL + """,
nd as (select count(*) N from terms),
dfq as (select term, count(*) df from (select distinct pair_id, unnest(terms) term from terms) group by term),
idf as (select term, ln((1 + N) / (1 + df)) + 1 idf from dfq cross join nd where df <= 0.5 * N),
c as (select pair_id, term, count(*) c from (select pair_id, unnest(terms) term from terms) group by 1, 2),
w as (select pair_id, term, (1 + ln(c)) * idf w from c join idf using (term))"""))
def q_word_tfidf(spark, sf_dir):
    """#118 sublinear-tf TF-IDF of 1-2-grams, df ≤ 0.5·N, L1-normalised rows."""
    return ML.word_tfidf_long(_text_terms(spark, sf_dir), "pair_id", "terms", ML.TFIDF_MAX_DF)


@register("one_hot_title", with_fixtures("basket_pairs", """
select pair_id, cast(dense_rank() over (order by title_id) - 1 as double) title_id_index,
       count(distinct title_id) over () n_titles
from basket_pairs"""))
def q_one_hot_title(spark, sf_dir):
    """#119 one-hot of the title id: its dense index and the vector size."""
    b = basket_pairs(spark, sf_dir).select("pair_id", "title_id")
    oh = ML.one_hot(b, "title_id")
    # the vector's size from the index, never from rows of dense arrays
    n = b.agg(F.count_distinct("title_id")).scalar()
    return oh.select("pair_id", "title_id_index", n.cast("long").alias("n_titles"))


# ------------------------------------------------------------- matrices
_POLY = ["query_len", "title_len", "jaccard"]


@register("poly_expand", f"""
select pair_id, [x, x * x, y, x * y, y * y, z, x * z, y * z, z * z] poly
from (select pair_id, query_len::double x, title_len::double y, jaccard::double z from ({TOKEN_SET_SQL}) f)""")
def q_poly_expand(spark, sf_dir):
    """#120 degree-2 polynomial expansion of three token features."""
    return ML.poly_expand(q_token_set_features(spark, sf_dir).select("pair_id", *_POLY), _POLY) \
        .select("pair_id", "poly")


_STD = ["query_len", "title_len", "jaccard", "dice"]


@register("standardize", f"""
select pair_id, {', '.join(f"({c} - avg({c}) over ()) / coalesce(nullif(stddev_pop({c}) over (), 0), 1.0) {c}" for c in _STD)}
from ({TOKEN_SET_SQL}) f""")
def q_standardize(spark, sf_dir):
    """#122 zero mean, unit population standard deviation."""
    return ML.standardize(q_token_set_features(spark, sf_dir).select("pair_id", *_STD), _STD)


@register("pca")
def q_pca(spark, sf_dir):
    """#121 degree-2 expansion of all token features -> 50 principal components
    -> standardised (Spark projects uncentred vectors; standardising removes
    that offset, so the result equals centred PCA up to sign).  The features
    are stored: fitting and standardising read them several times."""
    names = TOKEN_SET_FEATURES
    f = written(q_token_set_features(spark, sf_dir).select("pair_id", *names), "features")
    a = ML.assemble(f, names, "_v")
    p = ML.PolynomialExpansion(degree=2, inputCol="_v", outputCol="poly").transform(a)
    pc = ML.pca(p, "poly", ML.PCA_K, out="pca")
    cols = [f"pc{i}" for i in range(ML.PCA_K)]
    wide = pc.select("pair_id", *[F.col("pca")[i].alias(c) for i, c in enumerate(cols)])
    return ML.standardize(wide, cols).select("pair_id", F.array(*cols).alias("pca"))


def _augment_sql(cols=("query_len", "title_len", "jaccard"), t=2, seed=2019) -> str:
    def h(sd):
        return f"('0x' || substr(md5('{sd}:' || cast(pair_id as varchar)), 1, 15))::bigint"
    parts = [f"select pair_id, label, {', '.join(cols)}, 0 copy from base"]
    for cls, n in ((1, t), (0, t // 2)):
        for j in range(n):
            sub = [f"(select row_number() over (order by {h(seed * 1000 + j)}) - 1 r "
                   f"from base where label = {cls}) r0"]
            for ci, c in enumerate(cols):
                sub.append(f"join (select row_number() over (order by {h(seed * 1000 + j * 97 + ci + 1)}) - 1 r, {c} "
                           f"from base where label = {cls}) c{ci} using (r)")
            parts.append(f"select null::bigint pair_id, {cls} label, {', '.join(f'c{ci}.{c}' for ci, c in enumerate(cols))}, "
                         f"{j + 1} copy from {' '.join(sub)}")
    return f"""
with base as (select f.pair_id, b.label, {', '.join('f.' + c for c in cols)}
              from ({TOKEN_SET_SQL}) f
              join (select o_orderkey pair_id, cast(o_orderstatus = 'F' as int) label from orders) b
              using (pair_id))
""" + "\nunion all\n".join(parts)


@register("augment_shuffle", _augment_sql())
def q_augment_shuffle(spark, sf_dir):
    """#123 oversampling with per-class column permutation (t = 2)."""
    cols = ["query_len", "title_len", "jaccard"]
    f = token_set_features(cleaned_pairs(spark, sf_dir), keep=("pair_id", "label"))
    f = written(f.select("pair_id", "label", *cols), "features")       # read by the rows and by every ordering
    return ML.augment_shuffle(f, cols, "pair_id", "label", ML.AUGMENT_T)


# ------------------------------------------------------------- folds
@register("kfold", with_fixtures("basket_pairs", f"""
select pair_id, cast({_HASH_SQL} % 5 as int) fold from basket_pairs"""))
def q_kfold(spark, sf_dir):
    """#124 shuffled 5-fold assignment."""
    return kfold(basket_pairs(spark, sf_dir).select("pair_id"), 5)


@register("stratified_kfold", with_fixtures("basket_pairs", f"""
select pair_id, label, cast((row_number() over (partition by label order by {_HASH_SQL}) - 1) % 5 as int) fold
from basket_pairs"""))
def q_stratified_kfold(spark, sf_dir):
    """#125 exactly stratified 5-fold assignment."""
    return stratified_kfold(basket_pairs(spark, sf_dir).select("pair_id", "label"), 5)


# ------------------------------------------------------------- models
def _assembled(spark, sf_dir):
    f = _features(spark, sf_dir)
    return cut_lineage(ML.assemble(f, feature_names(), "features"))


@register("train_lr_l1")
def q_train_lr_l1(spark, sf_dir):
    """#126 L1 logistic regression (C = 0.3) on the pair features."""
    a = _assembled(spark, sf_dir)
    tr = a.where(F.col("split") == "train")
    m = ML.lr_l1(tr.count(), ML.LR_C).fit(tr)
    return ML.positive_probability(m.transform(a)).select("pair_id", "split", "label", "prediction")


@register("train_lr_incremental")
def q_train_lr_incremental(spark, sf_dir):
    """#127 incremental training as a stream: train-split features land in
    files of about 5,000 rows, each an epoch that moves the weights and is
    forgotten; a micro-batch takes up some of them.  The last weights score every row."""
    names = feature_names()
    f = cut_lineage(_features(spark, sf_dir))
    train = f.where(F.col("split") == "train").select("pair_id", "label", *names)
    landing, _ = online.landed(train, spark)
    q, base = online.online_lr_stream(spark, landing, train.schema, names, file_epochs=online.FILES)
    q.awaitTermination()
    return online.scored(f, online.read_state(spark, base, names)).select("pair_id", "split", "label", "prediction")


@register("online_lr_check", with_fixtures("basket_pairs", """
select cast(ceil(count(*) / 5000.0) as int) n_epochs, count(*) n_rows, true learns, true forgets from basket_pairs"""))
def q_online_lr_check(spark, sf_dir):
    """#127 on a label that the features decide (longer query than title):
    epochs, rows learned from, whether the ranking is nearly right, and whether
    no more than the newest versions are kept."""
    names = TOKEN_SET_FEATURES
    f = q_token_set_features(spark, sf_dir).withColumn("label", (F.col("query_len") > F.col("title_len")).cast("int"))
    f = cut_lineage(f.select("pair_id", "label", *names))
    landing, _ = online.landed(f, spark)
    q, base = online.online_lr_stream(spark, landing, f.schema, names, file_epochs=online.FILES)
    q.awaitTermination()
    state = online.read_state(spark, base, names)
    kept = len(online._versions(spark, base))
    return auc(online.scored(f, state), "prediction", "label").select(
        F.lit(state.epochs).alias("n_epochs"), F.lit(state.rows).cast("long").alias("n_rows"),
        (F.col("auc") > 0.95).alias("learns"), F.lit(kept <= online.KEEP).alias("forgets"))


@register("train_gbt")
def q_train_gbt(spark, sf_dir):
    """#128 boosted trees cut at the best validation round (2,000 rounds at
    most, patience 300)."""
    a = _assembled(spark, sf_dir)
    m = ML.fit_boosted(a.where(F.col("split") == "train"), a.where(F.col("split") == "test"))
    return ML.positive_probability(m.transform(a)).select("pair_id", "split", "label", "prediction")


@register("gbt_check", with_fixtures("basket_pairs", """
select 30 n_trees, count(*) n_rows, true learns, true uses_lengths from basket_pairs"""))
def q_gbt_check(spark, sf_dir):
    """#128 on a label that the features decide (longer query than title), 30
    rounds: the loss falls to the last, the ranking is right, and the features
    that decide carry the gain."""
    names = TOKEN_SET_FEATURES
    f = q_token_set_features(spark, sf_dir).withColumn("label", (F.col("query_len") > F.col("title_len")).cast("int"))
    a = cut_lineage(ML.assemble(f.select("pair_id", "label", *names), names, "features"))
    hold = F.pmod(F.xxhash64("pair_id"), F.lit(5)) == 0
    m = ML.fit_boosted(a.where(~hold), a.where(hold), max_iter=30, patience=5)
    heavy = float(m.featureImportances.toArray().max()) > 0.2
    return auc(ML.positive_probability(m.transform(a)), "prediction", "label").select(
        F.lit(m.getNumTrees).alias("n_trees"), (F.col("n_pos") + F.col("n_neg")).alias("n_rows"),
        (F.col("auc") > 0.99).alias("learns"), F.lit(heavy).alias("uses_lengths"))


@register("feature_importance")
def q_feature_importance(spark, sf_dir):
    """#129 importance in the trees of #128 next to the L1-LR coefficient, per
    feature."""
    a = _assembled(spark, sf_dir)
    tr = a.where(F.col("split") == "train")
    g = ML.fit_boosted(tr, a.where(F.col("split") == "test"))
    lr = ML.lr_l1(tr.count(), ML.LR_C).fit(tr)
    rows = ML.feature_importance(feature_names(), g, lr)
    return spark.createDataFrame(rows, "feature string, gbt double, lr double")


def _split_terms(spark, sf_dir):
    t = stratified_kfold(_text_terms(spark, sf_dir), 5)
    t = t.withColumn("split", F.when(F.col("fold") == 0, "test").otherwise("train"))
    return ML.numbered_rows(t)


@register("train_text_linear")
def q_train_text_linear(spark, sf_dir):
    """#130 linear text classifier on word 1-2-grams (min count 50, 25 rounds)."""
    t = _split_terms(spark, sf_dir)
    scored = ML.fit_text_linear(t.where(F.col("split") == "train"), t, "terms", "label")
    return scored.select("pair_id", "split", "label", "prediction")


@register("train_mlp")
def q_train_mlp(spark, sf_dir):
    """#131 multilayer perceptron on the standardised pair features."""
    names = feature_names()
    f = written(_features(spark, sf_dir).select("pair_id", "split", "label", *names), "split-features")
    s = written(ML.assemble(ML.standardize(f, names), names, "features").select(
        "pair_id", "split", "label", "features"), "standardised")
    m = ML.mlp(len(names)).fit(s.where(F.col("split") == "train"))
    return ML.positive_probability(m.transform(s)).select("pair_id", "split", "label", "prediction")


_NB_SQL = with_fixtures("dialogue_pairs", """
select pair_id, split, label,
  1 / (1 + exp(-(ln((p.c1 + 1) / (p.c0 + 1)) + coalesce(w + k * ln((s.c0 + v) / (s.c1 + v)), 0)))) prediction
from split left join each using (pair_id), s, p""", extra=_TERMS_SQL + f""",
split as (select terms.*, case when (row_number() over (partition by label order by {_HASH_SQL}) - 1) % 5 = 0
            then 'test' else 'train' end split from terms),
ex as (select pair_id, split, label, unnest(terms) term from split),
c as (select term, count(*) filter (label = 1) c1, count(*) filter (label = 0) c0 from ex where split = 'train' group by term),
s as (select sum(c1)::double c1, sum(c0)::double c0, count(*)::double v from c),
p as (select count(*) filter (label = 1) c1, count(*) filter (label = 0) c0 from split where split = 'train'),
each as (select pair_id, sum(ln((c1 + 1) / (c0 + 1))) w, count(*) k from ex join c using (term) group by pair_id)""")


@register("train_nb", _NB_SQL)
def q_train_nb(spark, sf_dir):
    """#132 multinomial naive Bayes on n-gram counts."""
    t = _split_terms(spark, sf_dir)
    return ML.naive_bayes_scores(t.where(F.col("split") == "train"), t).select("pair_id", "split", "label", "prediction")


@register("cv_ensemble")
def q_cv_ensemble(spark, sf_dir):
    """#133 chunked vectorizer + 5-fold L1-LR ensemble, mean prediction per row."""
    t = _text_terms(spark, sf_dir)
    return ML.cv_ensemble(t, t, "pair_id", "terms", "label", chunk_size=5_000_000, k=5, C=0.2,
                          min_df=ML.NGRAM_MIN_DF)[0]


@register("cv_ensemble_check", with_fixtures("dialogue_pairs", """
select count(*) n_rows, 5 * cast(ceil(count(*) / 100.0) as bigint) least_models,
       5 * cast(ceil(count(*) / 100.0) as bigint) most_models, 5 * cast(ceil(count(*) / 100.0) as bigint) n_aucs
from dialogue_pairs"""))
def q_cv_ensemble_check(spark, sf_dir):
    """#133 in chunks of 100 rows: every row is scored by every chunk and fold,
    and every chunk and fold has a held-out AUC."""
    t = _text_terms(spark, sf_dir)
    preds, aucs = ML.cv_ensemble(t, t, chunk_size=100, k=5, C=0.2, min_df=20, rounds=6)
    return preds.agg(F.count(F.lit(1)).alias("n_rows"), F.min("n_models").alias("least_models"),
                     F.max("n_models").alias("most_models")).withColumn(
        "n_aucs", aucs.agg(F.count(F.lit(1))).scalar())
