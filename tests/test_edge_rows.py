"""Hand-written edge rows against plain-Python versions of the formulas."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickpair.functions.tokens import token_set_features
from clickpair.functions.vectors import minmax_shift, with_distances
from clickpair.operators import metrics as M
from clickpair.operators import rates
from clickpair.operators import vectorspace as vs
from clickpair.operators.edit import edit_features

ROWS = [
    (1, "", ""),
    (2, " 1  2 ", "2 1"),
    (3, "1 2 3", "1 2 3"),
    (4, "1 2", "3 4"),
    (5, "7", "7 7"),
    (6, "A b", "a B"),
    (7, "1 2\t", "1 2"),
    (8, "5 5 5 6", "6 6 5"),
]


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(ROWS, "pair_id long, query string, title string")


def py_token(q, t):
    qs, ts = q.split(" "), t.split(" ")
    Q, T = set(qs), set(ts)
    i = len(Q & T)
    return {"query_len": len(qs), "title_len": len(ts), "query_unique": len(Q - T),
            "title_unique": len(T - Q), "query_title_same_len": i,
            "q_t_unique_len": len(set(qs + ts)), "q_t_diff_len": len(Q ^ T),
            "dice": np.float32(2 * i / (len(Q) + len(T))), "jaccard": np.float32(i / len(Q | T)),
            "samelen_query_rate": np.float32(i / len(qs)),
            "title_diff_query_t_rate": np.float32(len(T - (Q & T)) / len(ts))}


def test_token_features(pairs):
    got = {r["pair_id"]: r for r in token_set_features(pairs).collect()}
    for pid, q, t in ROWS:
        for k, v in py_token(q, t).items():
            assert got[pid][k] == pytest.approx(float(v), abs=1e-7), (pid, k)


def py_counts(text):
    return Counter(w.lower() for w in text.split(" ") if w.lower() != "")


def py_cosine(q, t):
    a, b = py_counts(q), py_counts(t)
    dot = sum(a[w] * b[w] for w in a)
    den = math.sqrt(sum(v * v for v in a.values())) * math.sqrt(sum(v * v for v in b.values()))
    return 0.0 if den == 0 else dot / den


def py_pearson(q, t):
    a, b = py_counts(q), py_counts(t)
    keys = list(dict.fromkeys(list(a) + list(b)))
    if len(keys) < 2:
        return None
    x = [a.get(k, 0) for k in keys]
    y = [b.get(k, 0) for k in keys]
    if np.std(x) == 0 or np.std(y) == 0:
        return None
    return float(np.corrcoef(x, y)[0, 1])


def test_cosine_pearson(pairs):
    got = {r["pair_id"]: r for r in vs.vector_space_features(pairs).collect()}
    for pid, q, t in ROWS:
        assert got[pid]["cosine_similarity_raw"] == pytest.approx(py_cosine(q, t)), pid
        assert got[pid]["cosine_similarity"] == pytest.approx(round(py_cosine(q, t), 2), abs=1e-6)
        p = py_pearson(q, t)
        if p is None:
            assert got[pid]["pearson"] is None, pid
        else:
            assert got[pid]["pearson"] == pytest.approx(p, abs=1e-9), pid


def test_tf_idf_stats(pairs):
    got = {r["pair_id"]: r for r in vs.text_stats(pairs).collect()}
    for pid, q, t in ROWS:
        toks = t.split(" ")
        c = np.array(list(Counter(toks).values()), dtype=float)
        L = len(toks)
        assert got[pid]["title_tf_max"] == pytest.approx((c / L).max())
        assert got[pid]["title_tf_mean"] == pytest.approx((c / L).mean())
        assert got[pid]["title_idf_mean"] == pytest.approx(np.log10(L / c).mean())
        assert got[pid]["title_tfidf_max"] == pytest.approx(((c / L) * np.log10(L / c)).max())


def lev(a, b):
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i]
        for j, cb in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
        prev = cur
    return prev[-1]


def test_edit_features(pairs):
    got = {r["pair_id"]: r for r in edit_features(pairs).collect()}
    for pid, q, t in ROWS:
        assert got[pid]["levenshtein"] == lev(q, t)
        L = len(q) + len(t)
        lcs = got[pid]["lcseque_lens"]
        assert got[pid]["ratio"] == pytest.approx(1.0 if L == 0 else 2 * lcs / L, abs=1e-6)
        assert got[pid]["levenshtein"] >= abs(len(q) - len(t))


def test_strip_tab_once(spark):
    from clickpair.functions.text import strip_tab
    df = spark.createDataFrame([("a\t\t",), ("b\t",), ("",), ("c",)], "t string")
    assert [r[0] for r in df.select(strip_tab("t")).collect()] == ["a\t", "b", "", "c"]


def test_constant_vector_is_null(spark):
    df = spark.createDataFrame([([1.0, 1.0, 1.0], [1.0, 2.0, 3.0])], "x array<double>, y array<double>")
    r = df.select(minmax_shift("x").alias("x"), minmax_shift("y").alias("y")).first()
    assert r["x"] is None and r["y"] == [1.0, 1.5, 2.0]


def test_distances_identity(spark):
    df = spark.createDataFrame([([1.0, 1.5, 2.0], [1.0, 1.5, 2.0])], "x array<double>, y array<double>")
    r = with_distances(df, "x", "y").first().asDict()
    assert r["cosine_w2v"] == pytest.approx(1.0)
    for k in ("manhattan", "euclidean", "chebyshev", "kullback_leibler", "jensen_shannon"):
        assert r[k] == pytest.approx(0.0, abs=1e-12), k


def test_unseen_key_and_single_fold_key(spark):
    train = spark.createDataFrame([(1, "a", 1), (2, "a", 0), (3, "b", 1), (4, "c", 0), (5, "c", 1)],
                                  "pair_id long, k string, label int")
    test = spark.createDataFrame([(10, "a"), (11, "zzz")], "pair_id long, k string")
    got = {r["pair_id"]: r for r in rates.apply_rate(train, test, "k").collect()}
    assert got[11]["k_rate"] is None and got[11]["k_count"] is None
    assert got[10]["k_count"] == 2
    folded = train.withColumn("fold", F.col("pair_id") % 5)
    oof = {r["pair_id"]: r for r in rates.oof_rate(folded, "k", "fold").collect()}
    assert oof[3]["k_count"] is None          # 'b' occurs only in its own fold


def test_single_class_group(spark):
    df = spark.createDataFrame([(1, 0.1, 0), (1, 0.9, 1), (2, 0.3, 1), (2, 0.4, 1)],
                               "query_id long, score double, label int")
    r = M.q_auc(df, "query_id", "score", "label").first()
    assert r["invalid_count"] == 1 and r["q_auc"] == pytest.approx((1.0 + 0.5) / 2)


def test_auc_separable(spark):
    df = spark.range(200).select(F.col("id").cast("double").alias("score"),
                                 (F.col("id") >= 100).cast("int").alias("label"))
    assert M.auc(df, "score", "label").first()["auc"] == pytest.approx(1.0)
    tied = spark.range(10).select(F.lit(0.5).alias("score"), (F.col("id") % 2).cast("int").alias("label"))
    assert M.auc(tied, "score", "label").first()["auc"] == pytest.approx(0.5)


def test_sorted_counts_equal_quadratic(spark):
    """Long texts take the sort-based count path; it must equal plain counting."""
    import random
    rng = random.Random(7)
    rows = []
    for i in range(40):
        n1, n2 = rng.randint(0, 120), rng.randint(0, 120)
        q = " ".join(rng.choice("a b c d e f g".split()) for _ in range(n1))
        t = " ".join(rng.choice("a b c d x y".split()) for _ in range(n2))
        rows.append((i, q, t))
    df = spark.createDataFrame(rows, "pair_id long, query string, title string")
    got = {r["pair_id"]: r for r in vs.vector_space_features(df).collect()}
    for pid, q, t in rows:
        assert got[pid]["cosine_similarity_raw"] == pytest.approx(py_cosine(q, t), abs=1e-12), pid
        p = py_pearson(q, t)
        assert (got[pid]["pearson"] is None) == (p is None), pid
        if p is not None:
            assert got[pid]["pearson"] == pytest.approx(p, abs=1e-9), pid
