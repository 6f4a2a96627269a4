"""Steps that large tables run through: what they read, and how often."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from clickpair.functions import vectors as V
from clickpair.operators import embed as EM
from clickpair.operators import metrics as M
from clickpair.operators import ml as ML
from clickpair.operators.grouping import token_counts
from clickpair.operators.sequence import next_in_group
from clickpair.plans import ml_queries as Q
from clickpair.streaming import online
from tests.conftest import SF_MID


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_large_and_null_groups_match_a_plain_window(spark):
    d = spark.range(400).select(
        F.col("id").alias("o"), F.when(F.col("id") % 5 == 0, None).when(F.col("id") % 2 == 0, 1).otherwise(
            F.col("id") % 97).alias("g"), F.col("id").cast("string").alias("v"))
    w = Window.partitionBy("g").orderBy("o")
    want = d.withColumn("n", F.lead("v").over(w))
    got = next_in_group(d, "g", "o", {"v": "n"}, bucket_width=16)
    assert not got.exceptAll(want).count() and got.count() == 400
    more = next_in_group(d, "g", "o", {"v": "n"}, bucket_width=16, sizes=d.select("g").union(d.select("g")))
    assert not more.exceptAll(want).count()


def test_token_counts_work_runs_out_once(spark):
    d = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None), (4, "x")], "pair_id long, t string")
    got = token_counts(d, "t")
    assert {tuple(r) for r in got.collect()} == {(1, "a", 2), (1, "b", 1), (2, "", 1), (4, "x", 1)}
    assert plan(got).count("zip_with") == 1               # before: once more in a filter below the explode


def test_grouped_auc_in_windows_and_ranges(spark, monkeypatch):
    d = spark.range(3000).select((F.col("id") % 7 % 3).alias("g"), (F.pmod(F.xxhash64("id"), F.lit(50)) / 50).alias("s"),
                                 F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2)).cast("int").alias("y"))
    one = {r["g"]: r for r in M.grouped_auc(d, ["g"], "s", "y").collect()}
    monkeypatch.setattr(M, "GROUP_SCORES", 10)
    two = {r["g"]: r for r in M.grouped_auc(d, ["g"], "s", "y").collect()}
    assert one == two and len(one) == 3
    t = d.where("g = 1").toPandas()
    p, n = t[t.y == 1].s.values[:, None], t[t.y == 0].s.values[None]
    assert abs(one[1]["auc"] - ((p > n) + (p == n) / 2).mean()) < 1e-12


def test_one_hot_names_no_places_on_the_driver(spark):
    d = spark.createDataFrame([(1, 30), (2, 10), (3, 30), (4, None)], "id long, c long")
    oh = ML.one_hot(d, "c")
    got = {r["id"]: (r["c_index"], r["one_hot"]) for r in oh.collect()}
    assert [got[i][0] for i in (1, 2, 3, 4)] == [1.0, 0.0, 1.0, None]
    assert got[1][1].size == 3 and got[1][1].indices.tolist() == [1] and got[1][1].values.tolist() == [1.0]
    assert got[4][1] is None and not oh.schema["one_hot"].metadata


def test_stored_features_are_not_worked_out_again(spark):
    for q in (Q.q_pca, Q.q_augment_shuffle):
        assert "lineitem" not in plan(q(spark, SF_MID)) and "l_orderkey" not in plan(q(spark, SF_MID))


def test_small_word_tables_are_summed_in_their_batch(spark, monkeypatch):
    d = spark.createDataFrame([(1, "a b a x", "c", 5), (2, "", None, 6), (3, "x", "a", 7), (4, "b " * 50 + "c", "b", 8)],
                              "pair_id long, query string, title string, label int")
    v = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [0.5, -1.0]), ("c", [0.0, 3.0]), ("c", [1.0, 1.0]), (None, [9.0, 9.0]),
                               ("x", None)], "word string, vector array<double>")
    rows = lambda s: {r["pair_id"]: tuple(r) for r in s.collect()}
    plain = rows(EM.sentence_sums(d, v, keep=["label"]).select("pair_id", "q_vec_sum", "q_n_known", "t_vec_sum", "t_n_known", "label"))
    for most in (EM.MATRIX_BYTES, 100):                   # 100: tokens are looked up six at a time
        monkeypatch.setattr(EM, "MATRIX_BYTES", most)
        got = EM.sentence_sums(d, v, keep=["label"], unique=True)
        assert "Aggregate" not in plan(got) and "Join" not in plan(got)
        assert rows(got.select("pair_id", "q_vec_sum", "q_n_known", "t_vec_sum", "t_n_known", "label")) == plain
    assert plain[1][1:3] == ([2.5, 3.0], 3) and plain[2][1:5] == (None, None, None, None) and plain[1][4] == 2
    monkeypatch.setattr(EM, "MATRIX_BYTES", 16)           # one word: too large, tokens meet the table in a join
    assert "Join" in plan(EM.sentence_sums(d, v, unique=True))


def test_distances_by_batch_equal_the_native_sums(spark):
    rows = [(1, [1.0, 2.0, 1.5], [2.0, 1.0, 1.25]), (2, [1.0] * 5, [3.0] * 5), (3, None, [1.0]),
            (5, [0.5, float("nan")], [1.0, 2.0]), (6, [1.0, 2.0], None), (7, [1.0, -2.0], [3.0, 1.0])]
    d = spark.createDataFrame(rows, "id int, x array<double>, y array<double>")
    needs = sorted({k for n in V.DISTANCES.values() for k in n[0]})
    native = d.select("id", V.pair_sums("x", "y", needs).alias("s")).select("id", "s.*")
    got = {r["id"]: r for r in V.with_distances(d, "x", "y", keep=["id"]).collect()}
    plain = {r["id"]: r for r in native.collect()}
    for i in (1, 2):
        assert abs(got[i]["kullback_leibler"] - plain[i]["kl"]) < 1e-12 and abs(got[i]["manhattan"] - plain[i]["gap"]) < 1e-12
    assert got[3]["manhattan"] is None and got[6]["euclidean"] is None and got[3]["cosine_w2v"] == 0.0
    assert got[7]["kullback_leibler"] is None and got[7]["manhattan"] == 5.0
    many = pa.array([v for _, v, _ in rows[:2]]), pa.array([v for _, _, v in rows[:2]])
    for i, r in enumerate(V.positive_sums(*many, needs).to_pylist()):
        assert all(abs(r[k] - plain[i + 1][k]) < 1e-12 for k in needs)


def test_small_batches_are_learned_in_one_task(spark, monkeypatch):
    d = spark.range(700).select(*[((F.abs(F.xxhash64("id", F.lit(k))) % 1000) / 1000.0).alias(c) for k, c in enumerate("ab")])
    rows = d.withColumn("label", (F.col("a") > F.col("b")).cast("int")).select(*online.feature_row(["a", "b"], "label"))
    start, jobs = online.LinearState.zero(["a", "b"]), []
    sums = online.gradient_sums
    monkeypatch.setattr(online, "gradient_sums", lambda *a: jobs.append(1) or sums(*a))
    one, again = online.learn(rows, start), online.learn(rows.repartition(5), start)
    assert not jobs and np.array_equal(one.weights, again.weights) and one.loss == again.loss     # before: 16 jobs
    monkeypatch.setattr(online, "TASK_ROWS", 100)
    steps = online.learn(rows, start)
    assert len(jobs) == online.STEPS * online.PASSES and steps.rows == one.rows == 700
    assert np.allclose(steps.weights, one.weights, atol=1e-9) and abs(steps.loss - one.loss) < 1e-9


def test_long_texts_reach_python_in_bounded_batches(spark):
    """However many long texts a partition holds, few bytes stand in a batch."""
    import pyarrow as pa

    import corpus_pipeline
    from clickpair.llm.common import BATCH_BYTES
    corpus_pipeline._ready(spark)
    texts = spark.range(2000).coalesce(1).selectExpr("repeat('x', 10000) text")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])
    got = [r.n for r in texts.mapInArrow(sizes, "n long").collect()]
    assert sum(got) == 2000 and max(got) * 10_000 <= BATCH_BYTES + 20_000


def test_texts_are_encoded_in_small_steps(monkeypatch):
    """A step's arrays take many times its texts: 2 MB a step before."""
    import pyarrow as pa

    from clickpair.llm import bpe
    encoder, sizes = bpe.Encoder(bpe.Vocabulary(bpe.default_vocabulary())), []
    encode = encoder.encode
    monkeypatch.setattr(encoder, "encode", lambda buf, off: sizes.append(len(buf)) or encode(buf, off))
    texts = [f"text {k} of words " * 600 for k in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(texts)], ["doc_id", "text"])
    got = [ids[a:b].tolist() for _, ids, at in bpe.encoded_batches([batch], encoder) for a, b in zip(at[:-1], at[1:])]
    assert max(sizes) <= 600_000 and sum(sizes) == sum(map(len, texts))
    assert got[7] == encode(np.frombuffer(texts[7].encode(), "u1"), np.array([0, len(texts[7])]))[0].tolist()
