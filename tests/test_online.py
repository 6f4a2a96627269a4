"""Online training: cost, replay, restarts and what is learned."""

import os
import shutil
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickpair.operators.metrics import auc
from clickpair.streaming import online

NAMES = ["a", "b", "c"]
SCHEMA = "id long, a double, b double, c double, label int"


def rows(spark, n, start=0):
    u = [((F.abs(F.xxhash64("id", F.lit(k))) % 1000) / 1000.0).alias(c) for k, c in enumerate(NAMES)]
    d = spark.range(start, start + n).select("id", *u)
    return d.withColumn("label", (F.col("a") > F.col("b")).cast("int"))


def plain_gradient(x, y, w):
    p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    return np.append((p - y) @ x, (p - y).sum())


def test_gradient_and_step(spark):
    d = rows(spark, 500).repartition(5)
    w = np.array([0.3, -0.2, 0.0, 0.1])
    got, loss, n = online.gradient_sums(d.select(*online.feature_row(NAMES, "label")), w)
    t = d.toPandas()
    x, y = t[NAMES].to_numpy(), t["label"].to_numpy()
    assert n == 500 and np.allclose(got, plain_gradient(x, y, w))
    z = x @ w[:-1] + w[-1]
    assert abs(loss - np.sum(np.log1p(np.exp(z)) - y * z)) < 1e-6
    s = online.proximal_step(online.LinearState.zero(NAMES), np.array([2.0, -1e-4, 0.0, 1.0]), alpha=0.5, rate=1.0)
    assert np.allclose(s.weights, [-0.75, 0.0, 0.0, -1.0])        # soft threshold; the intercept keeps its step


def test_replayed_batch_gives_equal_weights(spark):
    base = tempfile.mkdtemp(prefix="clickpair-online-")
    one, two = rows(spark, 300), rows(spark, 300, 300)
    first = online.learn_batch(one, 0, base, NAMES, steps=3)
    after = online.learn_batch(two, 1, base, NAMES, steps=3)
    again = online.learn_batch(two.repartition(3), 1, base, NAMES, steps=3)      # replay, dealt otherwise
    assert np.allclose(after.weights, again.weights, rtol=0, atol=1e-9) and after.rows == again.rows == 600
    exact = online.learn_batch(two, 1, base, NAMES, steps=3)
    assert np.array_equal(after.weights, exact.weights)
    assert np.array_equal(online.read_state(spark, base, NAMES, below=1).weights, first.weights)


def test_stream_learns_restarts_and_forgets(spark):
    src = tempfile.mkdtemp(prefix="clickpair-online-src-")
    read = []

    def land(k):
        rows(spark, 120, 1000 * k).coalesce(1).write.mode("append").parquet(src)

    run = os.path.basename(tempfile.mkdtemp(prefix="run-"))
    inner = online.learn

    def counted(batch, state, **how):
        read.append(batch.count())
        return inner(batch, state, **how)
    online.learn = counted
    try:
        done = 0
        for part in (3, 2, 3):                       # three runs of one stream
            for k in range(part):
                land(done + k)
            done += part
            q, base = online.online_lr_stream(spark, src, SCHEMA, NAMES, run=run, steps=4)
            q.awaitTermination()
    finally:
        online.learn = inner
    assert read == [120] * 8                         # every epoch reads its own file only
    state = online.read_state(spark, base, NAMES)
    assert state.epoch == 7 and state.rows == 960
    assert len(online._versions(spark, base)) == online.KEEP
    assert not os.path.exists(os.path.join(base, "seen"))
    fresh = online.scored(rows(spark, 500, 10**6), state)
    assert auc(fresh, "prediction", "label").first()["auc"] > 0.97
    assert state.loss < 0.69                         # before the step, on rows not seen
    shutil.rmtree(src)


@pytest.mark.parametrize("d", [
    [(1, None, 1.0, 2.0, 1), (2, 1.0, float("nan"), 0.0, 0), (3, 1.0, 1.0, 1.0, None)],
    []])
def test_missing_values_and_empty_batches(spark, d):
    base = tempfile.mkdtemp(prefix="clickpair-online-")
    got = online.learn_batch(spark.createDataFrame(d, SCHEMA), 0, base, NAMES)
    assert got.rows == (2 if d else 0) and np.all(np.isfinite(got.weights))
    assert online.read_state(spark, base, NAMES).rows == got.rows


def test_many_files_of_a_micro_batch_are_epochs_each(spark, monkeypatch):
    """One micro-batch of nine files ends with the weights of nine micro-batches."""
    src = tempfile.mkdtemp(prefix="clickpair-online-src-")
    for k in range(9):
        d = rows(spark, 200, 1000 * k) if k != 4 else rows(spark, 60, 1000 * k).withColumn("label", F.lit(None).cast("int"))
        d.coalesce(1).write.mode("append").parquet(src)
    states, batches = [], []
    inner = online.learn_batch

    def counted(*a, **how):
        batches.append(a[1])
        return inner(*a, **how)
    monkeypatch.setattr(online, "learn_batch", counted)
    for run_rows, task_rows, how in ((0, 50_000, {}), (400_000, 50_000, {"file_epochs": 5}), (450, 50_000, {"file_epochs": 99}),
                                     (400_000, 150, {"file_epochs": 99})):
        monkeypatch.setattr(online, "RUN_ROWS", run_rows)
        monkeypatch.setattr(online, "TASK_ROWS", task_rows)
        q, base = online.online_lr_stream(spark, src, SCHEMA, NAMES, steps=4, **how)
        q.awaitTermination()
        states.append(online.read_state(spark, base, NAMES))
        assert len(online._versions(spark, base)) <= online.KEEP
    assert batches == [*range(9), 0, 1, 0, 0]
    for s in states:
        assert s.epochs == 9 and s.rows == 1600
        assert np.allclose(s.weights, states[0].weights, rtol=0, atol=1e-9) and abs(s.loss - states[0].loss) < 1e-9
    assert np.array_equal(states[1].weights, states[0].weights)
    shutil.rmtree(src)
