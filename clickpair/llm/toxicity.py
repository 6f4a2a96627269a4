"""Toxicity (operator 7): a linear classifier over character n-grams whose
features are scaled by naive Bayes log-count ratios.

Fit.  At most ``max_train`` labelled documents (a documented bound, taken in
the order of a hash of their id) meet their texts by a broadcast of ids and
labels.  Tasks list each text's distinct n-gram buckets, Spark counts them per
class, and the ``n_features`` buckets whose log-count ratio stands out most
against its standard error are kept.  Spark's logistic regression is trained on
their presence, scaled by the ratios.

Score.  Every whole text of every document: one pass, no shuffle, with the
few thousand weights broadcast.  Only the text enters a score.

Edge cases: null text is the empty text, which has no n-grams and scores the
intercept; null labels and labels of unknown documents are not used; without
labels of both classes every score is the smoothed share of toxic labels;
repeated rows are scored as often as they stand there; a null id is not held
out; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickpair.llm.common import _FOLD, mix64, row_chunks, stored, text_buffer

ORDERS = (4, 5, 6)
BUCKET_BITS = 20
STEP_BYTES = 1 << 18        # text bytes of a numpy step
CUT = 0.3


def ngram_buckets(buf: np.ndarray, off: np.ndarray):
    """For each n: (row of each n-gram, its bucket).  Characters are code
    points, A-Z folded, white space as a blank; none crosses a text."""
    folded = _FOLD[buf]
    chars = np.frombuffer(folded.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4")
    chars = np.where((chars >= 9) & (chars <= 13), 32, chars).astype(np.uint64)
    heads = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
    lens = np.diff(heads[off])
    row = np.repeat(np.arange(len(lens)), lens)
    room = np.repeat(np.cumsum(lens), lens) - np.arange(len(chars))
    h = np.zeros(len(chars), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if len(h) < n:
            return
        h = h[:len(chars) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + chars[n - 1:]
        if n in ORDERS:
            fits = room[:len(h)] >= n
            bucket = mix64(h + np.uint64(n)) >> np.uint64(64 - BUCKET_BITS)
            yield row[:len(h)][fits], bucket[fits].astype(np.int64)


def held_out(key, folds: int, fold: int):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % folds == fold, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int,
                  max_train: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, label) of at most ``max_train`` labels outside the fold."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label).cast("int").alias("label")).where(
        F.col("label").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out("doc_id", folds, fold))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_train)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(
        F.broadcast(some), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, max_train: int = 6000, n_features: int = 4096,
        id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Weights per bucket and the intercept."""
    rows = training_rows(docs, labels, "toxic", 4, 2, max_train, id_col, text_col)

    def list_buckets(batches):
        for batch in batches:
            buf, off = text_buffer(batch.column(1))
            for lo, hi in row_chunks(off, STEP_BYTES):
                keys = [r.astype(np.int64) << BUCKET_BITS | b
                        for r, b in ngram_buckets(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])]
                keys = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
                ends = np.searchsorted(keys >> BUCKET_BITS, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(2).slice(lo, hi - lo),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()),
                                              pa.array((keys & ((1 << BUCKET_BITS) - 1)).astype(np.int32)))],
                    ["label", "buckets"])

    bags = stored(rows.mapInArrow(list_buckets, "label int, buckets array<int>"), "toxic-train")
    sizes = {r["label"]: r["count"] for r in bags.groupBy("label").count().collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    if not pos or not neg:
        return {"bucket": [], "weight": [], "intercept": math.log((pos + 1) / (neg + 1))}
    counts = bags.select("label", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(
        F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("q"))
    ratio = F.log((F.col("p") + 1) / (pos + 2)) - F.log((F.col("q") + 1) / (neg + 2))
    error = F.sqrt(1 / (F.col("p") + 1) + 1 / (F.col("q") + 1))
    best = counts.withColumn("ratio", ratio).orderBy(F.desc(F.abs("ratio") / error), "bucket").limit(
        n_features).collect()
    chosen = docs.sparkSession.sparkContext.broadcast(np.sort([r["bucket"] for r in best]))

    def keep_chosen(batches):
        for batch in batches:
            lists = batch.column(1)
            flat, at = lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(lists.value_lengths())))
            hit = np.isin(flat, chosen.value)
            ends = np.concatenate(([0], np.cumsum(hit)))[at]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()),
                                                           pa.array(flat[hit]).cast(pa.string()))],
                ["label", "terms"])

    terms = bags.coalesce(8).mapInArrow(keep_chosen, "label int, terms array<string>")
    vectors = CountVectorizerModel.from_vocabulary(
        [str(r["bucket"]) for r in best], inputCol="terms", outputCol="present", minTF=1.0)
    scale = ElementwiseProduct(scalingVec=Vectors.dense([r["ratio"] for r in best]),
                               inputCol="present", outputCol="features")
    train = scale.transform(vectors.transform(terms)).select("label", "features").persist()
    model = LogisticRegression(maxIter=40, regParam=1e-3, standardization=False).fit(train)
    train.unpersist()
    return {"bucket": [r["bucket"] for r in best],
            "weight": [c * r["ratio"] for c, r in zip(model.coefficients.toArray().tolist(), best)],
            "intercept": float(model.intercept)}


def toxicity(docs: DataFrame, labels: DataFrame, model: dict | None = None,
             id_col: str = "doc_id", text_col: str = "text", **fit_args) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``."""
    model = model or fit(docs, labels, id_col=id_col, text_col=text_col, **fit_args)
    shared = docs.sparkSession.sparkContext.broadcast(
        (np.array(model["bucket"], np.int64), np.array(model["weight"]), model["intercept"]))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def score(batches):
        bucket, weight, intercept = shared.value
        slot = np.full(1 << BUCKET_BITS, -1, np.int16)
        slot[bucket] = np.arange(len(bucket))
        for batch in batches:
            buf, off = text_buffer(batch.column(1))
            for lo, hi in row_chunks(off, STEP_BYTES):
                keys = []
                for r, b in ngram_buckets(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]):
                    s = slot[b]
                    hit = s >= 0
                    keys.append(r[hit] << 16 | s[hit])
                keys = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
                total = np.bincount(keys >> 16, weight[keys & 0xFFFF] if len(weight) else None, hi - lo)
                p = 1 / (1 + np.exp(-np.clip(total + intercept, -500, 500)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(p)],
                                                 ["doc_id", "score"])

    return rows.mapInArrow(score, f"doc_id {kind}, score double").select(
        "doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"))
