"""Quality classifier (operator 10): attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE_WORDS`` words; labels are known
for documents only.  Every passage is encoded from how it is written (rates of
character-class pairs, word shapes, repetition).  A gated attention, learned
from the document labels, weighs the passages, and the weighted passage
representation is scored.

Fit.  At most ``max_train`` labelled documents (a documented bound) are encoded
once and stored in ``SHARDS`` parts.  In each round, every part trains a copy
of the parameters for a few epochs in its own task, and the copies (a few
thousand numbers each) are averaged.  The parts are fixed by a hash of the id,
so the model does not depend on the cluster.

Score.  Every passage of every whole text, in one pass without a shuffle.

Edge cases: null text is the empty text; a text without words is one passage
of zeros; null labels and labels of unknown documents are not used; without
labels the untrained model scores; repeated rows are scored as often as they
stand there; a null id is not held out; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickpair.llm.common import _FOLD, hand_back, hash_prefix, row_chunks, span_hash, stored, text_buffer, word_spans
from clickpair.llm.toxicity import CUT, STEP_BYTES, held_out, training_rows

PASSAGE_WORDS = 48
SHARDS = 4
#: Character classes: lower case, upper case, digit, blank, line end, sentence
#: mark, symbol, other bytes (parts of non-ASCII letters).
CLASSES = 8
WIDTH = CLASSES * CLASSES + 6

_CLASS = np.full(256, 6, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[9, 11, 12, 32]], _CLASS[[10, 13]] = 3, 4
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 5
_CLASS[128:] = 7


def encode_passages(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features per passage, index of each text's first passage, n + 1)."""
    start, end, first = word_spans(buf, off)
    words = np.diff(first)
    per = np.maximum(1, -(-words // PASSAGE_WORDS))
    bag = np.concatenate(([0], np.cumsum(per)))
    n = int(bag[-1])
    out = np.zeros((n, WIDTH), np.float32)
    if not len(start):
        return out, bag
    doc = np.repeat(np.arange(len(words)), words)
    within = np.arange(len(start)) - first[doc]
    passage = bag[doc] + within // PASSAGE_WORDS
    head = np.concatenate(([True], passage[1:] != passage[:-1]))
    lo = start[head]
    hi = end[np.append(np.flatnonzero(head)[1:], len(start)) - 1]
    own = passage[head]                            # passages with words
    # pairs of neighbouring characters inside each passage
    kind = _CLASS[buf].astype(np.int64)
    pair = kind[:-1] * CLASSES + kind[1:]
    size = np.maximum(hi - lo - 1, 0)
    at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    row = np.repeat(np.arange(len(own)), size)
    rate = np.bincount(row * CLASSES**2 + pair[at], minlength=len(own) * CLASSES**2).reshape(-1, CLASSES**2)
    feature = np.zeros((len(own), WIDTH), np.float32)
    feature[:, :CLASSES**2] = np.sqrt(rate / np.maximum(size, 1)[:, None])
    # words: lengths, capitals, and how many have stood before
    count = np.bincount(passage, minlength=n)[own]
    mean = lambda x: np.bincount(passage, x, minlength=n)[own] / count
    length = (end - start).astype(float)
    hashes = span_hash(hash_prefix(_FOLD[buf]), start, end)

    def again(group, key):
        order = np.lexsort((key, group))
        seen = np.zeros(len(key), bool)
        seen[order[1:]] = (key[order[1:]] == key[order[:-1]]) & (group[order[1:]] == group[order[:-1]])
        return seen

    window = hashes.copy()
    window[:-1] += hashes[1:] * np.uint64(3)
    window[:-2] += hashes[2:] * np.uint64(5)
    k = CLASSES**2
    feature[:, k] = mean(length) / 10
    feature[:, k + 1] = mean(_CLASS[buf[start]] == 1)
    feature[:, k + 2] = mean(again(passage, hashes))
    feature[:, k + 3] = mean(again(doc, window))
    feature[:, k + 4] = np.sqrt(count / PASSAGE_WORDS)
    feature[:, k + 5] = mean(length > 12)
    out[own] = feature
    return out, bag


def start_parameters(hidden: int = 16, seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    mat = lambda a, b: rng.normal(0, a ** -0.5, (a, b))
    return {"encode": mat(WIDTH, hidden), "shift": np.zeros(hidden), "tanh": mat(WIDTH, hidden),
            "gate": mat(WIDTH, hidden), "attend": np.zeros(hidden), "score": rng.normal(0, 0.1, hidden),
            "bias": np.zeros(1)}


def forward(p: dict, x: np.ndarray, bag: np.ndarray) -> dict:
    first = bag[:-1]
    of = np.repeat(np.arange(len(first)), np.diff(bag))
    code = np.tanh(x @ p["encode"] + p["shift"])
    t, g = np.tanh(x @ p["tanh"]), 1 / (1 + np.exp(-(x @ p["gate"])))
    s = (t * g) @ p["attend"]
    weight = np.exp(s - np.maximum.reduceat(s, first)[of])
    weight /= np.add.reduceat(weight, first)[of]
    z = np.add.reduceat(weight[:, None] * code, first, axis=0)
    logit = z @ p["score"] + p["bias"][0]
    return {"of": of, "code": code, "t": t, "g": g, "weight": weight, "z": z,
            "p": 1 / (1 + np.exp(-np.clip(logit, -500, 500)))}


def gradient(p: dict, x: np.ndarray, bag: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    f = forward(p, x, bag)
    of, w = f["of"], f["weight"]
    d = (f["p"] - y) / len(y)
    dz = (d[:, None] * p["score"])[of]
    dcode = w[:, None] * dz * (1 - f["code"] ** 2)
    dw = (f["code"] * dz).sum(1)
    ds = w * (dw - np.add.reduceat(w * dw, bag[:-1])[of])
    dh = ds[:, None] * p["attend"]
    return {"encode": x.T @ dcode, "shift": dcode.sum(0),
            "tanh": x.T @ (dh * f["g"] * (1 - f["t"] ** 2)),
            "gate": x.T @ (dh * f["t"] * f["g"] * (1 - f["g"])),
            "attend": (f["t"] * f["g"]).T @ ds, "score": f["z"].T @ d, "bias": np.array([d.sum()])}


def train_epochs(p: dict, x: np.ndarray, bag: np.ndarray, y: np.ndarray, epochs: int,
                 rate: float, seed: int, batch: int = 16) -> dict[str, np.ndarray]:
    """Adam over mini-batches of bags."""
    p = {k: v.copy() for k, v in p.items()}
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    rng, step = np.random.default_rng(seed), 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), batch):
            some = order[lo:lo + batch]
            lens = bag[some + 1] - bag[some]
            at = np.repeat(bag[some] - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))
            g = gradient(p, x[at], np.concatenate(([0], np.cumsum(lens))), y[some])
            step += 1
            for k in p:
                g_k = g[k] + 1e-4 * p[k]
                m[k] = 0.9 * m[k] + 0.1 * g_k
                v[k] = 0.999 * v[k] + 0.001 * g_k**2
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return p


def encoded(rows: DataFrame) -> DataFrame:
    """(doc_id, label, x) with x the passages' features, one after another."""
    def run(batches):
        for batch in batches:
            buf, off = text_buffer(batch.column(1))
            for lo, hi in row_chunks(off, STEP_BYTES):
                x, bag = encode_passages(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo),
                     pa.ListArray.from_arrays(pa.array(bag * WIDTH, pa.int32()), pa.array(x.ravel()))],
                    ["doc_id", "label", "x"])
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "text", "label").mapInArrow(
        run, f"doc_id {kind}, label int, x array<float>")


def fit(docs: DataFrame, labels: DataFrame, max_train: int = 6000, rounds: int = 6, epochs: int = 5,
        id_col: str = "doc_id", text_col: str = "text") -> dict[str, np.ndarray]:
    rows = training_rows(docs, labels, "quality", 5, 0, max_train, id_col, text_col)
    bags = stored(encoded(rows).withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(SHARDS))).repartition(
        SHARDS, "shard"), "quality-train").repartition(SHARDS, "shard")
    spark = docs.sparkSession
    params = start_parameters()
    names, shapes = list(params), {k: a.shape for k, a in params.items()}
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast(params)
        rate = 0.01 * (1 - turn / (rounds + 1))

        def learn(key, table):
            import pandas as pd
            table = table.sort_values("doc_id", kind="stable")
            lens = table["x"].map(len).to_numpy() // WIDTH
            x = np.concatenate(table["x"].to_list()).reshape(-1, WIDTH).astype(np.float64)
            p = train_epochs(shared.value, x, np.concatenate(([0], np.cumsum(lens))),
                             table["label"].to_numpy(float), epochs, rate, 100 * turn + int(key[0]))
            return pd.DataFrame({"n": [len(table)], "p": [np.concatenate([p[k].ravel() for k in names])]})

        parts = bags.groupBy("shard").applyInPandas(learn, "n long, p array<double>").collect()
        if not parts:
            break
        flat = sum(r["n"] * np.array(r["p"]) for r in parts) / sum(r["n"] for r in parts)
        at = 0
        for k in names:
            n = int(np.prod(shapes[k]))
            params[k] = flat[at:at + n].reshape(shapes[k])
            at += n
    return params


def with_scores(docs: DataFrame, model: dict, text_col: str = "text", name: str = "score") -> DataFrame:
    """The rows as they are, with a score column after the others."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def score(batches):
        for batch in batches:
            buf, off = text_buffer(batch.column(at))
            for lo, hi in row_chunks(off, STEP_BYTES):
                x, bag = encode_passages(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(forward(shared.value, x, bag)["p"])],
                                                 [*part.schema.names, name])
            batch = buf = off = x = bag = part = None
            hand_back()

    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def quality(docs: DataFrame, labels: DataFrame, model: dict | None = None,
            id_col: str = "doc_id", text_col: str = "text", **fit_args) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``."""
    model = model or fit(docs, labels, id_col=id_col, text_col=text_col, **fit_args)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return with_scores(rows, model).select(
        "doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"))
