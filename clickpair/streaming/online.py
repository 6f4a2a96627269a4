"""Online training of a linear classifier over arriving feature files.

Every micro-batch moves the weights by proximal stochastic gradient steps
(logistic loss, L1 by soft thresholding, one AdaGrad rate per weight) and is
then forgotten: an epoch costs what its own files cost, however many came
before.  The weights live in a versioned table, one folder an epoch; epoch e
starts from the newest version below e and writes version e, so a batch that is
replayed after a failure replaces its own version with equal weights.

The rows of a batch are dealt to ``steps`` mini-batches by hash.  A batch of at
most ``TASK_ROWS`` rows is learned in one job by one task, in an order that its
values alone decide.  In a larger one each step is
one job: tasks sum the gradients of their rows, and the partial sums meet as
decimals in a partial and a final aggregate, so the result does not depend on
the order in which tasks end.  The driver holds one number per model column.

With ``file_epochs`` a micro-batch takes up many files and each stays an epoch of
its own: tasks read and order the rows of the files side by side, and one task
takes the steps of one file after the other, ``RUN_ROWS`` rows at most in a job, so
the fixed cost of a micro-batch is paid once for all its files and the weights are
those of one file a micro-batch.

The loss of a step's rows is taken before the step (progressive validation):
the version's ``loss`` is an honest estimate on rows not yet seen.
"""

from __future__ import annotations

import math
import os
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickpair.streaming.jobs import _stream_dir, _trigger, list_dir, stream_path

#: Fixed value of the reference's incremental model: L1 strength.
ALPHA = 0.01
RATE, STEPS, PASSES, KEEP = 0.5, 8, 2, 3
#: Rows of a batch that one task learns from.
TASK_ROWS = 50_000
#: Files of a micro-batch whose files are epochs, and rows of a job that learns some of them.
FILES, RUN_ROWS = 64, 400_000
VERSION = "name string, weight double, squares double, rows long, loss double, epochs long"
#: Digits after the point that gradient sums keep.
_EXACT = "decimal(38,14)"


@dataclass(frozen=True)
class LinearState:
    """Weights, the last of them the intercept, and their squared gradients."""

    names: tuple[str, ...]
    weights: np.ndarray
    squares: np.ndarray
    rows: int = 0
    loss: float | None = None
    epochs: int = 0
    epoch: int = field(default=-1, compare=False)            # of its version

    @classmethod
    def zero(cls, names) -> LinearState:
        return cls(tuple(names), np.zeros(len(names) + 1), np.zeros(len(names) + 1))


def feature_row(features, label: str) -> list[Column]:
    """``x`` (missing values 0) and ``y`` of a feature table."""
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features])
    return [F.transform(x, lambda v: F.when(F.isnan(v), 0.0).otherwise(v)).alias("x"),
            F.col(label).cast("double").alias("y")]


def gradient_sums(rows: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, float, int]:
    """(gradient sum, loss sum, rows) of the logistic loss over ``rows`` (x, y)."""
    d = len(weights) - 1

    def partial(batches):
        total, loss, n = np.zeros(d + 1), 0.0, 0
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            y = batch.column(1).to_numpy(zero_copy_only=False)
            z = x @ weights[:-1] + weights[-1]
            miss = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y
            total += np.append(miss @ x, miss.sum())
            loss += float(np.sum(np.logaddexp(0, z) - y * z))
            n += len(y)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(d + 3), pa.int32()), pa.array([*total, loss, float(n)], pa.float64())], ["j", "v"])

    sums = rows.select("x", "y").mapInArrow(partial, "j int, v double").groupBy("j").agg(
        F.sum(F.col("v").cast(_EXACT)).alias("v"))
    got = {r["j"]: float(r["v"]) for r in sums.collect()}            # one row per model column
    return np.array([got.get(j, 0.0) for j in range(d + 1)]), got.get(d + 1, 0.0), int(got.get(d + 2, 0))


def proximal_step(state: LinearState, gradient: np.ndarray, alpha: float, rate: float) -> LinearState:
    """One AdaGrad step; all weights but the intercept are soft-thresholded."""
    squares = state.squares + gradient ** 2
    step = rate / (np.sqrt(squares) + 1e-12)
    moved = state.weights - np.where(squares > 0, step * gradient, 0.0)
    shrunk = np.sign(moved) * np.maximum(np.abs(moved) - alpha * step * (squares > 0), 0)
    shrunk[-1] = moved[-1]
    return replace(state, weights=shrunk, squares=squares)


def _ordered(x, y, slot):
    """Rows in an order that their values alone decide, slot by slot."""
    order = np.lexsort((*x.T, y, slot))
    return x[order], y[order], slot[order]


def _epoch(state: LinearState, x, y, slot, alpha, rate, steps: int, passes: int) -> LinearState:
    """``state`` after an epoch on ordered rows."""
    if not len(y):
        return state
    ends = np.searchsorted(slot, np.arange(steps + 1))
    now, lost = state, 0.0
    for k in range(passes):
        for a, b in zip(ends, ends[1:]):
            if a == b:
                continue
            xs, ys = x[a:b], y[a:b]
            z = xs @ now.weights[:-1] + now.weights[-1]
            miss = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - ys
            now = proximal_step(now, np.append(miss @ xs, miss.sum()) / len(ys), alpha, rate)
            if k == 0:
                lost += float(np.sum(np.logaddexp(0, z) - ys * z))
    return replace(now, rows=state.rows + len(y), loss=lost / len(y))


_LEARNED = "weights array<double>, squares array<double>, rows long, loss double, epochs long"


def _learned(state: LinearState) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([v.tolist()], pa.list_(pa.float64())) for v in (state.weights, state.squares)]
        + [pa.array([state.rows], pa.int64()), pa.array([state.loss], pa.float64()), pa.array([state.epochs], pa.int64())],
        ["weights", "squares", "rows", "loss", "epochs"])


def _after(learned: DataFrame, state: LinearState) -> LinearState:
    """The state that a task returned as its only row."""
    for r in learned.collect():
        state = replace(state, weights=np.array(r["weights"]), squares=np.array(r["squares"]), rows=r["rows"], loss=r["loss"],
                        epochs=r["epochs"])
    return state


def _learn_in_task(dealt: DataFrame, state: LinearState, alpha, rate, steps: int, passes: int) -> LinearState:
    """``learn`` on the few rows (x, y, slot) of a small batch."""
    d = len(state.weights) - 1

    def work(batches):
        found = [(b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d), b.column(1).to_numpy(), b.column(2).to_numpy())
                 for b in batches if len(b)]
        if found:
            yield _learned(_epoch(state, *_ordered(*map(np.concatenate, zip(*found))), alpha, rate, steps, passes))

    return _after(dealt.select("x", "y", "slot").coalesce(1).mapInArrow(work, _LEARNED), state)


def _slots(steps: int) -> Column:
    return F.pmod(F.xxhash64("x", "y"), F.lit(steps)).alias("slot")


def _learn_run(rows: DataFrame, state: LinearState, alpha, rate, steps: int, passes: int) -> LinearState:
    """An epoch on each file of ``rows`` (at, file, x, y), in order of (at, file).
    The rows of a file are read and ordered by the tasks that hold them, and
    one task learns."""
    d, kinds = len(state.weights) - 1, (np.float64, np.float64, np.int64)

    def cut(batches):
        """The rows of each file, packed; rows without a label go."""
        last, held = None, []

        def packed():
            arrays = _ordered(*map(np.concatenate, zip(*held)))
            return pa.RecordBatch.from_arrays(
                [pa.array([v], pa.int64()) for v in last]
                + [pa.array([np.ascontiguousarray(v, k).tobytes()], pa.binary()) for v, k in zip(arrays, kinds)],
                ["at", "file", "x", "y", "slot"])

        for batch in batches:
            at, file = (batch.column(i).to_numpy() for i in (0, 1))
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            y, slot = batch.column(3).to_numpy(zero_copy_only=False), batch.column(4).to_numpy()
            known = batch.column(3).is_valid().to_numpy(zero_copy_only=False)
            starts = np.flatnonzero((np.diff(at, prepend=at[:1] - 1) != 0) | (np.diff(file, prepend=file[:1]) != 0))
            for a, b in zip(starts, [*starts[1:], len(at)]):
                if (at[a], file[a]) != last:
                    if held:
                        yield packed()
                    last, held = (at[a], file[a]), []
                held.append(tuple(v[a:b][known[a:b]] for v in (x, y, slot)))
        if held:
            yield packed()

    def work(batches):
        files = {}
        for batch in batches:
            for r in batch.to_pylist():
                x, y, slot = (np.frombuffer(r[c], k) for c, k in zip(("x", "y", "slot"), kinds))
                files.setdefault((r["at"], r["file"]), []).append((x.reshape(-1, d), y, slot))
        now = state
        for _, pieces in sorted(files.items()):
            arrays = pieces[0] if len(pieces) == 1 else _ordered(*map(np.concatenate, zip(*pieces)))
            now = _epoch(now, *arrays, alpha, rate, steps, passes)
            now = replace(now, epochs=now.epochs + 1)
        if files:
            yield _learned(now)

    pieces = rows.select("at", "file", "x", "y", _slots(steps)).mapInArrow(
        cut, "at long, file long, x binary, y binary, slot binary")
    return _after(pieces.repartition(1).mapInArrow(work, _LEARNED), state)


def learn_files(rows: DataFrame, state: LinearState, alpha: float = ALPHA, rate: float = RATE,
                steps: int = STEPS, passes: int = PASSES) -> LinearState:
    """An epoch on each file of ``rows`` (at: when it came, file: a number, x,
    y), oldest first.  Files of up to ``TASK_ROWS`` rows are learned in runs of
    up to ``RUN_ROWS``, larger ones by ``learn``."""
    sizes = sorted((r["at"], r["file"], r["count"]) for r in rows.groupBy("at", "file").count().collect())   # a row a file
    runs, held = [], 0
    for at, file, n in sizes:
        if not runs or max(n, runs[-1][0][2]) > TASK_ROWS or held + n > RUN_ROWS:
            runs.append([])
            held = 0
        runs[-1].append((at, file, n))
        held += n
    place = lambda at, file, n: F.struct(F.lit(at).cast("long").alias("at"), F.lit(file).cast("long").alias("file"))
    for run in runs:
        mine = rows if len(runs) == 1 else rows.where(F.struct("at", "file").between(place(*run[0]), place(*run[-1])))
        if run[0][2] > TASK_ROWS:
            state = learn(mine.select("x", "y"), state, alpha, rate, steps, passes)
            state = replace(state, epochs=state.epochs + 1)
        else:
            state = _learn_run(mine, state, alpha, rate, steps, passes)
    return state


def learn(rows: DataFrame, state: LinearState, alpha: float = ALPHA, rate: float = RATE,
          steps: int = STEPS, passes: int = PASSES) -> LinearState:
    """``passes`` over ``rows`` (x, y), each of ``steps`` mini-batches."""
    dealt = rows.where("y is not null").select("*", _slots(steps)).persist()
    try:
        if dealt.count() <= TASK_ROWS:
            return _learn_in_task(dealt, state, alpha, rate, steps, passes)
        seen, loss = 0, 0.0
        for k in range(passes):
            for m in range(steps):
                g, lost, n = gradient_sums(dealt.where(F.col("slot") == m), state.weights)
                if n:
                    state = proximal_step(state, g / n, alpha, rate)
                if k == 0:
                    seen, loss = seen + n, loss + lost
        return replace(state, rows=state.rows + seen, loss=loss / seen if seen else state.loss)
    finally:
        dealt.unpersist()


# -- The versioned table of weights ------------------------------------------------

def _version(base: str, epoch: int) -> str:
    return os.path.join(base, "weights", f"epoch={epoch:09d}")


def _versions(spark: SparkSession, base: str) -> list[int]:
    path = os.path.join(base, "weights")
    try:
        names = list_dir(spark, path)
    except Exception as e:                       # nothing written yet
        if "FileNotFound" in str(e) or "does not exist" in str(e):
            return []
        raise
    epochs = sorted(int(n.split("=")[1]) for n in names if n.startswith("epoch="))
    return [e for e in epochs if "_SUCCESS" in list_dir(spark, _version(base, e))]


def read_state(spark: SparkSession, base: str, names, below: int | None = None) -> LinearState:
    """The newest version (below an epoch); zeros if there is none."""
    found = [e for e in _versions(spark, base) if below is None or e < below]
    if not found:
        return LinearState.zero(names)
    rows = {r["name"]: r for r in spark.read.schema(VERSION).parquet(_version(base, found[-1])).collect()}
    at = [rows[n] for n in (*names, "(intercept)")]
    return LinearState(tuple(names), np.array([r["weight"] for r in at]), np.array([r["squares"] for r in at]),
                       at[0]["rows"], at[0]["loss"], at[0]["epochs"], found[-1])


def write_state(spark: SparkSession, base: str, state: LinearState, epoch: int, keep: int = KEEP) -> None:
    """Write version ``epoch`` and drop all but the newest ``keep``."""
    rows = [(n, float(w), float(s), state.rows, state.loss, state.epochs)
            for n, w, s in zip((*state.names, "(intercept)"), state.weights, state.squares)]
    spark.createDataFrame(rows, VERSION).coalesce(1).write.mode("overwrite").parquet(_version(base, epoch))
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for e in _versions(spark, base):
        if e <= epoch - keep:
            p = fs_path(_version(base, e))
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def learn_batch(batch: DataFrame, epoch: int, base: str, features, label: str = "label", **how) -> LinearState:
    """What one micro-batch does; calling it again for an epoch changes nothing.
    Rows that name their ``_file`` are learned file by file."""
    spark = batch.sparkSession
    state = read_state(spark, base, features, below=epoch)
    if "_file" in batch.columns:
        state = learn_files(batch.select(F.col("_file.at"), F.col("_file.file"), *feature_row(features, label)), state, **how)
    else:
        state = replace(learn(batch.select(*feature_row(features, label)), state, **how), epochs=state.epochs + 1)
    write_state(spark, base, state, epoch)
    return state


def online_lr_stream(spark: SparkSession, source: str, schema, features: list[str], label: str = "label",
                     files_per_batch: int = 1, available_now: bool = True, interval: str = "1 minute",
                     run: str | None = None, file_epochs: int | None = None, **how):
    """Train over the files that land in ``source``, ``files_per_batch`` a
    micro-batch, which is an epoch; with ``file_epochs``, up to so many files a
    micro-batch, each of them an epoch, oldest first.  Returns (query, base folder
    of the versions)."""
    base = _stream_dir(spark, "online_lr", run)
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", file_epochs or files_per_batch).parquet(stream_path(source))
    if file_epochs:
        src = src.select("*", F.struct(F.unix_micros("_metadata.file_modification_time").alias("at"),
                                       F.xxhash64("_metadata.file_path").alias("file")).alias("_file"))

    def step(batch: DataFrame, epoch: int) -> None:
        learn_batch(batch, epoch, base, features, label, **how)

    w = src.writeStream.foreachBatch(step).option("checkpointLocation", os.path.join(base, "checkpoint"))
    return _trigger(w, available_now, interval).start(), base


def scored(df: DataFrame, state: LinearState, out: str = "prediction") -> DataFrame:
    """Probability of label 1, as column arithmetic."""
    z = F.lit(float(state.weights[-1]))
    for name, w in zip(state.names, state.weights):
        if w:
            x = F.coalesce(F.col(name).cast("double"), F.lit(0.0))
            z = z + F.when(F.isnan(x), 0.0).otherwise(x) * float(w)
    return df.withColumn(out, 1 / (1 + F.exp(-z)))


def landed(df: DataFrame, spark: SparkSession, rows_per_file: int = 5000) -> tuple[str, int]:
    """Write ``df`` into a new folder in files of about ``rows_per_file`` rows,
    as a stream source.  Returns (folder, files)."""
    import uuid

    from clickpair.session import checkpoint_dir
    files = max(1, math.ceil(df.count() / rows_per_file))
    path = os.path.join(checkpoint_dir(spark), "landing", uuid.uuid4().hex)
    df.repartition(files).write.parquet(path)
    return path, files
