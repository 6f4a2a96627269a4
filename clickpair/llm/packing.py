"""Packing by cutting-stock column generation (operator 9).

Documents become token ids plus an end id and are cut at every ``width``
tokens; what is left of each is one shorter piece.  Spark counts the pieces
per length class (``width / unit`` classes, whatever the input's size), and
that histogram alone reaches the driver.  There the linear program of the
cutting-stock problem is solved by column generation: the simplex method over
patterns, each new pattern priced by the knapsack recurrence over the
capacity.  Whole multiples of the patterns are taken, and what rounding leaves
is packed best-fit decreasing, class by class.  Pieces are ranked within
their class, and a rank decides pattern, sequence and place.

Edge cases: null text is the empty text (one piece with the end id alone);
repeated rows are packed as often as they stand there; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickpair.llm.bpe import broadcast_vocabulary, encoded_batches, encoder_of
from clickpair.llm.common import stored

WIDTH, UNIT, END_ID = 2048, 8, 1
#: Pieces that one window task ranks, about.
RANK_ROWS = 50_000


def cut_pieces(docs: DataFrame, width: int, end_id: int, path: str | None, id_col: str,
               text_col: str, with_ids: bool = False) -> DataFrame:
    shared = broadcast_vocabulary(docs.sparkSession, path)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
              + (", ids array<int>" if with_ids else ""))

    def run(batches):
        for key, ids, at in encoded_batches(batches, encoder_of(shared)):
            n = np.diff(at) + 1
            full = np.empty(int(n.sum()), "<u4")
            ends = np.cumsum(n)
            full[ends - 1] = end_id
            mask = np.ones(len(full), bool)
            mask[ends - 1] = False
            full[mask] = ids
            per = -(-n // width)
            doc = np.repeat(np.arange(len(n)), per)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)) * width
            length = np.minimum(width, n[doc] - start)
            first = (ends - n)[doc] + start
            raw = memoryview(full).cast("B")
            crc = [zlib.crc32(raw[4 * a:4 * (a + k)]) for a, k in zip(first.tolist(), length.tolist())]
            cols = [key.take(pa.array(doc)), pa.array(start), pa.array(length),
                    pa.array(crc, pa.int64()), pa.array(n[doc])]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                cols.append(pa.ListArray.from_arrays(pa.array(np.append(first, len(full)), pa.int32()),
                                                     pa.array(full.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    return rows.mapInArrow(run, schema)


def best_pattern(value: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: counts per size with the largest total value."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    worth = np.flatnonzero(value > 1e-12)                # sizes are ascending
    value, size = value[worth], sizes[worth]
    fits = np.searchsorted(size, np.arange(capacity + 1), "right")
    for room in range(1, capacity + 1):
        best[room], k = best[room - 1], fits[room]
        if k:
            got = best[room - size[:k]] + value[:k]
            i = got.argmax()
            if got[i] > best[room] + 1e-12:
                best[room], choice[room] = got[i], worth[i]
    counts, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            counts[choice[room]] += 1
            room -= sizes[choice[room]]
    return float(best[capacity]), counts


def fractional_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int,
                        gap: float = 1e-3) -> list[tuple[float, np.ndarray]]:
    """(amount, counts per size) of an optimal basis of the cutting-stock
    linear program, within ``gap`` of its bound."""
    m = len(sizes)
    columns = np.diag((capacity // sizes).astype(float))
    cost, inverse = np.ones(m), np.diag(1.0 / np.diag(columns))
    amount = inverse @ demand
    for _ in range(50 * m + 100):
        dual = cost @ inverse
        worst = int(np.argmin(dual))
        if dual[worst] < -1e-9:                      # oversupply of a size is free
            column, price = np.zeros(m), 0.0
            column[worst] = -1.0
        else:
            top, column = best_pattern(np.maximum(dual, 0), sizes, capacity)
            price = 1.0
            if top <= 1 + 1e-9 or cost @ amount * (1 - 1 / top) <= gap * (cost @ amount):
                break
        step = inverse @ column
        able = step > 1e-9
        if not able.any():
            break
        ratio = np.where(able, amount / np.where(able, step, 1), np.inf)
        out = int(np.argmin(ratio))
        amount = np.maximum(amount - ratio[out] * step, 0)
        amount[out] = ratio[out]
        columns[:, out], cost[out] = column, price
        pivot = inverse[out] / step[out]
        inverse -= np.outer(step, pivot)
        inverse[out] = pivot
    return [(amount[j], columns[:, j]) for j in range(m) if cost[j] > 0]


def packing_plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(class, first rank, end rank, pieces per sequence, first sequence id)
    rows: every piece of a class has a rank and so exactly one row."""
    left = {c: n for c, n in histogram.items() if n > 0}
    rows, taken, sequence = [], dict.fromkeys(left, 0), 0

    def use(pattern: dict[int, int], times: int) -> None:
        nonlocal sequence
        for c, per in pattern.items():
            rows.append((c, taken[c], taken[c] + per * times, per, sequence))
            taken[c] += per * times
            left[c] -= per * times
        sequence += times

    if left.get(capacity):
        use({capacity: 1}, left[capacity])
    sizes = np.array(sorted(c for c in left if left[c] > 0), np.int64)
    if len(sizes):
        demand = np.array([left[c] for c in sizes.tolist()], float)
        for amount, counts in fractional_patterns(sizes, demand, capacity):
            pattern = {c: int(k) for c, k in zip(sizes.tolist(), counts) if k > 0}
            times = min([int(amount + 1e-6), *(left[c] // k for c, k in pattern.items())])
            if times > 0:
                use(pattern, times)
    while any(left.values()):
        room, pattern = capacity, {}
        for c in sorted((c for c in left if left[c] > 0), reverse=True):
            k = min(room // c, left[c])
            if k:
                pattern[c] = k
                room -= k * c
        use(pattern, min(left[c] // k for c, k in pattern.items()))
    return rows


def ranked(pieces: DataFrame, total: int, rows_per_task: int = RANK_ROWS) -> DataFrame:
    """Adds ``rank``: 0, 1, ... within ``class``, longer pieces first within a
    bucket.  Buckets bound what one window task sorts; their counts, one row
    per class and bucket, give each bucket's first rank."""
    buckets = max(1, -(-total // rows_per_task))
    rows = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
    before = Window.partitionBy("class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = rows.groupBy("class", "bucket").count().select(
        "class", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    place = Window.partitionBy("class", "bucket").orderBy(F.desc("length"), "doc_id", "start")
    return rows.withColumn("within", F.row_number().over(place) - 1).join(
        firsts, ["class", "bucket"]).withColumn("rank", F.col("first") + F.col("within")).drop(
        "bucket", "first", "within")


def pack(docs: DataFrame, width: int = WIDTH, unit: int = UNIT, end_id: int = END_ID,
         path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
         with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset`` (and ``ids`` on request)."""
    spark = docs.sparkSession
    pieces = stored(cut_pieces(docs, width, end_id, path, id_col, text_col, with_ids), "pieces").withColumn(
        "class", F.ceil(F.col("length") / unit).cast("int"))
    histogram = {r["class"]: r["count"] for r in pieces.groupBy("class").count().collect()}
    plan = packing_plan(histogram, width // unit)
    table = spark.createDataFrame(plan, "p_class int, lo long, hi long, per long, first long")
    spread = ranked(pieces, sum(histogram.values())).join(
        F.broadcast(table), (F.col("class") == F.col("p_class")) & (F.col("rank") >= F.col("lo"))
        & (F.col("rank") < F.col("hi")))
    placed = spread.withColumn("sequence_id", F.col("first") + F.expr("(rank - lo) div per"))
    run = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start").rowsBetween(
        Window.unboundedPreceding, -1)
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(run), F.lit(0)).cast("long")).select(
        *out, *(["ids"] if with_ids else []))
