"""Helpers shared by the training-data operators: tables, shared storage,
skew-safe joins and Arrow text batches."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickpair.session import checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Text bytes that one numpy step works on; a longer document is one step.
CHUNK_BYTES = 2 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder of ``spark.checkpoint.dir`` and read
    it back: lineage ends there, and a lost executor rereads files."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete a table that ``stored`` wrote, once nothing reads it any more:
    what was made from it must be stored itself."""
    files = table.inputFiles()
    if files:
        spark = table.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def heavy_join(rows: DataFrame, table: DataFrame, key: str, weight: str,
               how: str = "inner", share: int = 1000) -> DataFrame:
    """Join ``rows`` with ``table`` (one row per ``key``) where some keys may
    hold a large part of ``rows``.

    ``weight`` is a column of ``table`` with the number of rows of its key.
    Keys with at least 1/``share`` of all rows are at most ``share`` keys, so
    that part of ``table`` is broadcast with a proven bound; the others meet
    in a plain equi-join, where no key is large.  Keys must not be null.
    """
    total = table.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("t"))
    cut = table.where(F.col(weight) * share >= total.scalar())
    payload = [c for c in table.columns if c != key]
    hot = F.broadcast(cut.select(key, F.struct(*payload).alias("_hot")))
    split = rows.join(hot, key, "left")
    warm = split.where(F.col("_hot").isNotNull()).select(
        *rows.columns, *[F.col(f"_hot.{c}").alias(c) for c in payload])
    cold_rows = split.where(F.col("_hot").isNull()).drop("_hot")
    cold_table = table.where(F.col(weight) * share < total.scalar())
    cold = cold_rows.join(cold_table, key, how).select(*rows.columns, *payload)
    return warm.unionByName(cold)


def let(value, body):
    """``body`` over ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


# -- Arrow text batches -------------------------------------------------------

#: Bytes of a batch on its way to Python; a longer row is a batch.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Batches to Python hold about ``BATCH_BYTES`` at most, where the session sets
    no bound of its own: 10,000 long texts would stand in the JVM's buffers and in the
    worker at once."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.sparkContext.getConf().contains(name):
        spark.conf.set(name, str(BATCH_BYTES))


def hand_back() -> None:
    """Hand freed memory back to the system: Python workers are reused, and
    what one stage held would count against the next.  Arrow's own pools keep
    freed pages, so a worker's Arrow memory comes from the system's."""
    pa.set_memory_pool(pa.system_memory_pool())
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)         # glibc only
    if trim is not None:
        trim(0)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all rows, row offsets of length n + 1); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def row_chunks(off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes each, at least one row."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def ragged_index(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of every (start, len) run, one after another."""
    total = int(lens.sum())
    shift = starts - (np.cumsum(lens) - lens)
    return np.repeat(shift, lens) + np.arange(total)


# -- Hashes of byte spans -----------------------------------------------------

_RNG = np.random.default_rng(20240917)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 2**64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n + 1:
        for k, base in enumerate((_BASE, _INV)):
            p = np.full(n + 1, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p, dtype=np.uint64)
    return _POWERS


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


#: Field of the span hashes, and two bases drawn from it.
_PRIME = np.uint64(2**31 - 1)
_FIELD_BASES = tuple(int(b) for b in _RNG.integers(2**20, 2**31 - 2, 2))
_FIELD_BYTE = _RNG.integers(1, 2**31 - 1, 256, dtype=np.uint64)
_FIELD_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def _reduced(x: np.ndarray) -> np.ndarray:
    """``x`` modulo 2^31 - 1, for values below 2^62."""
    x = (x & _PRIME) + (x >> np.uint64(31))
    x = (x & _PRIME) + (x >> np.uint64(31))
    return np.where(x == _PRIME, np.uint64(0), x)


def _field_powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per base, its powers 0 .. n and those of its inverse (or longer)."""
    if not _FIELD_POWERS or len(_FIELD_POWERS[0][0]) < n + 1:
        made = []
        for base in _FIELD_BASES:
            rows = []
            for factor in (base, pow(base, -1, int(_PRIME))):
                p = np.ones(1, np.uint64)
                while len(p) < n + 1:
                    p = np.concatenate((p, _reduced(p * np.uint64(pow(factor, len(p), int(_PRIME))))))
                rows.append(p)
            made.append(tuple(rows))
        _FIELD_POWERS[:] = made
    return _FIELD_POWERS


def hash_prefix(buf: np.ndarray) -> np.ndarray:
    """Prefix sums, one row per base, from which any span's hash follows in
    constant time.  The terms lie in the field, so their plain sums fit 64 bits."""
    out = np.zeros((len(_FIELD_BASES), len(buf) + 1), np.uint64)
    byte = _FIELD_BYTE[buf]
    for k, (power, _) in enumerate(_field_powers(len(buf))):
        np.cumsum(_reduced(byte * power[:len(buf)]), out=out[k, 1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes [start, end): equal bytes have equal hashes
    wherever they stand.  Two polynomials over a prime field: unlike modulo
    2^64, no text has a twin that collides under every base (such as the
    Thue-Morse words and their complements)."""
    low, high = (_reduced(_reduced(prefix[k, end] - prefix[k, start]) * inverse[start])
                 for k, (_, inverse) in enumerate(_field_powers(prefix.shape[1] - 1)))
    return mix64((high << np.uint64(31)) | low)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of consecutive texts: start, end, and the
    index of each text's first word (n + 1 entries)."""
    solid = ~_SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True                               # texts touch without a gap
    before = np.concatenate(([False], solid[:-1])) if len(buf) else solid
    start = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.concatenate((solid[1:], [False])) if len(buf) else solid
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, off)


# -- Checked broadcasts, places and components ----------------------------------------

BROADCAST_BYTES = 32 << 20


def sized(table: DataFrame, row_bytes: int = 48) -> DataFrame:
    """``table`` (stored) with a broadcast hint if its measured size is within
    ``BROADCAST_BYTES``; beyond that it meets its rows in an equi-join."""
    return F.broadcast(table) if table.count() * row_bytes <= BROADCAST_BYTES else table


#: Rows that one range of ``placed`` sorts, about.
TASK_ROWS = 100_000


def placed(rows: DataFrame, order: list[str], task_rows: int = TASK_ROWS) -> DataFrame:
    """Adds ``place``, 0, 1, ... within ``g``, and ``total``, the rows of ``g``.
    ``order`` must tell all rows apart.  Ranges of the order are sorted apart,
    and the counts of a range, one row per range and ``g``, are its offsets; so
    no task holds a whole ``g``."""
    parts = max(1, rows.count() // task_rows)
    by = [F.asc_nulls_first(c) for c in order]
    ranged = stored(rows.repartitionByRange(parts, "g", *by).sortWithinPartitions("g", *by).withColumn(
        "part", F.spark_partition_id()).withColumn(
        "at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ranges")
    counts = ranged.groupBy("g", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("lo"))
    offsets = stored(counts.selectExpr(
        "g", "part", "lo", "coalesce(sum(n) over (partition by g order by part rows between unbounded preceding "
        "and 1 preceding), 0) as before", "sum(n) over (partition by g) as total"), "offsets")
    return ranged.join(sized(offsets, 128), ["g", "part"]).withColumn(
        "place", F.col("before") + F.col("at") - F.col("lo")).drop("part", "at", "lo", "before")


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of every id in ``edges`` (a, b): label is the smallest id
    that is reachable.  Each round hooks every id to its smallest neighbour,
    follows the hooks, and contracts the edges, so paths shrink fast; every
    round is stored.  Hubs are reduced by partial aggregation."""
    e = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where(
        "a < b").distinct(), "edges")
    hooks = []
    while e.head(1):
        near = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(
            F.min("b").alias("b"))
        hook = stored(near.select("a", F.least("a", "b").alias("p")), "hooks")
        small = sized(hook)
        for _ in range(2):
            onward = small.select(F.col("a").alias("p"), F.col("p").alias("q"))
            hook = hook.join(onward, "p").select("a", F.col("q").alias("p"))
        hook = stored(hook, "hooks")
        hooks.append(hook)
        small = sized(hook)
        e = stored(e.join(small, "a").select(F.col("p").alias("x"), "b").join(
            small.withColumnRenamed("a", "b"), "b").select(
            F.least("x", "p").alias("a"), F.greatest("x", "p").alias("b")).where("a < b").distinct(), "edges")
    if not hooks:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("label")).limit(0)
    out = hooks[0].select(F.col("a").alias("id"), F.col("p").alias("label"))
    for hook in hooks[1:]:
        step = sized(hook).select(F.col("a").alias("label"), F.col("p").alias("next"))
        out = out.join(step, "label", "left").select("id", F.coalesce("next", "label").alias("label"))
    return stored(out, "components")
