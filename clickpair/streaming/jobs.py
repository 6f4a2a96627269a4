"""Structured Streaming jobs: running key rates and stateless pair features.

Both read a parquet file source, so new files landing in the folder are
picked up incrementally; ``availableNow`` processes what is there and stops,
``processingTime`` keeps running.  Checkpoints live under the shared
checkpoint folder, so a restarted driver resumes from the last committed
micro-batch.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickpair.functions.text import clean_digits
from clickpair.functions.tokens import token_set_features
from clickpair.operators import rates
from clickpair.session import checkpoint_dir


def _stream_dir(spark: SparkSession, name: str, run: str | None = None) -> str:
    return os.path.join(checkpoint_dir(spark), "streams", name, run or uuid.uuid4().hex)


def stream_path(path: str) -> str:
    """File stream sources watch a folder or a glob.  A single file becomes a
    one-file glob (last character bracketed) so the same table can be replayed."""
    p = path.rstrip("/")
    if os.path.isfile(p) and not any(ch in p for ch in "*?[{"):
        return p[:-1] + "[" + p[-1] + "]"
    return p


def _trigger(w, available_now: bool, interval: str):
    return w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)


def key_stats_stream(spark: SparkSession, source: str, schema, keys, label: str = "label",
                     transform=None, out: str | None = None, available_now: bool = True,
                     interval: str = "1 minute", run: str | None = None, mode: str = "update"):
    """Running ``count`` and ``clicks`` per key over arriving rows.

    The aggregation state (one row per key) lives in the state store.  In
    ``update`` mode (default) each micro-batch emits only the keys it changed
    and appends them as partition ``epoch=<batch id>`` with dynamic partition
    overwrite, so a retried batch replaces its own partition and nothing else;
    ``current_key_stats`` reads the latest value per key.  ``complete`` mode
    rewrites the whole table every batch (simple, but proportional to the
    number of keys).  Returns (query, out path).
    """
    base = _stream_dir(spark, "key_rates", run)
    out = out or os.path.join(base, "table")
    src = spark.readStream.schema(schema).parquet(stream_path(source))
    if transform is not None:
        src = transform(src)
    ks = [keys] if isinstance(keys, str) else list(keys)
    p = rates.prefix(ks)
    agg = (src.where(rates._not_null(ks)).groupBy(*ks)
           .agg(F.count(F.lit(1)).alias(f"{p}_count"),
                F.sum(label).cast("long").alias(f"{p}_click_number")))

    if mode == "complete":
        def write(batch: DataFrame, _epoch: int) -> None:
            batch.write.mode("overwrite").parquet(out)
    elif mode == "update":
        def write(batch: DataFrame, epoch: int) -> None:
            (batch.withColumn("epoch", F.lit(epoch).cast("long"))
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("epoch").parquet(out))
    else:
        raise ValueError(mode)

    w = (agg.writeStream.outputMode(mode).foreachBatch(write)
         .option("checkpointLocation", os.path.join(base, "checkpoint")))
    return _trigger(w, available_now, interval).start(), out


def current_key_stats(spark: SparkSession, out: str, keys) -> DataFrame:
    """Latest (count, clicks) per key from a ``key_stats_stream`` table."""
    ks = [keys] if isinstance(keys, str) else list(keys)
    p = rates.prefix(ks)
    df = spark.read.parquet(out)
    if "epoch" not in df.columns:
        return df
    vals = F.struct(f"{p}_count", f"{p}_click_number")
    return (df.groupBy(*ks).agg(F.max_by(vals, "epoch").alias("_v"))
            .select(*ks, f"_v.{p}_count", f"_v.{p}_click_number"))


def rates_from_stats(stats: DataFrame, keys) -> DataFrame:
    """Smoothed rate table from streamed (count, clicks) per key."""
    ks = [keys] if isinstance(keys, str) else list(keys)
    p = rates.prefix(ks)
    st = stats.withColumn(f"{p}_rate", F.col(f"{p}_click_number") / F.col(f"{p}_count"))
    prior = rates.bayes_prior(st, f"{p}_rate")
    ab = prior.select(F.struct("alpha", "beta")).scalar()
    return st.select(*ks, f"{p}_count", f"{p}_click_number",
                     rates.smoothed_rate(F.col(f"{p}_click_number"), F.col(f"{p}_count"),
                                         ab["alpha"], ab["beta"]).alias(f"{p}_rate"))


def pair_features_stream(spark: SparkSession, source: str, schema, out: str | None = None,
                         available_now: bool = True, interval: str = "1 minute",
                         run: str | None = None, clean: bool = True):
    """Token-set features of arriving pairs, appended to a parquet folder."""
    base = _stream_dir(spark, "pair_features", run)
    out = out or os.path.join(base, "table")
    src = spark.readStream.schema(schema).parquet(stream_path(source))
    if clean:
        src = src.withColumn("query", clean_digits("query")).withColumn("title", clean_digits("title"))
    feats = token_set_features(src)
    w = (feats.writeStream.outputMode("append").format("parquet").option("path", out)
         .option("checkpointLocation", os.path.join(base, "checkpoint")))
    return _trigger(w, available_now, interval).start(), out


def list_dir(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any Hadoop file system (local, HDFS, S3, ...)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [st.getPath().getName() for st in fs.listStatus(p)]
