"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Defaults that every job in the package assumes.  They are only applied
# when the caller builds the session through ``get_spark``; a session handed
# in from outside keeps its own settings.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# Applied on a cluster (non-local master) when the setting is absent: start
# with many shuffle partitions and let AQE coalesce them to ~256 MiB, read
# 256 MiB file splits, and split skewed join partitions above 5x the median.
CLUSTER_DEFAULTS = {
    "spark.sql.shuffle.partitions": "8000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
}


def get_spark(app: str = "clickpair", master: str | None = None,
              shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in _DEFAULTS.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    if not (spark.sparkContext.master or "").startswith("local"):
        explicit = spark.sparkContext.getConf()          # only keys someone set
        for k, v in CLUSTER_DEFAULTS.items():
            if not explicit.contains(k) and not (k == "spark.sql.shuffle.partitions"
                                                 and shuffle_partitions):
                spark.conf.set(k, v)
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder and register it with the context.

    On a cluster the folder must come from ``spark.checkpoint.dir`` (a shared
    file system every executor sees).  Only a local-mode session without that
    setting gets a private temporary folder, which is what tests use.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master or ""
        if not master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; point it at a shared folder "
                "(HDFS/S3/ABFS) before running lineage-cutting jobs")
        d = tempfile.mkdtemp(prefix="clickpair-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def cut_lineage(df):
    """Reliable checkpoint into the shared folder (never a local checkpoint)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``clickpair`` importable in Python workers: zip the package once
    per SparkContext and register it with ``addPyFile``.  The zip is a code
    artifact on the driver; Spark's file server hands it to every executor,
    as it does for ``--py-files``.  Pandas UDFs unpickle their functions by
    module name, so executors need the package whatever their working
    directory."""
    import os
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="clickpair-pyfiles-"), "clickpair.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _dirs, files in os.walk(pkg):
            if "__pycache__" in d:
                continue
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(key)


def written(df, name: str, partition_by=()):
    """``df`` written to the shared folder and read back: lineage ends there,
    and a lost executor rereads files."""
    import os
    import uuid

    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), "tables", f"{name}-{uuid.uuid4().hex}")
    w = df.write
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def drop_written(*frames) -> None:
    """Delete the files of tables from ``written`` that nothing will read again."""
    for df in frames:
        if getattr(df, "_written", None):
            sc = df.sparkSession.sparkContext
            path = sc._jvm.org.apache.hadoop.fs.Path(df._written)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
