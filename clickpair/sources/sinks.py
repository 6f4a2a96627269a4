"""Sinks: labelled text export, prediction CSV, feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickpair.schema import PREDICTIONS

# The labelled-text line format and the export's stop rule
# (the reference checks the count after writing, so 20,001 lines come out).
LABEL_LINE = "__label__%d %s %s"
EXPORT_ROWS = 20001


def labeled_lines(df: DataFrame, n: int | None = EXPORT_ROWS, order: str = "pair_id") -> DataFrame:
    """``__label__{label} {query} {title}`` per pair, first ``n`` in id order."""
    lines = df.select(order, F.format_string(LABEL_LINE, "label", "query", "title").alias("value"))
    if n is not None:
        lines = lines.orderBy(order).limit(n)
    return lines.select("value")


def export_labeled_text(df: DataFrame, path: str, n: int | None = EXPORT_ROWS) -> None:
    labeled_lines(df, n).write.mode("overwrite").text(path)


def prediction_frame(df: DataFrame, query_id: str = "query_id", pair_id: str = "pair_id",
                     prediction: str = "prediction") -> DataFrame:
    return df.select(F.col(query_id).cast("long").alias("query_id"),
                     F.col(pair_id).cast("long").alias("query_title_id"),
                     F.col(prediction).cast("double").alias("prediction"))


def sink_predictions(df: DataFrame, path: str) -> None:
    """Headerless CSV ``query_id, query_title_id, prediction``."""
    prediction_frame(df).write.mode("overwrite").option("header", "false").csv(path)


def read_predictions(spark, path: str) -> DataFrame:
    return spark.read.schema(PREDICTIONS).option("header", "false").csv(path)


def sink_features(df: DataFrame, path: str, fmt: str = "parquet", partition_by=("split",)) -> None:
    """Feature table: parquet (default, partitioned by split) or CSV with header."""
    w = df.write.mode("overwrite")
    parts = [p for p in partition_by if p in df.columns]
    if parts:
        w = w.partitionBy(*parts)
    if fmt == "csv":
        w.option("header", "true").option("escape", '"').csv(path)
    else:
        w.parquet(path)
