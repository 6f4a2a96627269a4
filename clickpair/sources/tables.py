"""Readers for the driver's parquet tables and for headerless pair CSVs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clickpair.schema import PAIR, UNLABELLED_PAIR

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise KeyError(name)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scan_pairs(spark: SparkSession, path: str, labelled: bool = True,
               fmt: str = "csv", sep: str = ",") -> DataFrame:
    """Read a pair table with the fixed schema.

    CSV is headerless and positional on disk; the schema names it.  Parquet
    input is read by name and projected onto the same schema.
    """
    schema = PAIR if labelled else UNLABELLED_PAIR
    if fmt == "csv":
        return (spark.read.schema(schema)
                .option("header", "false").option("sep", sep)
                .option("escape", '"')            # a doubled quote is a quote
                .option("mode", "PERMISSIVE").csv(path))
    df = spark.read.parquet(path)
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])
