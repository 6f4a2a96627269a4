"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickpair.llm import (bpe, chat, exact, jaccard, lines, merkle, mixing, packing, phrases, quality_mil,
                           quality_rules, suffixes, toxicity)
from clickpair.llm.common import documents, labels
from clickpair.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def add(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)          # workers import the package
            return fn(spark, sf_dir)
        QUERIES[key] = run
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return add


@query("op1_bpe")
def op1(spark, sf_dir):
    return bpe.bpe_roundtrip(documents(spark, sf_dir))


@query("op2_exact_dedup", exact.SQL)
def op2(spark, sf_dir):
    return exact.exact_dedup(documents(spark, sf_dir))


@query("op3_line_dedup")
def op3(spark, sf_dir):
    return lines.line_dedup(documents(spark, sf_dir)).withColumn("kept_sha256", F.sha2("text", 256)).drop("text")


@query("op4_jaccard")
def op4(spark, sf_dir):
    return jaccard.jaccard_components(documents(spark, sf_dir))


@query("op5_quality_rules", quality_rules.SQL)
def op5(spark, sf_dir):
    return quality_rules.quality_rules(documents(spark, sf_dir))


@query("op6_suffix_dedup")
def op6(spark, sf_dir):
    return suffixes.suffix_dedup(documents(spark, sf_dir), keep="none", with_text=False)


@query("op7_toxicity")
def op7(spark, sf_dir):
    return toxicity.toxicity(documents(spark, sf_dir), labels(spark, sf_dir))


@query("op8_chat")
def op8(spark, sf_dir):
    return chat.format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


@query("op9_packing")
def op9(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir))


@query("op10_quality_mil")
def op10(spark, sf_dir):
    return quality_mil.quality(documents(spark, sf_dir), labels(spark, sf_dir))


@query("op11_mixing", mixing.SQL)
def op11(spark, sf_dir):
    return mixing.mix(documents(spark, sf_dir))


@query("op12_merkle", merkle.SQL)
def op12(spark, sf_dir):
    return merkle.manifest(documents(spark, sf_dir), changed=merkle.every_third())


@query("op13_phrases", phrases.SQL)
def op13(spark, sf_dir):
    return phrases.phrases(documents(spark, sf_dir))
