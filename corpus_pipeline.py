"""Corpus pipeline: documents to packed training sequences.

Every stage works on all that its predecessor kept.  All but the last return
the columns of ``documents``; where a text changes, ``n_chars`` follows it.

1. quality classifier: documents scored below the cut go;
2. line dedup: aligned common blocks go, and documents of which nothing is left;
3. n-gram Jaccard join: of each component the smallest id stays;
4. suffix-array dedup: later copies of 200-byte strings go, and documents of
   which nothing is left;
5. packing: pieces of 2048-token sequences.

Rows without an id are scored and packed like others; dedup leaves them alone.
An empty table passes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickpair.llm import jaccard, lines, packing, quality_mil, suffixes
from clickpair.llm.common import bound_batches, documents, labels, sized, stored
from clickpair.session import ship_package


def _ready(spark: SparkSession) -> None:
    ship_package(spark)
    bound_batches(spark)


def _columns(changed: DataFrame, like: DataFrame) -> DataFrame:
    """``changed`` (text, rest) with the columns of ``like``."""
    kinds = dict(like.dtypes)
    new = {"text": F.col("text")}
    if "n_chars" in kinds:
        new["n_chars"] = F.length("text").cast(kinds["n_chars"])
    return changed.select(*[new.get(c, F.col(f"rest.`{c}`")).alias(c) for c in like.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    model = quality_mil.fit(docs, labels(spark, sf_dir))
    name = next(n for n in ("score", "quality_score", "quality_score_") if n not in docs.columns)
    return quality_mil.with_scores(docs, model, name=name).where(F.col(name) >= quality_mil.CUT).drop(name)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    cut = lines.line_dedup(docs, carry=True)
    return _columns(cut.where((F.col("n_deleted") == 0) | (F.col("n_deleted") < F.col("n_lines"))), docs)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    found = jaccard.jaccard_components(docs)
    gone = stored(found.where("doc_id is not null and doc_id <> component_id").select("doc_id").distinct(), "near")
    return docs.join(sized(gone), "doc_id", "left_anti").select(*docs.columns)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    cut = suffixes.suffix_dedup(docs, keep="first", carry=True)
    return _columns(cut.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_bytes"))), docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return packing.pack(docs)


STAGES = [("quality", quality_stage), ("lines", line_stage), ("jaccard", jaccard_stage),
          ("suffixes", suffix_stage), ("packing", packing_stage)]

#: The trained classifier and the packing plan are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
