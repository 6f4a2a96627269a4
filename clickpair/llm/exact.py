"""Exact dedup with two Bloom passes (operator 2), DataFrame functions only.

Pass 1 inserts the hash of every text into a blocked Bloom filter of 64-bit
words (three bits in one word) and keeps the bits that two or more rows have
set.  Pass 2 probes: a row all of whose bits are set twice is possibly
repeated.  Only those rows shuffle, as (id, digest); the rest pass straight
through.  Every text is read, normalised and digested once; both passes run
over the narrow table of digests.

The filter is broadcast while its size, which is measured, is at most
``filter_bytes``; beyond that the narrow rows meet it in an equi-join.  A
group of copies is reduced by partial aggregation, and its verdict returns by
``heavy_join``, so no group meets in one task.

Edge cases: null text is the empty text, and empty texts equal each other; a
null id never beats another id; of repeated rows (same id, same text) each
that carries the largest id has ``kept`` true; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickpair.llm.common import LOWER, UPPER, heavy_join, stored

WORD_BYTES = 64            # of a filter word in a broadcast hash table


def normalised(text):
    """Lower-cases A-Z and nothing else."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def _place(rows: DataFrame, blocks: int) -> DataFrame:
    """Adds the filter word (``block``) and the row's bits in it."""
    h = F.xxhash64("text_sha256")
    bit = lambda k: F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")
    return rows.withColumn("block", F.shiftrightunsigned(h, 18) % blocks).withColumn(
        "bits", F.array_distinct(F.array(bit(0), bit(1), bit(2))))


def repeated_filter(rows: DataFrame, blocks: int) -> DataFrame:
    """Pass 1: per filter word, the bits that at least two rows have set."""
    hits = _place(rows, blocks).select("block", F.explode("bits").alias("bit"))
    twice = hits.groupBy("block", "bit").count().where("count >= 2")
    return twice.groupBy("block").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("word"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                filter_bytes: int = 64 << 20) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    rows = stored(docs.select(F.col(id_col).alias("doc_id"),
                              F.sha2(normalised(F.col(text_col)), 256).alias("text_sha256")), "digests")
    blocks = max(1, rows.count() // 2)
    words = stored(repeated_filter(rows, blocks), "bloom")
    small = words.count() * WORD_BYTES <= filter_bytes
    probe = F.aggregate("bits", F.lit(True), lambda ok, b: ok & F.getbit("word", b).eqNullSafe(1))
    probed = _place(rows, blocks).join(F.broadcast(words) if small else words, "block", "left").select(
        "doc_id", "text_sha256", F.coalesce(probe, F.lit(False)).alias("maybe"))
    maybe = probed.where("maybe").drop("maybe")
    groups = stored(maybe.groupBy("text_sha256").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    repeated = heavy_join(maybe, groups, "text_sha256", "group_size")
    single = probed.where(~F.col("maybe")).select(
        "doc_id", "text_sha256", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    return repeated.unionByName(single).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256")


SQL = f"""
with t as (select doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) as text_sha256
           from documents),
g as (select text_sha256, max(doc_id) as keep_id, count(*) as group_size from t group by text_sha256)
select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id as kept, t.text_sha256
from t join g using (text_sha256)
"""
