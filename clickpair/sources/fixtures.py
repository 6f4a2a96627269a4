"""Pair tables derived from the driver's tables (see FIXTURES.md).

F1 ``basket_pairs``   numeric-token pairs: consecutive orders of a customer
F2 ``dialogue_pairs`` prose pairs: user turn -> next assistant turn (whole texts)
F3 ``labelled_docs``  documents with a quality label
F4 ``clicks``         events as (key1, key2, label)
F5 ``vector_pairs``   consecutive embeddings

Every fixture is a lazy plan over the parquet scans, so its size grows with
the tables it reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clickpair.operators.sequence import next_in_group
from clickpair.sources.tables import table


def order_tokens(lineitem: DataFrame) -> DataFrame:
    """One token string per order: ``l_suppkey % 10`` in line order.

    Orders are small groups (a handful of lines), so the per-key array is
    bounded; the sort key makes the string deterministic because
    ``l_linenumber`` alone is not unique inside an order.  Lines are dealt by
    order before they are collected: a map-side pass would shorten nothing.
    """
    li = lineitem.select(
        "l_orderkey",
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
                 "l_quantity", (F.col("l_suppkey") % 10).cast("string").alias("tok")).alias("s"))
    return (li.repartition("l_orderkey").groupBy("l_orderkey")
            .agg(F.sort_array(F.collect_list("s")).alias("ss"))
            .select("l_orderkey",
                    F.array_join(F.transform("ss", lambda s: s["tok"]), " ").alias("toks")))


def basket_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(order, next order of the same customer) as a (query, title) pair."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    toks = order_tokens(table(spark, sf_dir, "lineitem"))
    o = orders.join(toks, orders.o_orderkey == toks.l_orderkey).drop("l_orderkey")
    nxt = next_in_group(o, "o_custkey", "o_orderkey", {"o_orderkey": "nk", "toks": "nxt"}, sizes=orders)
    return (nxt.where(F.col("nxt").isNotNull())
            .select(F.col("o_orderkey").alias("pair_id"),
                    F.col("o_custkey").alias("query_id"),
                    F.col("toks").alias("query"),
                    F.col("nk").alias("title_id"),
                    F.col("nxt").alias("title"),
                    (F.col("o_orderstatus") == "F").cast("int").alias("label")))


def dialogue_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user turn and the following assistant turn, whole texts."""
    c = table(spark, sf_dir, "conversations")
    u = c.where(F.col("role") == "user").select(
        F.col("conv_id").alias("u_conv"), F.col("turn").alias("u_turn"), F.col("text").alias("u_text"))
    a = c.where(F.col("role") == "assistant").select(
        F.col("conv_id").alias("a_conv"), F.col("turn").alias("a_turn"), F.col("text").alias("a_text"))
    j = u.join(a, (a.a_conv == u.u_conv) & (a.a_turn == u.u_turn + 1))
    return j.select((F.col("a_conv") * 1000 + F.col("a_turn")).alias("pair_id"),
                    F.col("u_conv").alias("query_id"),
                    F.col("u_text").alias("query"),
                    F.col("a_turn").alias("title_id"),
                    F.col("a_text").alias("title"),
                    (F.length("a_text") > 1000).cast("int").alias("label"))


def labelled_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with their quality label; ``source``/``lang`` are rate keys."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return (d.join(lab, "doc_id")
            .select(F.col("doc_id").alias("pair_id"), "source", "lang", "text",
                    F.col("quality").alias("label")))


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one row per event, keys (user, hour), label = click."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("pair_id"),
                    F.col("user_id").alias("key1"),
                    F.hour("ts").alias("key2"),
                    (F.col("event_type") == "click").cast("int").alias("label"))


def vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embedding and its successor by id."""
    e = table(spark, sf_dir, "embeddings")
    a = e.select(F.col("vec_id").alias("pair_id"), F.col("embedding").alias("x_raw"),
                 F.col("label").alias("la"))
    b = e.select(F.col("vec_id").alias("vb"), F.col("embedding").alias("y_raw"),
                 F.col("label").alias("lb"))
    return (a.join(b, b.vb == a.pair_id + 1)
            .select("pair_id", "x_raw", "y_raw", (F.col("la") == F.col("lb")).cast("int").alias("label")))


FIXTURES = {
    "basket_pairs": basket_pairs,
    "dialogue_pairs": dialogue_pairs,
    "labelled_docs": labelled_docs,
    "clicks": clicks,
    "vector_pairs": vector_pairs,
}

__all__ = list(FIXTURES) + ["order_tokens", "Window"]
