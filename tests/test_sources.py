"""Readers and sinks round trip."""

import os
import tempfile

from clickpair.sources import sinks
from clickpair.sources.tables import scan_pairs


def test_scan_pairs_csv(spark):
    d = tempfile.mkdtemp(prefix="clickpair-test-")
    p = os.path.join(d, "pairs.csv")
    with open(p, "w") as f:
        f.write("1,1 2 3,10,4 5,1\n2,7,11,7 7\t,0\n")
    df = scan_pairs(spark, p)
    assert df.columns == ["query_id", "query", "title_id", "title", "label"]
    rows = df.orderBy("query_id").collect()
    assert rows[1]["title"] == "7 7\t" and rows[0]["label"] == 1


def test_labeled_lines_limit(spark):
    df = spark.range(30).selectExpr("id as pair_id", "cast(id % 2 as int) label",
                                    "cast(id as string) query", "'t' title")
    lines = [r[0] for r in sinks.labeled_lines(df, 5).collect()]
    assert lines[0] == "__label__0 0 t" and len(lines) == 5


def test_predictions_round_trip(spark):
    d = tempfile.mkdtemp(prefix="clickpair-test-")
    df = spark.createDataFrame([(1, 10, 0.25), (2, 20, 0.125)], "query_id long, pair_id long, prediction double")
    sinks.sink_predictions(df, d + "/p")
    back = sorted(tuple(r) for r in sinks.read_predictions(spark, d + "/p").collect())
    assert back == [(1, 10, 0.25), (2, 20, 0.125)]


def test_stream_update_mode_two_batches(spark):
    """Two files arrive in two micro-batches; the latest value per key wins."""
    import os
    from pyspark.sql import functions as F
    from clickpair.streaming import jobs
    d = tempfile.mkdtemp(prefix="clickpair-stream-")
    src = os.path.join(d, "in")
    a = spark.createDataFrame([(1, "x", 1), (2, "x", 0), (3, "y", 1)], "pair_id long, k string, label int")
    a.write.parquet(os.path.join(src, "part1"))
    schema = a.schema
    import uuid
    run = uuid.uuid4().hex          # fresh state and checkpoint per test run
    q, out = jobs.key_stats_stream(spark, os.path.join(src, "*"), schema, "k", run=run)
    q.awaitTermination()
    b = spark.createDataFrame([(4, "x", 1)], "pair_id long, k string, label int")
    b.write.parquet(os.path.join(src, "part2"))
    q, out2 = jobs.key_stats_stream(spark, os.path.join(src, "*"), schema, "k", run=run)
    q.awaitTermination()
    assert out == out2
    got = {r["k"]: (r["k_count"], r["k_click_number"])
           for r in jobs.current_key_stats(spark, out, "k").collect()}
    assert got == {"x": (3, 2), "y": (1, 1)}
    assert spark.read.parquet(out).select("epoch").distinct().count() == 2
