"""Fixed, named schemas.  Positional column access is not supported."""

from pyspark.sql import types as T

PAIR = T.StructType([
    T.StructField("query_id", T.LongType()),
    T.StructField("query", T.StringType()),
    T.StructField("title_id", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("label", T.IntegerType()),
])

UNLABELLED_PAIR = T.StructType(PAIR.fields[:4])

GROUPED_TITLES = T.StructType([
    T.StructField("query_id", T.LongType()),
    T.StructField("query", T.StringType()),
    T.StructField("title_concat", T.StringType()),
    T.StructField("label", T.IntegerType()),
])

PREDICTIONS = T.StructType([
    T.StructField("query_id", T.LongType()),
    T.StructField("query_title_id", T.LongType()),
    T.StructField("prediction", T.DoubleType()),
])

WORD_VECTORS = T.StructType([
    T.StructField("word", T.StringType()),
    T.StructField("vector", T.ArrayType(T.DoubleType())),
])
