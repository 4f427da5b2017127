"""Explicit schemas of the tables the engine reads and writes."""

from pyspark.sql import types as T

SAMPLES = T.StructType([
    T.StructField("sample_id", T.LongType(), False),  # row position: unique, roughly dense
    T.StructField("split", T.StringType()),
    T.StructField("html_table", T.StringType()),
    T.StructField("image", T.BinaryType()),
])

PREDICTIONS = T.StructType([
    T.StructField("sample_id", T.LongType(), False),
    T.StructField("stage", T.StringType()),
    T.StructField("pred_html", T.StringType()),
    T.StructField("error", T.StringType()),
])

METRICS_LOG = T.StructType([
    T.StructField("run_id", T.LongType()),
    T.StructField("step", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("loss", T.DoubleType()),
])

IMAGES = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()),
    T.StructField("content", T.BinaryType()),
])

NODE = T.StructType([
    T.StructField("node_id", T.IntegerType()),
    T.StructField("parent", T.IntegerType()),
    T.StructField("depth", T.IntegerType()),
    T.StructField("tag", T.StringType()),
    T.StructField("colspan", T.IntegerType()),
    T.StructField("rowspan", T.IntegerType()),
    T.StructField("text", T.StringType()),
])

OCR_SUMMARY = T.StructType([
    T.StructField("row_index", T.IntegerType()),
    T.StructField("html_table_length", T.IntegerType()),
    T.StructField("status", T.StringType()),
    T.StructField("error_message", T.StringType()),
])
