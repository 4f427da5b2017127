"""Pairing of truth, predictions and files."""

from pyspark.sql import Column, DataFrame, functions as F

from gridmill.functions import html as H
from gridmill.operators.skew import HOT_ROWS, hot_keys, salted_join


def pair_predictions(truth: DataFrame, preds: DataFrame, min_hot: int = HOT_ROWS, tasks: int | None = None) -> DataFrame:
    """Every truth row with its predictions; a missing prediction leaves nulls."""
    return salted_join(truth, preds, "sample_id", hot_keys(preds, "sample_id", min_hot), how="left", tasks=tasks)


def compare_stages(preds: DataFrame, before: str, after: str, value: str = "pred_html") -> DataFrame:
    """One row per sample with the value at either stage; combined map-side, so no key is hot."""
    at = lambda stage: F.max(F.when(F.col("stage") == stage, F.col(value)))
    return preds.groupBy("sample_id").agg(at(before).alias(f"{value}_{before}"), at(after).alias(f"{value}_{after}"))


def score_delta(scored: DataFrame, before: str, after: str, value: str = "teds_full") -> DataFrame:
    """(sample_id, score_delta): how much higher the later stage scores; null where either has no score."""
    at = lambda stage: F.max(F.when(F.col("stage") == stage, F.col(value)))
    return scored.groupBy("sample_id").agg((at(after) - at(before)).alias("score_delta"))


def pair_by_stem(images: DataFrame, pages: DataFrame) -> DataFrame:
    """Image x.png with page x.html, by file stem; image stems may repeat, a stem that two pages have is an error."""
    left = pages.groupBy(H.path_stem(F.col("path")).alias("stem")).agg(F.min("path").alias("html_path"), F.count(F.lit(1)).alias("_n"))
    twice = F.raise_error(F.format_string("%d pages have the stem %s", F.col("_n"), F.col("stem"))).cast("string")
    left = left.select("stem", F.when(F.col("_n") > 1, twice).otherwise(F.col("html_path")).alias("html_path"))
    right = images.select(H.path_stem(F.col("path")).alias("stem"), F.col("path").alias("image_path"))
    return salted_join(left, right, "stem", hot_keys(right, "stem"))


def content_key(*parts: Column) -> Column:
    """Digest of several values; lengths keep ('a','bc') and ('ab','c') apart."""
    pieces = []
    for p in parts:
        raw = p.cast("binary")
        pieces += [F.coalesce(F.octet_length(raw).cast("string"), F.lit("-")).cast("binary"), F.lit(b":"),
                   F.coalesce(raw, F.lit(b""))]
    return F.sha2(F.concat(*pieces), 256)
