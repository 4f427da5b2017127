"""Top-k hold-out selection and its export manifest."""

from pyspark.sql import DataFrame, Window as W, functions as F

from gridmill.functions import html as H

BROADCAST_ROWS = 100_000  # of (id, length, rank): a few MB
PUSHED_ROWS = 1_000       # ids that are sent to the scan as a filter


def topk_ids(df: DataFrame, k: int) -> DataFrame:
    """(sample_id, html_length, rank) of the k longest tables; ties keep position order.

    Only two numbers per row reach the sort, which is a top-k, not a full sort; the ranking
    window sees the k survivors.
    """
    narrow = df.select("sample_id", F.length("html_table").alias("html_length"))
    top = narrow.orderBy(F.desc("html_length"), "sample_id").limit(k)
    by_rank = W.partitionBy(F.lit(0)).orderBy(F.desc("html_length"), "sample_id")
    return top.withColumn("rank", F.row_number().over(by_rank))


def with_ids(df: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """Fetch the wide rows of k chosen ids.

    A few ids are computed at once and become a filter of the scan, which skips the row groups and pages of a stored table that
    hold none of them: the html and images of other rows are not read.
    """
    if k > PUSHED_ROWS:
        return df.join(F.broadcast(ids) if k <= BROADCAST_ROWS else ids, "sample_id")
    chosen = ids.collect()
    few = df.sparkSession.createDataFrame(chosen, ids.schema)
    return df.where(F.col("sample_id").isin([r["sample_id"] for r in chosen])).join(F.broadcast(few), "sample_id")


def topk_longest(df: DataFrame, k: int) -> DataFrame:
    """The k longest rows with `html_length` and `rank`, images included."""
    return with_ids(df, topk_ids(df, k), k)


def export_manifest(ranked: DataFrame) -> DataFrame:
    """File names and length of every ranked hold-out row."""
    return ranked.select(
        "rank", "sample_id",
        H.sample_file(F.col("rank"), ".png").alias("image_file"),
        H.sample_file(F.col("rank"), ".html").alias("html_file"),
        "html_length",
    )
