"""One-pass reports. Every group key here has a handful of values and is combined map-side."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gridmill.functions import html as H, order as O
from gridmill.operators import curate as C


def filter_report(df: DataFrame) -> DataFrame:
    """Per split: rows before, kept, removed and kept share in percent."""
    kept = F.count_if(F.col("reason").isNull())
    total = F.count(F.lit(1))
    return C.with_reject_reason(df).groupBy("split").agg(
        total.alias("original"),
        kept.alias("kept"),
        (total - kept).alias("removed"),
        F.round(kept / F.nullif(total, F.lit(0)) * 100, 2).alias("kept_pct"),
    )


def reject_histogram(df: DataFrame) -> DataFrame:
    reasons = C.with_reject_reason(df).where(F.col("reason").isNotNull())
    return reasons.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def error_histogram(df: DataFrame) -> DataFrame:
    """Rows per error type, over rows that carry an error."""
    typed = df.where(F.col("error").isNotNull()).select(H.error_type(F.col("error")).alias("error_type"))
    return typed.groupBy("error_type").agg(F.count(F.lit(1)).alias("n"))


def first_errors(df: DataFrame, n: int = 5) -> DataFrame:
    """Messages among the first n invalid rows; invalid rows without a message use up a place."""
    first = df.where(F.col("status") != "valid").select("sample_id", "error").orderBy("sample_id").limit(n)
    return first.where(F.col("error").isNotNull())


def split_report(df: DataFrame) -> DataFrame:
    """Per split: rows and share in percent."""
    per = df.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    whole = W.partitionBy(F.lit(0))  # one row per split
    return per.withColumn("pct", F.round(F.col("n") / F.sum("n").over(whole) * 100, 1))


def size_report(df: DataFrame, keep: Column) -> DataFrame:
    """Rows per split before and after a filter, in one pass."""
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_before"), F.count_if(F.coalesce(keep, F.lit(False))).alias("n_after")
    )


def success_count(results: DataFrame) -> DataFrame:
    ok = C.ocr_status(F.col("ocr_result")) == "success"
    return results.agg(F.count_if(ok).alias("n_success"), F.count(F.lit(1)).alias("n_total"))


def step_plan(splits: DataFrame, configs: list[tuple[int, int, int, int]]) -> DataFrame:
    """Optimizer steps per split count and (batch, accumulation, devices, epochs) setting."""
    settings = F.array(*[
        F.struct(*[F.lit(v).cast("bigint").alias(k) for k, v in zip(("batch", "accum", "devices", "epochs"), c)])
        for c in configs
    ])
    rows = splits.select("split", "n", F.inline(settings))
    per_step = F.col("batch") * F.col("accum") * F.col("devices")
    return rows.withColumns({
        "steps_per_epoch": O.div(F.col("n"), per_step),
        "total_steps": O.div(F.col("n") * F.col("epochs"), per_step),
    })
