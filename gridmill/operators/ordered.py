"""Windows over long runs.

A window partitioned by run alone puts a whole run into one task. Here the rows of a run are cut
into blocks of the ordering number, the window works inside (run, block), and what crosses a
block border comes from a summary with one row per block. The summary joins back on the very
keys the window is already partitioned by, so the wide side is shuffled once.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gridmill.functions.order import div

BLOCK = 1 << 20  # values of the ordering number per block, hence rows when they are unique


def with_block(df: DataFrame, order: str, size: int = BLOCK) -> DataFrame:
    return df.withColumn("_block", div(F.col(order), size))


def inside(by: list[str], *order) -> "W":
    """Window within one block."""
    return W.partitionBy(*by, "_block").orderBy(*order)


def with_carry(df: DataFrame, by: list[str], aggs: list[Column],
               carry: Callable[[object, object], list[Column]]) -> DataFrame:
    """Join per-block values computed from the summaries of the run's other blocks.

    `aggs` summarise a block; `carry(before, whole)` returns columns over the summary, given a
    window ordered by block and one over all blocks of the run.
    """
    summary = df.groupBy(*by, "_block").agg(*aggs)
    over = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    carried = summary.select(*by, "_block", *carry(over.orderBy("_block"), over))
    return df.join(carried, [*by, "_block"])


def earlier(window) -> object:
    """All blocks before the current one."""
    return window.rowsBetween(W.unboundedPreceding, -1)


def with_totals_before(df: DataFrame, aggs: list[Column], names: list[str], levels: int = 2, size: int = BLOCK) -> DataFrame:
    """`with_carry` of the totals `names` of earlier blocks as {name}_before, for one run over the whole table.

    Totals are added up in groups of `size` blocks, those in groups again, and only the groups of the last level,
    at most 16 of a 64-bit number, share a window.
    """
    def before(rows: DataFrame, levels: int) -> DataFrame:
        rows = rows.withColumn("_group", div(F.col("_block"), size) if levels else F.lit(0))
        over = earlier(W.partitionBy("_group").orderBy("_block"))
        rows = rows.withColumns({f"{c}_before": F.coalesce(F.sum(c).over(over), F.lit(0)) for c in names})
        if not levels:
            return rows.select("_block", *[f"{c}_before" for c in names])
        groups = rows.groupBy(F.col("_group").alias("_block")).agg(*[F.sum(c).alias(c) for c in names])
        above = before(groups, levels - 1).select(F.col("_block").alias("_group"), *[F.col(f"{c}_before").alias(f"{c}_above") for c in names])
        return rows.join(above, "_group").select(
            "_block", *[(F.col(f"{c}_before") + F.col(f"{c}_above")).alias(f"{c}_before") for c in names])

    return df.join(before(df.groupBy("_block").agg(*aggs), levels), "_block")


def with_index(df: DataFrame, by: list[str], order: str, size: int = BLOCK) -> DataFrame:
    """Add `pos`, the 0-based place of a row in its run."""
    blocked = with_block(df, order, size).withColumn("_rank", F.row_number().over(inside(by, order)))
    counted = with_carry(
        blocked, by, [F.count(F.lit(1)).alias("_n")],
        lambda before, whole: [F.coalesce(F.sum("_n").over(earlier(before)), F.lit(0)).alias("_before")])
    return counted.withColumn("pos", F.col("_before") + F.col("_rank") - 1).drop("_block", "_rank", "_before")
