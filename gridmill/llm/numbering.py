"""Places of rows in an order, where one group may hold most of the rows."""

from pyspark.sql import DataFrame, Window, functions as F

from gridmill.sources.work import stage


def range_sorted(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """The rows in range partitions, sorted by `order` inside each, with `_at`: partition << 33 | place in it.

    The rows are written first, with a number that no two share: so equal rows can be cut apart, and a task that
    runs again makes the same cut. Both tables are in the shared work folder.
    """
    rows = stage(df.withColumn("_tie", F.monotonically_increasing_id()), name)
    cut = rows.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
    return stage(cut.withColumn("_at", F.monotonically_increasing_id()), f"{name}_sorted")


def part_of(at: str = "_at"):
    return F.shiftright(F.col(at), 33).cast("long")


def numbered(df: DataFrame, by: str, order: list[str], name: str) -> DataFrame:
    """Add `pos`, the place of a row among those of equal `by` (0 first; nulls first, ties any way), and `size`, their number.

    `by` may not be null. The window sees one row per range partition of a group, whatever the group's size.
    """
    rows = range_sorted(df, [by, *order], name)
    parts = rows.groupBy(by, part_of().alias("_part")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(by)
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.select(by, "_part", F.sum("_n").over(group).alias("size"),
                          (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    placed = rows.withColumn("_part", part_of()).join(shifts, [by, "_part"])
    return placed.select(*df.columns, (F.col("_at") + F.col("_shift")).alias("pos"), "size")
