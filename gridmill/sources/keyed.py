"""Stored tables that rows are merged into by key, batch by batch.

A table is Parquet, partitioned by a coarse expression of its keys (a day, a block of steps). A batch rewrites the partitions it touches and
no others. Every row remembers the batch that wrote it last: running a batch again changes nothing, and a batch that
comes late does not undo a later one. A rewritten partition is staged first, so a job that dies is repaired by running the batch again.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridmill.sources.work import stage

PART, BATCH = "_part", "_batch"


def part_name(part: Column) -> Column:
    """A partition's name; the letter keeps Spark from reading names as numbers or times, which would change `007`."""
    return F.concat(F.lit("p"), part.cast("string"))


def _open(spark: SparkSession, path: str) -> DataFrame:
    """Partitions that a later batch has not touched lack the columns that it added."""
    return spark.read.option("mergeSchema", True).parquet(path)


def read(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The rows of a table without the columns of its upkeep; a schema makes a table that is not there empty."""
    try:
        return _open(spark, path).drop(PART, BATCH)
    except AnalysisException as e:
        if schema is None or e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema)


def read_parts(spark: SparkSession, path: str, parts: list[str]) -> DataFrame:
    """The rows of the partitions of some names; others are not opened."""
    return _open(spark, path).where(F.col(PART).isin(parts)).drop(PART, BATCH)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return _open(spark, path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def merge(rows: DataFrame, batch: int, path: str, keys: list[str], part: Column, insert: bool = True) -> None:
    """Put rows, one per key, into a table: new keys are added (unless `insert` is off), of known ones the columns that
    `rows` has are replaced.

    Columns that the table alone has stay, those that `rows` alone has are null in old rows. Keys may be null.
    """
    spark = rows.sparkSession
    new = stage(rows.withColumns({PART: part_name(part), BATCH: F.lit(batch).cast("long")}), "merge_rows")
    parts = [r[0] for r in new.select(PART).distinct().collect()]  # partitions of one batch
    old = _stored(spark, path)
    if old is None:
        merged = new if insert else new.limit(0)
    else:
        here = F.col(PART).isin([p for p in parts if p is not None]) | (F.col(PART).isNull() if None in parts else F.lit(False))
        old = old.where(here)
        a, b = old.select(F.struct("*").alias("a")), new.select(F.struct("*").alias("b"))
        on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, PART]]
        both = a.join(b, on, "full" if insert else "left")
        later = F.col("b").isNotNull() & (F.col(f"a.{BATCH}").isNull() | (F.col(f"a.{BATCH}") <= F.col(f"b.{BATCH}")))
        pick = lambda c: (F.when(later, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")) if c in old.columns and c in new.columns else
                          F.col(f"a.{c}") if c in old.columns else F.when(later, F.col(f"b.{c}")))
        names = [*old.columns, *(c for c in new.columns if c not in old.columns)]
        merged = stage(both.select(*[pick(c).alias(c) for c in names]), "merged")
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)
