"""Joins that hold when one key owns a large part of the rows."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# A key is hot when it holds more than one in HOT_SHARE rows, so there are at most HOT_SHARE hot
# keys and the table of them can be broadcast whatever the data size.
HOT_SHARE = 10_000
HOT_ROWS = 1_000_000  # and never below this many rows
PACK = 10_000         # copies of an equal row that travel as one
TRACKED = 65_536      # counters of the heavy-hitter sketch; error bound well below 1 / HOT_SHARE


def hot_keys(df: DataFrame, key: str, min_rows: int = HOT_ROWS) -> list[tuple]:
    """(key, salts) for every key that is too big for one task.

    A mergeable frequent-items sketch, so no shuffle by key is needed to find out. The answer
    only steers where rows go; a missed key costs time, never rows.
    """
    found = df.where(F.col(key).isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(`{key}`, {HOT_SHARE}, {TRACKED})").alias("top")).first()
    limit = max(min_rows, found["n"] // HOT_SHARE)
    return [(t["item"], -(-t["count"] // limit)) for t in found["top"] or [] if t["count"] > limit]


def counted_hot_keys(counts: DataFrame, key: str, min_rows: int = HOT_ROWS) -> list[tuple]:
    """The same from a (key, n) table with exact counts."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    limit = max(min_rows, total // HOT_SHARE)
    hot = counts.where(F.col("n") > limit).select(key, F.ceil(F.col("n") / limit))
    return [tuple(r) for r in hot.collect()]  # at most HOT_SHARE rows


def salted_join(one: DataFrame, many: DataFrame, key: str, hot: list[tuple], spread: list[str] | None = None,
                how: str = "inner", tasks: int | None = None) -> DataFrame:
    """Join a table with unique keys to one whose keys repeat without bound.

    Rows of a hot key are dealt over its salts by a hash of `spread` (default: all other columns) and the matching unique
    row is repeated once per salt; other keys are joined as they are. Equal rows have one hash, so those of hot keys are
    counted first and travel as rows that stand for up to PACK copies; which row goes where depends on values alone, not
    on the order in which a task that runs again meets them.
    `how` is inner, left (keep every row of `one`) or right (keep every row of `many`). With
    `tasks`, the join has that many partitions, which adaptive execution does not merge.
    """
    deal = lambda df, *keys: df if tasks is None else df.repartition(tasks, *keys)
    if not hot:
        return deal(one, key).join(deal(many, key), key, how)
    schema = many.select(key).schema.add("_salts", "integer")
    salts = F.broadcast(one.sparkSession.createDataFrame([(k, int(s)) for k, s in hot], schema))
    spread = spread or [c for c in many.columns if c != key]
    packed = many.join(salts, key).groupBy(*many.columns, "_salts").agg(F.count(F.lit(1)).alias("_n"))
    packed = packed.withColumn("_pack", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / PACK))))
    left = F.least(F.lit(PACK), F.col("_n") - F.col("_pack") * PACK).cast("int").alias("_times")
    dealt = packed.select(*many.columns, F.pmod(F.xxhash64(*spread, "_pack"), F.col("_salts")).cast("int").alias("_salt"), left)
    cold = many.join(salts, key, "left_anti").select(*many.columns, F.lit(0).alias("_salt"), F.lit(1).alias("_times"))
    dealt = dealt.unionByName(cold).withColumn("_hit", F.lit(True))
    copies = one.join(salts, key, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)))
    joined = deal(copies, key, "_salt").join(deal(dealt, key, "_salt"), [key, "_salt"], how)
    if how == "left":  # a hot key has rows by definition: a copy that met none is not a miss
        joined = joined.where(F.col("_hit").isNotNull() | F.col("_salts").isNull())
    repeated = joined.withColumn("_time", F.explode(F.array_repeat(F.lit(True), F.coalesce("_times", F.lit(1)))))
    return repeated.drop("_salt", "_salts", "_hit", "_times", "_time")


def once_per_task(df: DataFrame, key: str, remembered: int = 1 << 20) -> DataFrame:
    """The rows without repeats of a key that the same task has already passed on.

    A combiner for wide rows: what it lets through still has repeats of a key from several tasks, or beyond as many
    keys as are `remembered`. Keys are digests or other short strings; null keys pass.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            new = []
            for at, value in enumerate(batch.column(key).to_pylist()):
                if value is None or value not in seen:
                    new.append(at)
                    if value is not None:
                        seen.add(value)
            if len(seen) > remembered:
                seen.clear()
            if new:
                yield batch if len(new) == batch.num_rows else batch.take(pa.array(new, pa.int64()))

    return df.mapInArrow(run, df.schema)
