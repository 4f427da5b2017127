"""Exact, seeded sampling and splitting without sorting the table in one place.

Rows are ordered by md5(seed:id), ties by id. Counting rows per hash prefix gives 65,536
numbers whatever the table size; their running sum tells which prefix holds the k-th row, and
ranking that prefix alone (1/65536 of the ids) gives the k-th row itself. Everything else is a
comparison of a row's own hash with that cut point, so no row of the table is shuffled. Ids are
unique (they are row positions), which is what makes the prefixes even.

A split reads the table three times: to count, to rank one prefix, to label. Store an expensive table
before splitting it.
"""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gridmill.functions import order as O
from gridmill.operators.ranking import with_ids
from gridmill.sources.work import stage

# Evaluation sizes by capacity tier (at least this many devices, quick, thorough).
EVAL_TIERS = [(8, 50, 150), (4, 30, 100), (0, 20, 75)]
THOROUGH_EVERY = 5


def _keyed(df: DataFrame, seed: int) -> DataFrame:
    keyed = df.withColumn("_key", O.hash_key(F.col("sample_id"), seed))
    return keyed.withColumn("_bucket", O.hash_bucket(F.col("_key")))


def _offsets(df: DataFrame, seed: int) -> DataFrame:
    """(bucket, n, before, total): at most 65,536 rows, so one task may sum them up."""
    hist = _keyed(df.select("sample_id"), seed).groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    run = W.partitionBy(F.lit(0)).orderBy("_bucket")
    return hist.select(
        "_bucket", "_n",
        F.coalesce(F.sum("_n").over(run.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_n").over(W.partitionBy(F.lit(0))).alias("_total"),
    )


def _cut(df: DataFrame, seed: int, k: Column) -> Column:
    """Scalar struct (key, id) of the k-th row in seeded order, the last row if there are fewer."""
    rows = _offsets(df, seed).withColumn("_k", F.least(k.cast("bigint"), F.col("_total")))
    found = rows.where((F.col("_before") < F.col("_k")) & (F.col("_before") + F.col("_n") >= F.col("_k")))
    bucket = F.broadcast(found.select("_bucket", (F.col("_k") - F.col("_before")).alias("_need")))  # one row
    rank = F.row_number().over(W.partitionBy("_bucket").orderBy("_key", "sample_id"))
    edge = _keyed(df.select("sample_id"), seed).join(bucket, "_bucket").withColumn("_rank", rank)
    kth = edge.where(F.col("_rank") == F.col("_need"))
    return kth.agg(F.max(F.struct("_key", "sample_id"))).scalar()


def _is_first(df: DataFrame, seed: int, k: Column) -> Column:
    """Is the row among the first k of the seeded order?"""
    own = F.struct(O.hash_key(F.col("sample_id"), seed).alias("_key"), F.col("sample_id"))
    return F.coalesce(own <= _cut(df, seed, k), F.lit(False))


def split_exact(df: DataFrame, num: int, den: int, seed: int) -> DataFrame:
    """Relabel `split`: exactly n*num div den rows are train, the others validation."""
    k = O.div(F.col("_total") * num, den)
    return df.withColumn("split", F.when(_is_first(df, seed, k), "train").otherwise("validation"))


def sample_n(df: DataFrame, n: int, seed: int) -> DataFrame:
    """Exactly min(n, rows) rows, the same ones for the same seed.

    The ids are read once and stored; counting and ranking go over them. The table is read once more for the chosen rows.
    """
    ids = stage(df.select("sample_id"), "ids")
    own = F.struct(O.hash_key(F.col("sample_id"), seed).alias("_key"), F.col("sample_id"))
    return df.where(F.coalesce(own <= _cut(ids, seed, F.lit(n)), F.lit(False)))


def seeded_index(df: DataFrame, seed: int) -> DataFrame:
    """(sample_id, position): 0-based place of every row in the seeded shuffle."""
    offsets = F.broadcast(_offsets(df, seed).select("_bucket", "_before", "_total"))  # <= 65,536 rows
    rank = F.row_number().over(W.partitionBy("_bucket").orderBy("_key", "sample_id"))
    placed = _keyed(df.select("sample_id"), seed).withColumn("_rank", rank).join(offsets, "_bucket")
    return placed.select("sample_id", (F.col("_before") + F.col("_rank") - 1).alias("position"),
                         F.col("_total").alias("n_rows"))


def assign_batches(df: DataFrame, world: int, batch: int, accum: int, seed: int, drop_last: bool) -> DataFrame:
    """Seeded order dealt out to loader batches: micro-batch, optimizer step and worker rank."""
    per_micro = world * batch
    placed = seeded_index(df, seed)
    if drop_last:
        placed = placed.where(F.col("position") < F.col("n_rows") - F.col("n_rows") % per_micro)
    return placed.select(
        "sample_id", "position",
        O.div(F.col("position"), per_micro).alias("micro_batch"),
        O.div(F.col("position"), per_micro * accum).alias("step"),
        (F.col("position") % world).alias("worker"),
    )


def first_n(df: DataFrame, n: int) -> DataFrame:
    """First n rows by position; only ids are ranked, and the n rows are fetched by them."""
    return with_ids(df, df.select("sample_id").orderBy("sample_id").limit(n), n).select(*df.columns)


def tiered_sample(df: DataFrame, devices: int, evaluation: int) -> DataFrame:
    """Rows of one evaluation: every fifth evaluation is thorough, sizes grow with the tier."""
    quick, thorough = next((q, t) for least, q, t in EVAL_TIERS if devices >= least)
    return first_n(df, thorough if evaluation % THOROUGH_EVERY == 0 else quick)
