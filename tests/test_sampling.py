import hashlib

import pytest
from pyspark.sql import functions as F

from gridmill import schema as S
from gridmill.operators import ranking as T, sampling as P


def samples(spark, n, parts=4):
    return spark.range(n).repartition(parts).select(
        F.col("id").alias("sample_id"), F.lit("train").alias("split"), F.repeat(F.lit("x"), (F.col("id") % 7).cast("int")).alias("html_table"),
        F.lit(None).cast("binary").alias("image"))


def shuffled(n, seed):
    return sorted(range(n), key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))


@pytest.mark.parametrize("n, num, den", [(0, 85, 100), (1, 85, 100), (2, 85, 100), (7, 85, 100), (1000, 85, 100), (999, 99, 100)])
def test_split_is_exact(spark, n, num, den):
    out = P.split_exact(samples(spark, n), num, den, 3407).collect()
    train = {r.sample_id for r in out if r.split == "train"}
    assert sorted(r.sample_id for r in out) == list(range(n))
    assert train == set(shuffled(n, 3407)[:n * num // den])


def test_split_does_not_depend_on_partitions(spark):
    a, b = (P.split_exact(samples(spark, 500, p), 85, 100, 1).select("sample_id", "split") for p in (1, 9))
    assert a.exceptAll(b).count() == 0


@pytest.mark.parametrize("k", [0, 1, 250, 500, 900])
def test_sample_n(spark, k):
    got = {r.sample_id for r in P.sample_n(samples(spark, 500), k, 42).collect()}
    assert got == set(shuffled(500, 42)[:k])


@pytest.mark.parametrize("drop_last", [True, False])
def test_batches(spark, drop_last):
    rows = P.assign_batches(samples(spark, 103), 4, 2, 3, 5, drop_last).orderBy("position").collect()
    order = shuffled(103, 5)
    n = 103 // 8 * 8 if drop_last else 103
    assert [r.sample_id for r in rows] == order[:n]
    assert all((r.micro_batch, r.step, r.worker) == (r.position // 8, r.position // 24, r.position % 4) for r in rows)


def test_tiers(spark):
    df = samples(spark, 200)
    sizes = [P.tiered_sample(df, d, e).count() for d in (8, 4, 1) for e in (1, 5)]
    assert sizes == [50, 150, 30, 100, 20, 75]
    assert P.tiered_sample(samples(spark, 10), 8, 5).count() == 10


def test_topk_ties_keep_order(spark):
    rows = T.topk_longest(samples(spark, 50), 9).orderBy("rank").collect()
    want = sorted(range(50), key=lambda i: -(i % 7))[:9]
    assert [r.sample_id for r in rows] == want and [r.rank for r in rows] == list(range(1, 10))
    assert set(S.SAMPLES.names) <= set(rows[0].asDict())
