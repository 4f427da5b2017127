"""One key holds a third of all rows."""

import pytest
from pyspark.sql import functions as F

from gridmill import schema as S
from gridmill.operators import balance as B, pairing as J, predict as P, skew as K, teds as E

N = 3000


def skewed(spark):
    key = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 500)
    return spark.range(N).select(key.cast("long").alias("key"), F.col("id").alias("row"))


def lookup(spark):
    return spark.range(0, 600).select(F.col("id").alias("key"), (F.col("id") * 2).alias("twice"))


def test_detection(spark):
    hot = dict(K.hot_keys(skewed(spark), "key", min_rows=100))
    assert set(hot) == {7} and hot[7] == 11
    exact = skewed(spark).groupBy("key").agg(F.count("*").alias("n"))
    assert dict(K.counted_hot_keys(exact, "key", 100)) == hot
    assert K.hot_keys(skewed(spark), "key") == []
    assert K.hot_keys(skewed(spark).limit(0), "key", 1) == []


@pytest.mark.parametrize("how", ["inner", "left", "right"])
def test_salted_join_equals_plain_join(spark, how):
    one = lookup(spark).where("key <> 11")
    many = skewed(spark)
    hot = K.hot_keys(many, "key", min_rows=100) + [(599, 4)]  # a key wrongly taken for hot
    got = K.salted_join(one, many, "key", hot if how != "left" else hot[:-1], how=how)
    want = one.join(many, "key", how)
    assert got.columns == want.columns
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_hot_rows_are_dealt_out(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        many = skewed(spark)
        out = K.salted_join(lookup(spark).hint("merge"), many, "key", K.hot_keys(many, "key", min_rows=50))
        per_task = out.where("key = 7").groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert len(per_task) > 4
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_equal_hot_rows_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(K, "PACK", 50)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        many = spark.range(2000).select(F.lit(7).cast("long").alias("key"), F.lit("same").alias("row"))
        out = K.salted_join(lookup(spark).hint("merge"), many, "key", [(7, 40)])
        per_task = out.groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert len(per_task) > 4 and sum(r["count"] for r in per_task) == 2000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_hot_sample_keeps_all_predictions(spark):
    truth = lookup(spark).select(F.col("key").alias("sample_id"), F.lit("<table></table>").alias("html_table"))
    preds = skewed(spark).select(F.col("key").alias("sample_id"), F.col("row").cast("string").alias("stage"),
                                 F.lit("x").alias("pred_html"), F.lit(None).cast("string").alias("error"))
    got = J.pair_predictions(truth, preds, min_hot=100)
    want = truth.join(preds, "sample_id", "left")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_copies_are_predicted_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def factory():
        import uuid

        def predict(prompts, images):
            for image in images:
                (calls / f"{bytes(image).decode()}-{uuid.uuid4().hex}").touch()
            return [f"<table>{bytes(i).decode()}</table>" for i in images]
        return predict

    df = skewed(spark).select(F.col("row").alias("sample_id"), F.col("key").cast("string").cast("binary").alias("image"))
    out = P.dedup_predict(df, factory, min_hot=100)
    rows = {r.sample_id: r.pred_html for r in out.collect()}
    assert rows == {r.row: f"<table>{r.key}</table>" for r in skewed(spark).collect()}
    assert len(list(calls.iterdir())) == skewed(spark).select("key").distinct().count()


def test_copies_of_a_pair_spread_over_tasks(spark):
    pairs = spark.range(400).select(F.col("id").alias("sample_id"), F.lit("<table><tr><td>a</td></tr></table>").alias("t"),
                                    F.lit("<table><tr><td>b</td></tr></table>").alias("p"))
    out = E.score_pairs(pairs, "t", "p", tasks=8).withColumn("task", F.spark_partition_id())
    rows = out.collect()
    assert len(rows) == 400 and {round(r.teds_full, 6) for r in rows} == {round(2 / 3, 6)}
    assert len({r.task for r in rows}) == 8


def grid(rows, text="a"):
    return "<table>" + f"<tr><td>{text}</td></tr>" * rows + "</table>"


def test_pairs_are_dealt_by_cost(spark):
    """A few huge pairs among many small ones, all read from one partition; times are those of the tasks that score."""
    import time

    rows = [(i, grid(60 if i % 20 == 0 else 6, f"t{i}"), grid(60 if i % 20 == 0 else 6, f"u{i}")) for i in range(400)]
    df = spark.createDataFrame(rows, "sample_id long, truth string, pred string").coalesce(1)
    keyed = df.select(J.content_key(F.col("truth"), F.col("pred")).alias("key"), E.pair_cost(F.col("truth"), F.col("pred")).alias("cost"), "truth", "pred")
    dealt = B.dealt_by_cost(keyed, keyed.select("key", "cost"), 8)
    loads = [r["c"] for r in dealt.groupBy(F.spark_partition_id()).agg(F.sum("cost").alias("c")).collect()]
    assert len(loads) == 8 and max(loads) <= 1.2 * sum(loads) / 8

    def timed(batches):
        import pyarrow as pa
        start = time.process_time()
        for _ in E._score_once(batches):
            pass
        yield pa.RecordBatch.from_pydict({"s": [time.process_time() - start]})

    for _ in range(2):  # the second time all workers run
        seconds = sorted(r.s for r in dealt.mapInArrow(timed, "s double").collect())
    assert seconds[-1] <= 2 * seconds[len(seconds) // 2]


def test_scores_do_not_depend_on_the_dealing(spark):
    a, b = grid(3), grid(3, "b")
    rows = [(i, "s", [a, grid(2), "x", None][i % 4], [b, a, a, a, grid(9, f"{i}")][i % 5]) for i in range(200)]
    df = spark.createDataFrame(rows, "sample_id long, stage string, t string, p string").repartition(5)
    want = E.score_pairs(df, "t", "p")
    for min_hot, tasks in ((5, 3), (10 ** 6, 40)):
        got = E.score_distinct(df, "t", "p", min_hot=min_hot, tasks=tasks)
        assert got.columns == want.columns and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert E.score_distinct(df.limit(0), "t", "p").count() == 0


def test_lists_of_the_dealing_follow_the_tasks(spark):
    costs = spark.range(20_000).select(F.md5(F.col("id").cast("string")).alias("key"), (F.col("id") % 50 + 1).cast("double").alias("cost"))
    listed, cells = B.assignment(costs, 4)
    assert len(listed) <= B.PART * 4 and len(cells) <= B.CELLS * 4 and set(cells.values()) == {0, 1, 2, 3}
    huge = costs.union(spark.createDataFrame([("huge", 1e9)], "key string, cost double"))
    listed, cells = B.assignment(huge, 4)
    assert set(listed) == {"huge"} and listed["huge"] not in cells.values()
