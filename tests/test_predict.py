import contextlib
import uuid

import pytest
from pyspark.sql import functions as F

from gridmill import schema as S
from gridmill.functions import messages as M, tokens as K
from gridmill.sources import tables as IO
from gridmill.operators import curate as C, predict as P, reports as R
from gridmill.operators.skew import once_per_task
from gridmill.plans import flows, stubs


def images(spark, names):
    rows = [(i, "train", f"<table>{'x' * i}</table>", None if n is None else n.encode()) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, S.SAMPLES)


def raising_model():
    def predict(prompts, images):
        if any(b"bad" in bytes(i) for i in images):
            raise RuntimeError("cannot read: bad")
        if any(b"short" in bytes(i) for i in images):
            return []
        return [f" {p}<b>{bytes(i).decode()}</b> " for p, i in zip(prompts, images)]
    return predict


def test_only_failing_rows_carry_an_error(spark):
    df = images(spark, ["a", "bad1", "b", "short", "c"]).coalesce(1)
    out = {r.sample_id: (r.pred_html, r.error) for r in P.batch_predict(df, raising_model, "s", F.lit("p"), batch=5).collect()}
    assert out == {0: ("p<b>a</b>", None), 1: (None, "cannot read: bad"), 2: ("p<b>b</b>", None),
                   3: (None, "predictor returned another number of texts"), 4: ("p<b>c</b>", None)}


def test_error_policies(spark):
    df = images(spark, ["bad", "a"])
    for policy, want in (("empty", ""), ("prefix", "Error: cannot read: bad"), ("report", None)):
        out = {r.sample_id: r.pred_html for r in P.batch_predict(df, raising_model, on_error=policy, clean="none").collect()}
        assert out == {0: want, 1: " <b>a</b> "}


def test_ocr_job(spark):
    df = images(spark, [f"i{n}" for n in range(30)]).union(spark.createDataFrame([(99, "train", None, b"x")], S.SAMPLES))
    results = P.ocr_job(df, stubs.stub_model, 20).orderBy("row_index")
    rows = results.collect()
    assert [r.html_table_length for r in rows] == sorted((15 + n for n in range(30)), reverse=True)[:20]
    assert rows[0].ocr_result == "Error: no table in i29"
    summary = P.ocr_summary(results).orderBy("row_index").collect()
    assert summary[0].error_message == rows[0].ocr_result and summary[1].error_message is None
    counted = R.success_count(results).first()
    assert (counted.n_success, counted.n_total) == (16, 20)
    assert P.ocr_pairs(results).count() == 32


def test_tokenize_and_filter(spark):
    df = spark.createDataFrame([(1, "train", "ab c", None), (2, "train", None, None)], S.SAMPLES)
    enc = P.tokenize(df, stubs.stub_tokenizer)
    rows = {r.sample_id: (r.input_ids, r.labels, r.error) for r in enc.collect()}
    assert rows == {1: ([2, 1], [2, 1], None), 2: (None, None, "Encoding failed: no text")}
    assert C.filter_encodable(enc, 5).columns == S.SAMPLES.names
    assert [r.sample_id for r in C.filter_encodable(enc, 5).collect()] == [1]
    assert C.filter_encodable(enc, 1).count() == 0


def test_clamping(spark):
    df = spark.createDataFrame([([-1, 5, 100, 109, 110, 777, 200], [-100, 200, 5, 777, 105, 300, -100])],
                               "input_ids array<int>, labels array<int>")
    args = (100, [777], 100, 110)
    ids, labels = F.col("input_ids"), F.col("labels")
    row = df.select(K.clamp_ids(ids, *args).alias("a"), K.clamp_ids(labels, *args, ignore=-100).alias("b"),
                    K.clamped_count(ids, *args).alias("c"), K.preserved_count(ids, *args).alias("p"),
                    K.token_range_error(ids, labels, 100).alias("e"), K.token_range_error(F.slice(ids, 2, 1), labels, 100).alias("f")).first()
    assert row.a == [-1, 5, 100, 109, 0, 777, 0] and row.b == [-100, 0, 5, 777, 105, 0, -100]
    assert (row.c, row.p) == (2, 3)
    assert row.e == "Invalid input_ids: range [-1, 777] vs vocab_size 100"
    assert row.f == "Invalid labels: range [5, 777] vs vocab_size 100"
    audit = C.audit_clamped(df, *args, enforce=False).first()
    assert (audit.n_rows, audit.n_bad) == (1, 1)
    try:
        C.audit_clamped(df, *args).collect()
        raise AssertionError("audit passed")
    except Exception as e:
        assert "1 rows hold token ids" in str(e)


def test_messages(spark):
    df = spark.createDataFrame([(1, "train", "<t>", b"i")], S.SAMPLES)
    html, image = F.col("html_table"), F.col("image")
    row = df.select(M.to_parts_messages("do", html, image).alias("p"), M.to_prompt_messages("do", image).alias("q"),
                    M.to_prompt_messages("do", image, "sys").alias("s"), M.to_flat_messages("do", html).alias("f")).first()
    assert [(m.role, [c.type for c in m.content]) for m in row.p] == [("user", ["text", "image"]), ("assistant", ["text"])]
    assert [(m.role, [c.type for c in m.content]) for m in row.q] == [("user", ["image", "text"])]
    assert [m.role for m in row.s] == ["system", "user"]
    flat = df.select(M.to_flat_messages("do", html).alias("f"), "html_table")
    one = flat.select(F.slice("f", 1, 1).alias("f"), "html_table")
    truth = lambda d, **k: d.select(M.ground_truth(F.col("f"), **k).alias("t")).first().t
    assert truth(flat) == "<t>" and truth(one) is None
    assert truth(one, html=F.col("html_table")) == "<t>" and truth(one, default=F.lit("")) == ""


def test_evaluate_flow(spark):
    df = spark.createDataFrame([(i, "train", f"<table><tr><td>img{i}</td></tr></table>", f"img{i}".encode()) for i in range(10)], S.SAMPLES)
    row = flows.evaluate(df, stubs.stub_model, "pre").collect()
    # images ending in 4 or 9 fail and count as zero; the others are exact
    assert len(row) == 1 and row[0].n_evaluated == 10 and abs(row[0].avg_full - 0.8) < 1e-9
    first = flows.evaluate(df, stubs.stub_model, "pre", n=3).first()
    assert first.n_evaluated == 3 and first.avg_full == 1.0


def counting(folder):
    """A factory that leaves a file for every load and every answered image."""
    def factory():
        predict = stubs.stub_model()
        (folder / f"load-{uuid.uuid4()}").touch()

        def counted(prompts, images):
            for _ in images:
                (folder / f"call-{uuid.uuid4()}").touch()
            return predict(prompts, images)
        return counted
    return factory


def test_exporting_ocr_runs_the_model_once(spark, tmp_path):
    rows = spark.createDataFrame([(i, "train", "<table>" + "x" * i, f"img{i}".encode()) for i in range(30)], S.SAMPLES)
    (tmp_path / "seen").mkdir()
    IO.export_ocr(P.ocr_job(rows, counting(tmp_path / "seen"), 20), f"{tmp_path}/out")
    assert len(list((tmp_path / "seen").glob("call-*"))) == 20
    assert IO.read_ocr_summary(spark, f"{tmp_path}/out").count() == 20
    assert IO.read_ocr_pairs(spark, f"{tmp_path}/out").count() == 2 * 16


def test_repeated_rows_and_null_ids_are_kept_once(spark, tmp_path):
    rows = [(1, "train", None, b"a")] * 2 + [(None, "train", None, b"b")] * 2 + [(2, "train", None, b"c"), (None, "train", None, b"c")]
    rows += [(None, "train", None, None), (3, "train", None, b"d"), (4, "train", None, b"d")]
    df = spark.createDataFrame(rows, "sample_id long, split string, html_table string, image binary")
    for min_hot in (1, 10 ** 6):
        (tmp_path / str(min_hot)).mkdir()
        model = counting(tmp_path / str(min_hot))
        one, many = (sorted(map(str, f.collect())) for f in (P.dedup_predict(df, model, min_hot=min_hot), P.batch_predict(df, stubs.stub_model)))
        assert one == many and len(one) == len(rows)
        assert len(list((tmp_path / str(min_hot)).glob("call-*"))) == 5


@contextlib.contextmanager
def reuse(spark, on):
    """Whether Spark keeps Python workers for later tasks."""
    conf = spark._jvm.org.apache.spark.SparkEnv.get().conf()
    before = conf.get("spark.python.worker.reuse", "true")
    conf.set("spark.python.worker.reuse", str(on).lower())
    try:
        yield
    finally:
        conf.set("spark.python.worker.reuse", before)


@pytest.mark.parametrize("on", [True, False])
def test_model_loads_follow_slots_and_not_partitions(spark, tmp_path, on):
    df = images(spark, [f"i{n}" for n in range(60)]).repartition(40)
    with reuse(spark, on):
        assert P.dedup_predict(df, counting(tmp_path)).count() == 60
        assert len(list(tmp_path.glob("call-*"))) == 60
        assert len(list(tmp_path.glob("load-*"))) <= 8
        assert P.batch_predict(df, counting(tmp_path), workers=3).count() == 60
        assert len(list(tmp_path.glob("load-*"))) <= 8 + 3
        assert P.ocr_job(df, counting(tmp_path), 20).count() == 20
        assert len(list(tmp_path.glob("load-*"))) <= 8 + 3 + 8
    assert len(list(tmp_path.glob("call-*"))) == 140


def test_partitions_stay_as_they_are_unless_workers_bound_them(spark, tmp_path):
    """What a task reads does not grow with the table; the model is loaded by Python workers, not by tasks."""
    df = images(spark, [f"i{n}" for n in range(60)]).repartition(40)
    tasks = lambda **k: P.run_predictor(df.withColumn("prompt", F.lit("")), ["sample_id"], counting(tmp_path), **k).rdd.getNumPartitions()
    assert tasks() == 40 and tasks(workers=3) == 3
    assert P.batch_predict(df, counting(tmp_path)).count() == 60
    assert len(list(tmp_path.glob("call-*"))) == 60 and len(list(tmp_path.glob("load-*"))) <= 16


def test_batches_keep_to_rows_and_bytes():
    parts = lambda sizes, most, budget: list(P.batches(["p"] * len(sizes), [b"x" * (n - 1) for n in sizes], most, budget))
    assert parts([1, 1, 1, 1, 1], 2, 99) == [(0, 2), (2, 4), (4, 5)]
    assert parts([5, 50, 5, 5, 1], 9, 10) == [(0, 1), (1, 2), (2, 4), (4, 5)]
    assert parts([], 2, 9) == [] and list(P.batches([None], [None], 1, 1)) == [(0, 1)]


def test_a_second_job_makes_no_model_call(spark, tmp_path):
    df = images(spark, [f"i{n % 7}" for n in range(40)])
    cache, seen = str(tmp_path / "cache"), tmp_path / "seen"
    seen.mkdir()
    calls = lambda: len(list(seen.glob("call-*")))
    first = sorted(map(str, P.dedup_predict(df, counting(seen), cache=cache).collect()))
    assert first == sorted(map(str, P.batch_predict(df, stubs.stub_model).collect())) and calls() == 7
    # i4 fails and is tried again; all others are known
    assert sorted(map(str, P.dedup_predict(df, counting(seen), cache=cache).collect())) == first and calls() == 8
    more = images(spark, [f"i{n}" for n in range(10)])
    assert P.dedup_predict(more, counting(seen), cache=cache).count() == 10 and calls() == 12


def test_copies_do_not_cross_the_shuffle(spark, tmp_path):
    df = images(spark, ["same"] * 5000 + ["other", None, None]).repartition(4)
    keyed = P._keyed(df, None)
    assert once_per_task(keyed, "_key").count() <= 3 * 4
    assert P.dedup_predict(df, counting(tmp_path)).count() == 5003
    assert len(list(tmp_path.glob("call-*"))) == 3
