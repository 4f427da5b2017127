"""Streams over several triggers give what the batch operator gives on all of the data."""

import datetime as dt
import random
import uuid

from pyspark.sql import functions as F

from gridmill import schema as S
from gridmill.operators import curate as C, runlog as L
from gridmill.sources import derived as D, tables as IO
from gridmill.streaming import streams as ST

FOLDER = "/root/testdata/sf0.001"


def parted(df, path, parts, order):
    """Write `parts` files, in this order of rows, and stream them one per trigger."""
    bounds = df.approxQuantile(order, [i / parts for i in range(1, parts)], 0.0)
    edges = [None, *bounds, None]
    for lo, hi in zip(edges, edges[1:]):
        part = df if lo is None else df.where(F.col(order) > lo)
        part = part if hi is None else part.where(F.col(order) <= hi)
        part.coalesce(1).write.mode("append").parquet(str(path))
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_clean_filter(spark, tmp_path):
    df = D.samples(spark, FOLDER)
    got = ST.run_available(ST.clean_filter(parted(df, tmp_path / "s", 3, "sample_id")))
    assert same(got, C.filter_and_clean(df).select(*got.columns))


def rates(df):
    return df.select("run_id", "step", F.round("samples_per_sec", 9).alias("r"))


def test_throughput_keeps_state_over_triggers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ST, "BUCKET", 64)
    log = D.metrics_log(spark, FOLDER)
    with ST.on_rocksdb(spark):
        got = ST.run_available(ST.throughput(parted(log, tmp_path / "t", 4, "step"), 1, 4))
    assert same(rates(got), rates(L.throughput(log, 1, 4)))


def test_throughput_goes_on_after_a_restart(spark, tmp_path):
    log = D.metrics_log(spark, FOLDER)
    middle = log.approxQuantile("step", [0.5], 0.0)[0]
    out, state, src = (str(tmp_path / n) for n in ("out", "state", "src"))
    for part in (log.where(F.col("step") <= middle), log.where(F.col("step") > middle)):
        part.repartition(3).write.mode("append").parquet(src)
        stream = spark.readStream.schema(log.schema).parquet(src)
        with ST.on_rocksdb(spark):
            got = ST.run_available(ST.throughput(stream, 1, 4), out, state)
    assert same(rates(got), rates(L.throughput(log, 1, 4)))


def test_a_run_of_a_million_rows_in_one_trigger(spark, tmp_path):
    """Rows come in no order; they are sorted in the state store, a bucket at a time."""
    log = spark.range(1, 1_000_001).select(
        F.lit(1).cast("long").alias("run_id"), (F.col("id") * 10).alias("step"),
        F.timestamp_micros(F.col("id") * 1_000_000 + F.col("id") % 7 * 1000).alias("ts"), F.lit(0.5).alias("loss"))
    log.orderBy(F.xxhash64("step")).repartition(4).write.parquet(str(tmp_path / "m"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "m"))
    with ST.on_rocksdb(spark):
        got = ST.run_available(ST.throughput(stream, 1, 4))
    assert same(rates(got), rates(L.throughput(log, 1, 4)))


def test_the_state_of_an_idle_run_expires(spark, tmp_path):
    day = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    rows = [(1, 10, day(0)), (2, 10, day(10)), (3, 10, day(10)), (4, 10, day(10)), (1, 20, day(11)), (2, 20, day(11))]
    for k, row in enumerate(rows):
        spark.createDataFrame([(*row, 1.0)], S.METRICS_LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "idle"))
    stream = spark.readStream.schema(S.METRICS_LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "idle"))
    with ST.on_rocksdb(spark):
        got = {(r.run_id, r.step): r.samples_per_sec for r in ST.run_available(ST.throughput(stream, 1, 1, idle_hours=48)).collect()}
    assert got == {(1, 10): None, (2, 10): None, (3, 10): None, (4, 10): None, (1, 20): None, (2, 20): 10 / 86400}


def test_monitor(spark, tmp_path):
    log = D.metrics_log(spark, FOLDER)
    day = F.date_trunc("day", "window_start")
    got = ST.run_keyed(ST.monitor(parted(log, tmp_path / "m", 3, "step"), late="60 days"), ["window_start"], day)
    want = log.groupBy(F.window("ts", "5 minutes").alias("w")).agg(F.count("*").alias("n"), F.max("step").alias("m"))
    assert same(got.select("window_start", "n", "max_step"), want.select("w.start", "n", "m"))
    closed = ST.run_available(ST.monitor(parted(log, tmp_path / "a", 3, "step")))
    assert 0 < closed.count() < want.count()  # the newest windows wait for the watermark


def test_monitor_goes_on_after_a_restart(spark, tmp_path):
    log = D.metrics_log(spark, FOLDER)
    out, state, src = (str(tmp_path / n) for n in ("out", "state", "src"))
    for k in range(3):
        log.where(F.col("step") % 3 == k).write.mode("append").parquet(src)
        stream = ST.monitor(spark.readStream.schema(log.schema).parquet(src), late="60 days")
        got = ST.run_keyed(stream, ["window_start"], F.date_trunc("day", "window_start"), out, state)
    want = log.groupBy(F.window("ts", "5 minutes").alias("w")).agg(F.count("*").alias("n"), F.max("step").alias("m"))
    assert same(got.select("window_start", "n", "max_step"), want.select("w.start", "n", "m"))


def counted_model(folder):
    def factory():
        def predict(prompts, images):
            for p, i in zip(prompts, images):
                (folder / f"call-{uuid.uuid4()}").touch()
            return [f"<b>{p}{bytes(i or b'').decode()}</b>" for p, i in zip(prompts, images)]
        return predict
    return factory


def test_a_restarted_stream_makes_no_model_call(spark, tmp_path):
    rng = random.Random(4)
    schema = "sample_id long, prompt string, image binary"
    rows = [(i, rng.choice(["p", "q"]), rng.choice([b"1", b"2", b"3", None])) for i in range(60)]
    seen, src = tmp_path / "seen", str(tmp_path / "src")
    seen.mkdir()
    calls = lambda: len(list(seen.glob("call-*")))

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        done = ST.predict_once(stream, counted_model(seen), *(str(tmp_path / n) for n in ("cache", "out", "state")))
        return sorted((r.sample_id, r.pred_html, r.error) for r in done.collect())

    want = lambda rs: [(i, f"<b>{p}{(m or b'').decode()}</b>", None) for i, p, m in rs]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(src)
    assert run() == want(rows) and calls() == len({r[1:] for r in rows})
    assert run() == want(rows) and calls() == len({r[1:] for r in rows})
    more = [(100 + i, *rows[i][1:]) for i in range(20)] + [(200, "new", b"1")]
    spark.createDataFrame(more, schema).coalesce(1).write.mode("append").parquet(src)
    assert run() == want(rows + more) and calls() == len({r[1:] for r in rows}) + 1


def test_late_rows_are_dropped(spark, tmp_path):
    at = lambda minutes: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)
    # a watermark filters late rows from the second trigger after the one that moved it
    rows = [(1, 1, at(0), 1.0), (1, 2, at(60), 1.0), (1, 3, at(70), 1.0), (1, 4, at(1), 5.0), (1, 5, at(120), 1.0)]
    df = spark.createDataFrame(rows, S.METRICS_LOG)
    got = {r.window_start: r.n for r in ST.run_available(ST.monitor(parted(df, tmp_path / "l", 5, "step"))).collect()}
    assert got[at(0)] == 1


def test_dedup(spark, tmp_path):
    at = lambda minutes: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)
    rng = random.Random(1)
    rows = [(i, at(i % 7), rng.choice(["p", "q"]), rng.choice([b"1", b"2", None])) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, prompt string, image binary")
    got = ST.run_available(ST.dedup(parted(df, tmp_path / "d", 3, "id")))
    assert got.count() == df.select("prompt", "image").distinct().count()


def test_averages(spark, tmp_path):
    rows = [(i, "ab"[i % 2], i / 10, None if i % 3 == 0 else i / 20) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, stage string, teds_structure double, teds_full double")
    got = ST.run_keyed(ST.eval_avg(parted(df, tmp_path / "e", 3, "id")), ["stage"], F.lit(0))
    want = df.groupBy("stage").agg(F.avg("teds_structure"), F.avg(F.coalesce("teds_full", F.lit(0.0))), F.count("*"))
    r = lambda d: sorted((x[0], round(x[1], 9), round(x[2], 9), x[3]) for x in d.collect())
    assert r(got) == r(want)


def test_image_folder(spark, tmp_path):
    folder = tmp_path / "imgs"
    folder.mkdir()
    for name in ("a.PNG", "b.jpeg", "c.txt", "d", "e.webp"):
        (folder / name).write_bytes(name.encode())
    (folder / "sub").mkdir()
    (folder / "sub" / "f.png").write_bytes(b"f")
    names = lambda df: sorted(r.path.rsplit("/", 1)[-1] for r in df.collect())
    assert names(IO.scan_images(spark, str(folder))) == ["a.PNG", "b.jpeg", "e.webp"]
    assert names(ST.run_available(IO.scan_images(spark, str(folder), streaming=True))) == ["a.PNG", "b.jpeg", "e.webp"]
    assert IO.scan_images(spark, str(tmp_path / "missing")).count() == 0


def test_throughput_with_late_files(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [(1, 10, at(0), 1.0), (1, 30, at(100), 1.0), (1, 20, at(40), 1.0), (1, 40, at(400), 1.0)]
    for k, row in enumerate(rows):
        spark.createDataFrame([row], S.METRICS_LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "late"))
    stream = spark.readStream.schema(S.METRICS_LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "late"))
    with ST.on_rocksdb(spark):
        got = {r.step: r.samples_per_sec for r in ST.run_available(ST.throughput(stream, 1, 1)).collect()}
    assert got == {10: None, 30: 0.2, 20: None, 40: 10 / 300}
