"""Log operators with runs cut into many small blocks, against plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gridmill import schema as S
from gridmill.operators import ordered as O, runlog as L
from gridmill.sources import derived as D
from tests.test_sampling import samples

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for run, n in ((1, 400), (2, 3), (3, 150)):  # run 1 is the long one
        for step in sorted(rng.sample(range(1, 3000), n)):
            out.append((run, step, START + dt.timedelta(seconds=step * 2 + rng.random()), rng.random() * 10))
    return out


@pytest.fixture(scope="module")
def log(spark, rows):
    return spark.createDataFrame(rows, S.METRICS_LOG).repartition(5).cache()


def runs(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("block", [16, 700, 1 << 20])
def test_index(log, rows, block):
    got = {(r.run_id, r.step): r.pos for r in O.with_index(log, ["run_id"], "step", block).collect()}
    assert got == {(k, r[1]): i for k, rs in runs(rows).items() for i, r in enumerate(rs)}


@pytest.mark.parametrize("block", [16, 700, 1 << 20])
def test_throughput_and_minutes(log, rows, block):
    want, minutes = {}, {}
    for run, rs in runs(rows).items():
        last = None
        for _, step, ts, _ in rs:
            if step % 10 == 0:
                want[run, step] = None if last is None else (step - last[0]) * 8 / (ts - last[1]).total_seconds()
                minutes[run, step] = (ts - rs[0][2]).total_seconds() / 60
                last = step, ts
    got = {(r.run_id, r.step): r.samples_per_sec for r in L.throughput(log, 2, 4, block=block).collect()}
    assert got == {k: v if v is None else pytest.approx(v) for k, v in want.items()}
    got = {(r.run_id, r.step): r.minutes for r in L.elapsed_minutes(log, block=block).collect()}
    assert got == {k: pytest.approx(v) for k, v in minutes.items()}


@pytest.mark.parametrize("block, index_block, weight", [(None, 1 << 20, 0.9), (None, 100, 0.1), (100, 64, 0.5), (300, 500, 0.9)])
def test_ema(log, rows, block, index_block, weight):
    want = {}
    for run, rs in runs(rows).items():
        num = den = 0.0
        for _, step, _, loss in rs:
            num, den = num * weight + loss, den * weight + 1
            want[run, step] = num / den
    got = {(r.run_id, r.step): r.smoothed for r in L.ema_smooth(log, weight, block=block, index_block=index_block).collect()}
    assert got == {k: pytest.approx(v, rel=1e-9) for k, v in want.items()}


def test_ema_known_values(spark):
    log = spark.createDataFrame([(1, i, START, float(i)) for i in (1, 2, 3)], S.METRICS_LOG)
    assert L.ema_smooth(log).orderBy("step").collect()[-1].smoothed == pytest.approx(2.070110701)


@pytest.mark.parametrize("block", [32, 1 << 20])
def test_append_metrics(spark, log, rows, block):
    rng = random.Random(5)
    evals = [(run, step, rng.random(), 3) for run in (1, 2, 3, 9) for step in rng.sample(range(0, 3200), 60)]
    df = spark.createDataFrame(evals, "run_id long, step long, avg_full double, n_evaluated int")
    want = {(r[0], r[1]): None for r in rows}
    for run, step, value, _ in sorted(evals, key=lambda e: e[1]):
        before = [r[1] for r in rows if r[0] == run and r[1] <= step]
        if before:
            want[run, before[-1]] = value
    got = {(r.run_id, r.step): r.avg_full for r in L.append_metrics(log, df, ["avg_full", "n_evaluated"], block).collect()}
    assert got == want


def test_checkpoints(log, rows):
    best = {r.run_id: r.step for r in L.best_checkpoint(log).collect()}
    assert best == {k: min(rs, key=lambda r: (r[3], r[1]))[1] for k, rs in runs(rows).items()}
    kept = {(r.run_id, r.step): r.is_best for r in L.retained_checkpoints(log, 2, 5).collect()}
    want = {}
    for run, rs in runs(rows).items():
        saved = [r for r in rs if r[1] % 5 == 0]
        if saved:
            top = min(saved, key=lambda r: (r[3], r[1]))[1]
            want.update({(run, s): s == top for s in [r[1] for r in saved[-2:]] + [top]})
    assert kept == want


def test_cadence(log, rows):
    assert {(r.run_id, r.step) for r in L.cadence(log, 10).collect()} == {(r[0], r[1]) for r in rows if r[1] % 10 == 0}
    gated = L.gated_cadence(log, 10).collect()
    assert all((r.action == "evaluate") == (r.step >= 50) for r in gated)


@pytest.mark.parametrize("block", [8, 1 << 20])
def test_progress(spark, block):
    got = L.progress_marks(samples(spark, 105), F.col("sample_id") % 3 == 0, 20, block).orderBy("processed").collect()
    assert [(r.processed, r.valid) for r in got] == [(n, (n + 2) // 3) for n in (20, 40, 60, 80, 100)]


def test_progress_over_sparse_ids(spark):
    """Totals of earlier blocks are added up by groups of blocks, so ids far apart do not meet in one window."""
    rng = random.Random(5)
    ids = sorted({rng.randrange(-1000, 1 << 62) for _ in range(30)} | set(range(40)))
    df = spark.createDataFrame([(i, rng.random() < .5) for i in ids], "sample_id long, ok boolean")
    blocked = O.with_block(df, "sample_id", 2)
    for size in (3, O.BLOCK):
        rows = O.with_totals_before(blocked, [F.count(F.lit(1)).alias("n")], ["n"], size=size).collect()
        assert len(rows) == len(ids) and all(r.n_before == sum(i // 2 < r.sample_id // 2 for i in ids) for r in rows if r.sample_id >= 0)
    marks = L.progress_marks(df, F.col("ok"), 10, 2)
    ok = dict(df.collect())
    assert {(r.processed, r.valid) for r in marks.collect()} == {(n, sum(ok[i] for i in ids[:n])) for n in range(10, len(ids) + 1, 10)}
    assert "_group" in marks._jdf.queryExecution().executedPlan().toString()


def test_opening_turns_are_those_with_the_lowest_numbers(spark, tmp_path):
    turns = [(1, t, "user", f"t{t}") for t in (5, 3, 0, 7)] + [(2, t, "user", f"t{t}") for t in (9, 4, 6)] + [(3, 2, "user", "t2")]
    turns += [(4, None, "user", "x"), (5, None, "user", "x"), (5, 1, "user", "t1"), (5, 1, "user", "t1"), (5, 8, None, None)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: [m.content for m in r.messages] for r in D.first_turns(spark, str(tmp_path)).collect()}
    assert got == {1: ["t0", "t3"], 2: ["t4", "t6"], 3: ["t2"], 4: [], 5: ["t1", None]}


@pytest.mark.parametrize("weight", [0, 1])
def test_smoothing_at_the_ends_of_the_weight(spark, weight):
    rows = [(r, s, float(s % 7)) for r in (1, 2) for s in range(1, 40)] + [(1, 99, None)]
    log = spark.createDataFrame(rows, "run_id long, step long, loss double")
    got = {(r.run_id, r.step): r.smoothed for r in L.ema_smooth(log, weight, index_block=10).collect()}
    for run, step, loss in rows[:-1]:
        seen = [float(s % 7) for s in range(1, step + 1)]
        assert abs(got[run, step] - (loss if weight == 0 else sum(seen) / len(seen))) < 1e-9
    assert len(got) == len(rows) - 1
