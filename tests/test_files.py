"""Sinks that write files and merge tables, against what is read back."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gridmill import schema as S
from gridmill.operators import predict as P, ranking as T, runlog as L
from gridmill.plans import stubs
from gridmill.sources import derived as D, keyed, tables as IO
from gridmill.sources.files import read_files, write_files
from tests.test_streams import parted, same

FOLDER = "/root/testdata/sf0.001"


def files(spark, rows):
    return spark.createDataFrame(rows, "name string, content binary")


def tree(folder):
    return sorted(str(p.relative_to(folder)) for p in Path(folder).rglob("*") if p.is_file())


def test_files_round_trip(spark, tmp_path):
    rows = [("a.png", b"\x00\xff"), ("pre/b 1.html", "<p>é漢</p>".encode()), ("pre/c.html", b""), ("d", None), ("é.txt", b"x" * 2_000_000)]
    out = str(tmp_path / "out")
    write_files(files(spark, rows).repartition(3), out)
    assert tree(out) == ["_SUCCESS", "a.png", "d", "pre/b 1.html", "pre/c.html", "é.txt"]
    assert {r.name: bytes(r.content) for r in read_files(spark, out).collect()} == {n: c or b"" for n, c in rows}
    assert [r.name for r in read_files(spark, out, "*.png").collect()] == ["a.png"]
    write_files(files(spark, [("new", b"1")]), out, "append")
    assert "new" in tree(out) and len(tree(out)) == 7
    write_files(files(spark, [("only", b"1")]), out)
    assert tree(out) == ["_SUCCESS", "only"]
    write_files(files(spark, []), out)
    assert tree(out) == ["_SUCCESS"]


@pytest.mark.parametrize("before", [True, False])
def test_a_failing_task_leaves_nothing(spark, tmp_path, before):
    out = str(tmp_path / "out")
    if before:
        write_files(files(spark, [("old", b"1")]), out)
    rows = spark.range(40).repartition(8).select(
        F.concat(F.lit("f"), F.col("id")).alias("name"),
        F.when(F.col("id") == 33, F.raise_error(F.lit("no such row"))).otherwise(F.lit("x")).cast("binary").alias("content"))
    with pytest.raises(Exception, match="no such row"):
        write_files(rows, out)
    assert tree(out) == (["_SUCCESS", "old"] if before else [])


def test_names_are_checked(spark, tmp_path):
    out = str(tmp_path / "out")
    write_files(files(spark, [("old", b"1")]), out)
    for rows, mode, what in (([("a", b"1"), ("a", b"2")], "overwrite", "two rows"), ([("old", b"2")], "append", "two rows"),
                             ([("../a", b"1")], "overwrite", "below the output folder")):
        with pytest.raises(Exception, match=what):
            write_files(files(spark, rows), out, mode)
        assert tree(out) == ["_SUCCESS", "old"]


def test_exports_are_one_file_per_row(spark, tmp_path):
    rows = [(i, "train", f"<table>{'x' * i}</table>", f"img{i}".encode()) for i in range(30)]
    df = spark.createDataFrame(rows, S.SAMPLES)
    out = tmp_path / "holdout"
    manifest = IO.export_samples(df, 3, str(out)).orderBy("rank").collect()
    assert [(r.rank, r.sample_id, r.image_file, r.html_file, r.html_length) for r in manifest] == [
        (1, 29, "sample_01.png", "sample_01.html", 44), (2, 28, "sample_02.png", "sample_02.html", 43), (3, 27, "sample_03.png", "sample_03.html", 42)]
    assert (out / "sample_02.png").read_bytes() == b"img28" and (out / "sample_02.html").read_text() == rows[28][2]
    preds = P.batch_predict(df, stubs.stub_model, "pre")
    IO.export_predictions(IO.prediction_files(preds, T.topk_ids(df, 3), 3), str(tmp_path / "preds"))
    assert tree(tmp_path / "preds") == ["_SUCCESS", "pre/sample_02_pred.html", "pre/sample_03_pred.html"]  # 29 failed
    back = {(r.stage, r.rank): r.pred_html for r in IO.read_predictions(spark, str(tmp_path / "preds")).collect()}
    assert back == {("pre", 2): "<table><tr><td>img28</td></tr></table>", ("pre", 3): "<table><tr><td>img27</td></tr></table>"}
    IO.export_ocr(P.ocr_job(df, stubs.stub_model, 4), str(tmp_path / "ocr"))
    assert tree(tmp_path / "ocr" / "html_results") == ["_SUCCESS"] + [
        f"row_{i:02}_{s}.html" for i in (2, 3, 4) for s in ("ground_truth", "ocr_result")]
    assert len(list((tmp_path / "ocr" / "ocr_results_summary").glob("*.json"))) == 1
    summary = IO.read_ocr_summary(spark, str(tmp_path / "ocr")).orderBy("row_index").collect()
    assert [(r.status, r.error_message) for r in summary][:2] == [("error", "Error: no table in img29"), ("success", None)]


def test_merging_again_changes_nothing(spark, tmp_path):
    path, part = str(tmp_path / "t"), F.col("k") % 3
    frame = lambda rows, schema="k long, v string": spark.createDataFrame(rows, schema)
    state = lambda: sorted(map(tuple, keyed.read(spark, path).collect()), key=repr)
    first, second = frame([(1, "a"), (2, "b"), (3, "c"), (None, "n")]), frame([(2, "B"), (4, "d")])
    keyed.merge(first, 0, path, ["k"], part)
    keyed.merge(second, 1, path, ["k"], part)
    want = sorted([(1, "a"), (2, "B"), (3, "c"), (4, "d"), (None, "n")], key=repr)
    assert state() == want
    for rows, batch in ((second, 1), (first, 0)):  # a trigger that is run again, and one that comes late
        keyed.merge(rows, batch, path, ["k"], part)
        assert state() == want
    keyed.merge(frame([(3, 7), (9, 8)], "k long, w long"), 2, path, ["k"], part, insert=False)
    assert {r.k: (r.v, r.w) for r in keyed.read(spark, path).collect()} == {1: ("a", None), 2: ("B", None), 3: ("c", 7), 4: ("d", None), None: ("n", None)}


def test_partition_names_are_kept_as_they_are(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [("007", 1), ("7", 2), ("2024-01-01", 3), ("", 4), ("a/b=c", 5), (None, 6)]
    for batch in (0, 1):
        keyed.merge(spark.createDataFrame([(k, v + 10 * batch) for k, v in rows], "k string, v int"), batch, path, ["k"], F.col("k"))
    assert {r.k: r.v for r in keyed.read(spark, path).collect()} == {k: v + 10 for k, v in rows}


def test_metrics_are_merged_into_the_stored_log(spark, tmp_path):
    log, evals, metrics = D.training_log(spark, FOLDER), D.evaluations(spark, FOLDER), ["avg_full", "n_evaluated"]
    want = L.append_metrics(log, evals, metrics).select("run_id", "step", "loss", *metrics)
    path, state = str(tmp_path / "log"), str(tmp_path / "state")
    IO.append_log(log, 0, path)
    IO.append_log(log, 0, path)
    stream = parted(evals, tmp_path / "evals", 3, "n_evaluated")  # steps out of order over the triggers
    IO.stream_metrics(stream, path, metrics, state)
    got = lambda: keyed.read(spark, path).select(*want.columns)
    assert same(got(), want)
    IO.stream_metrics(stream, path, metrics, state)  # nothing new
    IO.store_metrics(spark.read.parquet(str(tmp_path / "evals")).limit(20), 1, path, metrics)  # and a replay
    assert same(got(), want)
