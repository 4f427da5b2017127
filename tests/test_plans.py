"""Shapes of physical plans that decide whether a job scales."""

import contextlib
import io
import re

from pyspark.sql import functions as F

from gridmill.operators import curate as C, pairing as J, ranking as T, runlog as L, sampling as P, skew as K
from gridmill.plans import flows
from gridmill.sources import derived as D, tables as IO, work

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def stored(spark, tmp_path):
    path = str(tmp_path / "samples")
    IO.write_samples(D.samples(spark, FOLDER), path)
    return path


def test_split_folder_is_pruned_and_columns_too(spark, tmp_path):
    path = stored(spark, tmp_path)
    text = plan(IO.read_samples(spark, path, "validation").select("sample_id"))
    assert re.search(r"PartitionFilters: \[.*split#\d+ = validation", text)
    assert "ReadSchema: struct<sample_id:bigint>" in text
    text = plan(C.not_null_html(IO.read_samples(spark, path)).select("sample_id"))
    assert "IsNotNull(html_table)" in text


def test_cleaning_runs_once_and_without_shuffle(spark, tmp_path):
    text = plan(C.filter_and_clean(IO.read_samples(spark, stored(spark, tmp_path))))
    assert "Exchange" not in text
    assert text.count("```(?:html)?") == 1


def test_topk_is_not_a_sort_and_reads_no_images(spark, tmp_path):
    samples = IO.read_samples(spark, stored(spark, tmp_path))
    text = plan(T.topk_ids(samples, 20))
    assert "TakeOrderedAndProject" in text and "image" not in text
    assert "BroadcastHashJoin" in plan(flows.holdout(samples, 20))


def test_split_shuffles_no_row(spark, tmp_path):
    samples = IO.read_samples(spark, stored(spark, tmp_path))
    main = plan(P.split_exact(samples, 85, 100, 1)).split("===== Subqueries =====")[0]
    assert "Exchange" not in main and "Window" not in main
    assert "Exchange" not in plan(P.sample_n(samples, 10, 1)).split("===== Subqueries =====")[0]


def scans(text):
    return len(re.findall(r"\n\(\d+\) Scan parquet", text))


def test_judging_for_progress_marks_runs_once(spark, tmp_path, monkeypatch):
    staged = []
    monkeypatch.setattr(L, "stage", lambda df, name: staged.append(plan(df)) or work.stage(df, name))
    samples = IO.read_samples(spark, stored(spark, tmp_path))
    text = plan(L.progress_marks(C.with_reject_reason(samples), F.col("reason").isNull(), 1000))
    assert [scans(t) for t in staged] == [1] and "Exchange" not in staged[0]
    assert "```" not in text and "html_table" not in text  # what follows reads two numbers per row


def test_metrics_read_both_sources_once(spark, tmp_path, monkeypatch):
    staged = []
    monkeypatch.setattr(L, "stage", lambda df, name: staged.append(plan(df)) or work.stage(df, name))
    log = D.training_log(spark, FOLDER)
    L.append_metrics(log, D.evaluations(spark, FOLDER), ["avg_full", "n_evaluated"])
    assert [scans(t) for t in staged] == [2]


def test_stored_predictions_pair_without_a_shuffle_of_html(spark):
    truth = flows.stored_by_sample(C.filter_and_clean(D.samples(spark, FOLDER)).select("sample_id", "html_table"), "truth")
    preds = flows.stored_by_sample(D.predictions(spark, FOLDER), "preds")
    paired = J.pair_predictions(truth, preds).hint("merge")
    text = plan(J.pair_predictions(truth.hint("merge"), preds))
    assert "Exchange" not in text and text.count("Bucketed: true") == 2
    assert paired.count() >= truth.count()
    assert "Exchange" not in plan(J.compare_stages(preds, "pre", "post"))


def test_images_are_listed_by_pushed_filters_without_contents(spark, tmp_path):
    for name in ("a.PNG", "b.txt", "c.webp"):
        (tmp_path / name).write_bytes(name.encode())
    found = IO.scan_images(spark, str(tmp_path), since="2020-01-01 00:00:00")
    text = plan(found.select("path", "length"))
    assert re.search(r"PushedFilters: \[.*GreaterThan\(modificationTime", text) and "content" not in text.split("ReadSchema")[1]
    assert sorted(r.path.rsplit("/", 1)[-1] for r in found.collect()) == ["a.PNG", "c.webp"]
    assert IO.scan_images(spark, str(tmp_path), since="2100-01-01 00:00:00").count() == 0


def test_log_windows_are_cut_into_blocks(spark):
    log = D.metrics_log(spark, FOLDER)
    for df in (L.throughput(log, 1, 4), L.ema_smooth(log)):
        text = plan(df)
        assert re.search(r"hashpartitioning\(run_id#\d+L?, _block#\d+L?", text)
    retained = plan(L.retained_checkpoints(log, 3, 5))
    assert "WindowGroupLimit" in retained  # cut to three rows per run before the shuffle


def test_reports_combine_map_side(spark, tmp_path):
    from gridmill.operators import reports as R
    text = plan(R.filter_report(IO.read_samples(spark, stored(spark, tmp_path))))
    assert "partial_count" in text


def test_hot_key_table_is_bounded(spark):
    assert K.HOT_SHARE <= 10_000
    df = spark.range(1000).select((F.col("id") % 10).alias("k"))
    assert len(K.hot_keys(df, "k", min_rows=1)) == 10


def test_staged_tables_can_be_removed(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(work, "work_dir", lambda _: str(tmp_path))
    assert work.stage(spark.range(5).toDF("id"), "x").count() == 5 and any(tmp_path.iterdir())
    work.clear(spark)
    assert not any(p.name.startswith("gridmill") for p in tmp_path.iterdir())
