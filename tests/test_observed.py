"""Jobs that report on themselves, against the reports that read the source for it."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from gridmill import schema as S
from gridmill.operators import curate as C, observed as B, reports as R
from gridmill.sources import derived as D, tables as IO
from gridmill.streaming import streams as ST
from tests.test_streams import parted, same

FOLDER = "/root/testdata/sf0.001"
SPLITS = ["train", "validation"]


@pytest.fixture(scope="module")
def samples(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("samples") / "s")
    IO.write_samples(D.samples(spark, FOLDER), path)
    return IO.read_samples(spark, path)


def test_the_report_of_the_writing_pass(spark, samples, tmp_path):
    metrics = B.write_curated(samples, str(tmp_path / "out"), SPLITS)
    assert same(B.filter_report(spark, metrics, SPLITS), R.filter_report(samples))
    assert same(B.reject_histogram(spark, metrics), R.reject_histogram(samples))
    written = IO.read_samples(spark, str(tmp_path / "out"))
    assert same(written, C.filter_and_clean(samples).select(*written.columns))
    other = B.write_curated(samples, str(tmp_path / "one"), ["train"], require=False)
    rows = {r.split: r.original for r in B.filter_report(spark, other, ["train"]).collect()}
    assert rows == {"train": metrics["original_0"], None: metrics["original_1"]}


def test_one_scan_cleans_writes_and_reports(spark, samples, tmp_path):
    """The plan that was executed, as the listener of executions sees it."""
    seen = []
    plain = type(samples.write).parquet

    def spy(self, path, *args, **kwargs):
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            self._df.explain("formatted")
        seen.append(out.getvalue())
        return plain(self, path, *args, **kwargs)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(type(samples.write), "parquet", spy)
        B.write_curated(samples, str(tmp_path / "out"), SPLITS)
    text, = seen
    assert text.count("Scan parquet") == 2 and "(1) Scan parquet" in text  # once in the tree, once in its details
    assert "CollectMetrics" in text and "Exchange" not in text


def test_an_empty_split_ends_the_job(spark, samples, tmp_path):
    with pytest.raises(ValueError, match="validation is empty"):
        B.write_curated(samples.where("split = 'train' OR html_table IS NULL"), str(tmp_path / "out"), SPLITS)
    with pytest.raises(ValueError, match="train, validation is empty"):
        B.write_curated(spark.createDataFrame([], S.SAMPLES), str(tmp_path / "none"), SPLITS)


def test_triggers_of_a_stream_add_up(spark, samples, tmp_path):
    marks = []
    stream = parted(samples.select("sample_id", "split", "html_table", "image"), tmp_path / "s", 4, "sample_id")
    done, progress = ST.run_watched(B.watched(stream, SPLITS), B.Progress(every=100, report=lambda *m: marks.append(m)),
                                    str(tmp_path / "out"), str(tmp_path / "state"))
    assert same(done, C.filter_and_clean(samples).select(*done.columns))
    assert len(progress.batches) == 4 and same(B.filter_report(spark, progress.metrics(), SPLITS), R.filter_report(samples))
    assert marks == progress.marks and len(marks) == 4 and marks[-1] == (samples.count(), done.count())
    assert all(a < b for a, b in zip(marks, marks[1:]))
    # nothing new: a restart from the same checkpoint counts nothing again
    again, progress = ST.run_watched(B.watched(spark.readStream.schema(samples.select("sample_id", "split", "html_table", "image").schema)
                                               .parquet(str(tmp_path / "s")), SPLITS), B.Progress(), str(tmp_path / "out"), str(tmp_path / "state"))
    assert progress.total("original") == 0 and again.count() == done.count()
