"""Reports that a job writes about itself while it runs.

The counts are observed metrics: aggregates that Spark's tasks keep while rows pass by on their way to the sink, so a job that
cleans and writes reads its source once, report included. A batch job hands them over when it ends, a stream with
every trigger. They count rows that pass, so they belong right before the write: no shuffle may follow that could run a
lost task's rows again.
"""

import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener

from gridmill.operators import curate as C

# The codes of the validation rules, in their order.
REASONS = ("too_short_raw", "no_table", "unbalanced", "length_out_of_range", "no_image")


def curation_metrics(splits: list[str]) -> list[Column]:
    """Counts of judged rows: in all and kept, per expected split and of all others, and per reason."""
    valid = F.col("reason").isNull()
    found = [F.count(F.lit(1)).alias("original"), F.count_if(valid).alias("kept")]
    for i, split in enumerate(splits):
        here = F.col("split").eqNullSafe(F.lit(split))
        found += [F.count_if(here).alias(f"original_{i}"), F.count_if(here & valid).alias(f"kept_{i}")]
    return found + [F.count_if(F.col("reason").eqNullSafe(F.lit(r))).alias(f"reason_{r}") for r in REASONS]


def _kept(judged: DataFrame, columns: list[str]) -> DataFrame:
    kept = judged.where(F.col("reason").isNull())
    return kept.select(*[F.col("cleaned").alias(c) if c == "html_table" else F.col(c) for c in columns])


def write_curated(samples: DataFrame, out: str, splits: list[str], require: bool = True) -> dict[str, int]:
    """Clean and validate samples, write the valid ones with one folder per split, and return the metrics of that pass.

    With `require` a split without valid rows ends the job with an error: what was written stays, for a look at it.
    """
    watch = Observation()
    judged = C.with_reject_reason(samples).observe(watch, *curation_metrics(splits))
    _kept(judged, samples.columns).write.mode("overwrite").partitionBy("split").parquet(out)
    metrics = watch.get
    empty = [s for i, s in enumerate(splits) if not metrics[f"kept_{i}"]]
    if require and empty:
        raise ValueError(f"{', '.join(empty)} is empty after filtering")
    return metrics


def filter_report(spark: SparkSession, metrics: dict[str, int], splits: list[str]) -> DataFrame:
    """The rows that `reports.filter_report` has, from metrics; splits that were not expected share the split null."""
    rows = [(s, metrics[f"original_{i}"], metrics[f"kept_{i}"]) for i, s in enumerate(splits)]
    rows.append((None, metrics["original"] - sum(r[1] for r in rows), metrics["kept"] - sum(r[2] for r in rows)))
    rows = [r for r in rows if r[1]]
    df = spark.createDataFrame(rows, "split string, original long, kept long")
    return df.select("split", "original", "kept", (F.col("original") - F.col("kept")).alias("removed"),
                     F.round(F.col("kept") / F.col("original") * 100, 2).alias("kept_pct"))


def reject_histogram(spark: SparkSession, metrics: dict[str, int]) -> DataFrame:
    rows = [(r, metrics[f"reason_{r}"]) for r in REASONS if metrics[f"reason_{r}"]]
    return spark.createDataFrame(rows, "reason string, n long")


# --- streams ----------------------------------------------------------------------------------------

METRICS = "curation"


def watched(stream: DataFrame, splits: list[str]) -> DataFrame:
    """Clean and validate a stream of samples; every trigger reports its curation metrics."""
    judged = C.with_reject_reason(stream).observe(METRICS, *curation_metrics(splits))
    return _kept(judged, stream.columns)


class Progress(StreamingQueryListener):
    """Adds up the curation metrics of a stream's triggers and tells how far it has come.

    `every` says after how many processed rows `report(processed, valid)` is called, at the end of the trigger that
    passes such a mark. A trigger that is run again after a failure is counted once, by its batch id.
    """

    def __init__(self, every: int = 1000, report: Callable[[int, int], None] | None = None):
        self.every, self.report = every, report
        self.batches: dict[int, dict[str, int]] = {}
        self.marks: list[tuple[int, int]] = []
        self.ended = threading.Event()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(METRICS)
        if row is None or event.progress.batchId in self.batches:
            return
        before = self.total("original")
        self.batches[event.progress.batchId] = row.asDict()
        if before // self.every < self.total("original") // self.every:
            self.marks.append((self.total("original"), self.total("kept")))
            if self.report:
                self.report(*self.marks[-1])

    def onQueryTerminated(self, event) -> None:
        self.ended.set()

    def total(self, name: str) -> int:
        return sum(b[name] or 0 for b in self.batches.values())

    def metrics(self) -> dict[str, int]:
        names = next(iter(self.batches.values()), {})
        return {n: self.total(n) for n in names}
