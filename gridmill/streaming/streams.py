"""Streams. Each takes a streaming DataFrame and returns one; the run functions drive it."""

import contextlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from gridmill import schema as S
from gridmill.operators import curate as C
from gridmill.operators.observed import Progress, watched
from gridmill.operators.pairing import content_key
from gridmill.operators.predict import dedup_predict
from gridmill.sources import keyed
from gridmill.sources.work import fresh_path, stage


def clean_filter(samples: DataFrame) -> DataFrame:
    """Stateless: the batch operator as it is."""
    return C.filter_and_clean(samples)


def monitor(log: DataFrame, every: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Snapshot of the log per tumbling window.

    Rows later than the watermark are dropped and closed windows leave the state. In update mode a trigger gives the windows
    that it changed, in append mode each window once, when it is closed.
    """
    return log.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("loss").alias("sum_loss"), F.max("step").alias("max_step"),
    ).select(F.col("w.start").alias("window_start"), "n", "sum_loss", "max_step")


BUCKET = 1 << 16  # steps of a run that are sorted at once


class _Throughput(StatefulProcessor):
    """Keeps a run's highest logged step; rows of a trigger wait in a map state, in buckets of steps."""

    def __init__(self, per_step: int, idle_ms: int | None):
        self.per_step, self.idle_ms = per_step, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "step long, us long")
        self.waiting = handle.getMapState("waiting", "bucket long, n long", "rows binary")

    def _rates(self, rows: np.ndarray, last: tuple | None) -> tuple[np.ndarray, tuple | None]:
        """Rates of sorted (step, us) rows, and the new last row."""
        rate = np.full(len(rows), np.nan)
        new = np.flatnonzero(rows[:, 0] > last[0]) if last else np.arange(len(rows))
        if len(new):
            before = np.vstack([np.array([last]) if last else rows[new[:1]], rows[new[:-1]]])
            moved, seconds = rows[new, 0] - before[:, 0], (rows[new, 1] - before[:, 1]) / 1e6
            known = (moved > 0) & (seconds != 0)
            rate[new[known]] = moved[known] * self.per_step / seconds[known]
            last = tuple(int(x) for x in rows[new[-1]])
        return rate, last

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = Counter()
        for frame in rows:
            values = frame[["step", "us"]].to_numpy("int64")
            of = values[:, 0] // BUCKET
            for bucket in np.unique(of).tolist():
                self.waiting.updateValue((bucket, parts[bucket]), (values[of == bucket].tobytes(),))
                parts[bucket] += 1
        last = tuple(self.last.get()) if self.last.exists() else None
        for bucket in sorted(parts):
            found = []
            for n in range(parts[bucket]):
                found.append(np.frombuffer(self.waiting.getValue((bucket, n))[0], np.int64).reshape(-1, 2))
                self.waiting.removeKey((bucket, n))
            values = np.concatenate(found)
            values = values[np.lexsort((values[:, 1], values[:, 0]))]
            rate, last = self._rates(values, last)
            yield pd.DataFrame({"run_id": key[0], "step": values[:, 0], "samples_per_sec": rate})
        if last is not None:
            self.last.update(last)
            if self.idle_ms is not None:
                for timer in self.handle.listTimers():
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(last[1] // 1000 + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def throughput(log: DataFrame, batch: int, accum: int, every: int = 10, idle_hours: int | None = None) -> DataFrame:
    """Samples per second between successive logs of a run, with the log of the highest step kept as state.

    A step that arrives after a higher one of an earlier trigger has no rate and changes no later one. A trigger's rows of a run
    are sorted bucket by bucket of steps in the state store (RocksDB, see `on_rocksdb`), so a task holds one bucket of them.

    With `idle_hours`, a run whose last log is that far behind the newest of all leaves the state: its next log is a first one
    again; and rows that come as late as that are dropped.
    """
    idle_ms = None if idle_hours is None else idle_hours * 3_600_000
    logged = log.where(F.col("step") % every == 0).select("run_id", "step", F.unix_micros("ts").alias("us"), "ts")
    logged = logged.drop("ts") if idle_ms is None else logged.withWatermark("ts", f"{idle_hours} hours")
    return logged.groupBy("run_id").transformWithStateInPandas(
        _Throughput(batch * accum, idle_ms), "run_id long, step long, samples_per_sec double", "append",
        "None" if idle_ms is None else "EventTime")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def on_rocksdb(spark: SparkSession):
    """Streams that start inside keep their state on the executors' disks."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def dedup(requests: DataFrame, late: str = "10 minutes") -> DataFrame:
    """First request per (prompt, image) within the watermark; the state expires with it."""
    keyed = requests.withColumn("key", content_key(F.col("prompt"), F.col("image")))
    return keyed.withWatermark("ts", late).dropDuplicatesWithinWatermark(["key"])


def eval_avg(scored: DataFrame) -> DataFrame:
    """Running averages per stage, failures counted as zero."""
    zero = lambda c: F.avg(F.coalesce(F.col(c), F.lit(0.0)))
    return scored.groupBy("stage").agg(zero("teds_structure").alias("avg_structure"), zero("teds_full").alias("avg_full"),
                                       F.count(F.lit(1)).alias("n_evaluated"))


def _writer(stream: DataFrame, mode: str, state: str):
    return stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)


def run_available(stream: DataFrame, out: str | None = None, state: str | None = None, name: str = "stream") -> DataFrame:
    """Process what is there and return the rows written so far, by the exactly-once file sink.

    `out` and `state` are the caller's: a later call with the same ones goes on where the last one ended. Without them the
    result is in the work folder and cannot be continued.
    """
    spark = stream.sparkSession
    out, state = out or fresh_path(spark, name), state or fresh_path(spark, f"{name}-state")
    _writer(stream, "append", state).format("parquet").option("path", out).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_watched(stream: DataFrame, progress: Progress, out: str | None = None, state: str | None = None) -> tuple[DataFrame, Progress]:
    """`run_available` of a watched stream, with its progress when the last trigger has reported."""
    spark = stream.sparkSession
    spark.streams.addListener(progress)
    try:
        done = run_available(stream, out, state, "watched")
        progress.ended.wait(60)
    finally:
        spark.streams.removeListener(progress)
    return done, progress


def run_keyed(stream: DataFrame, keys: list[str], part: Column, out: str | None = None, state: str | None = None,
              name: str = "stream") -> DataFrame:
    """Process what is there and return the table that the changed rows of every trigger are merged into by key.

    For aggregates in update mode: a trigger hands over the groups it changed, and groups behind the watermark leave the
    state. The table is partitioned by `part`; a trigger that is run again changes nothing.
    """
    spark = stream.sparkSession
    out, state = out or fresh_path(spark, name), state or fresh_path(spark, f"{name}-state")
    _writer(stream, "update", state).foreachBatch(lambda rows, batch: keyed.merge(rows, batch, out, keys, part)).start().awaitTermination()
    return keyed.read(spark, out, stream.schema)


def predict_once(requests: DataFrame, factory: Callable, cache: str, out: str, state: str, prompt: str = "prompt") -> DataFrame:
    """Answer every request of a stream, calling the model once per distinct (prompt, image), and return all answers so far.

    Requests have an id (`sample_id`), a prompt and an image. Answers are cached by content in a table, so a key that comes again, in a
    later trigger or after a restart, makes no call; a trigger that is run again replaces its own answers. `dedup` before this
    saves the copies within a watermark.
    """
    spark = requests.sparkSession

    def answer(rows: DataFrame, batch: int) -> None:
        rows = stage(rows, "requests")  # several passes follow; state before this is run through once
        made = dedup_predict(rows, factory, "stream", F.col(prompt), cache=cache)
        made.withColumn("_batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "_batch").parquet(out)

    _writer(requests, "append", state).foreachBatch(answer).start().awaitTermination()
    return spark.read.schema(T.StructType([*S.PREDICTIONS, T.StructField("_batch", T.LongType())])).parquet(out).drop("_batch")
