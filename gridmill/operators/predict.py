"""Batch prediction with a user-supplied model, and the jobs built on it.

A predictor is given as a factory without arguments: it is called at the start of a task and returns a function
(prompts, images) -> texts. A text may be an exception: the error of that row alone. When a whole batch raises, its rows are
retried one by one.

A model is dear to load, so Python workers that Spark reuses (its default) keep it from task to task, and `workers` bounds the
tasks of a job, however many partitions its input has. Without a bound `batch_predict` takes its input as Spark cuts it, so that
what a task reads does not grow with the table. On clusters with stage-level scheduling a resource profile gives those tasks
executors of their own.
"""

import pickle
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark import cloudpickle
from pyspark.resource import ResourceProfile
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T_

from gridmill.functions import html as H
from gridmill.operators import curate as C, ranking as T
from gridmill.operators.pairing import content_key
from gridmill.operators.skew import HOT_ROWS, counted_hot_keys, once_per_task, salted_join
from gridmill.sources.work import keep as materialize, stage as store

Predictor = Callable[[list[str], list[bytes]], list[str]]


def _answers(predict: Predictor, prompts: list, images: list) -> list:
    """One text or exception per row; a batch that fails as a whole is retried row by row."""
    try:
        texts = predict(prompts, images)
        if len(texts) == len(prompts):
            return list(texts)
        texts = ValueError("predictor returned another number of texts")
    except Exception as e:  # rows are reported, the job goes on
        texts = e
    if len(prompts) == 1:
        return [texts]
    return [a for p, i in zip(prompts, images) for a in _answers(predict, [p], [i])]


@lru_cache(maxsize=1)
def loaded(pickled: bytes) -> Predictor:
    """The predictor of a pickled factory; a Python worker that Spark reuses keeps it."""
    return pickle.loads(pickled)()


def _runner(factory: Callable[[], Predictor], batch: int, budget: int, keep: list[str]):
    pickled = cloudpickle.dumps(factory)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = None
        for frame in frames:
            predict = predict or loaded(pickled)  # not for an empty partition
            prompts, images = frame["prompt"].tolist(), frame["image"].tolist()
            found = [a for i, j in batches(prompts, images, batch, budget) for a in _answers(predict, prompts[i:j], images[i:j])]
            failed = [isinstance(a, Exception) for a in found]
            yield frame[keep].assign(text=[None if bad else a for a, bad in zip(found, failed)],
                                     error=[str(a) if bad else None for a, bad in zip(found, failed)])
    return run


def batches(prompts: list, images: list, most: int, budget: int) -> Iterator[tuple[int, int]]:
    """Ranges of at most `most` rows whose prompts and images have at most `budget` bytes; a larger row is alone."""
    start = size = 0
    for at, (prompt, image) in enumerate(zip(prompts, images)):
        own = len(prompt or "") + len(image or b"")
        if at > start and (at - start == most or size + own > budget):
            yield start, at
            start, size = at, 0
        size += own
    if start < len(prompts):
        yield start, len(prompts)


def slots(df: DataFrame) -> int:
    """Tasks that run at the same time."""
    return df.sparkSession.sparkContext.defaultParallelism


def run_predictor(df: DataFrame, keep: list[str], factory: Callable[[], Predictor], batch: int = 8, budget: int = 64 << 20,
                  workers: int | None = None, spread: bool = False, profile: ResourceProfile | None = None) -> DataFrame:
    """Columns `keep` plus (text, error) for every row with a prompt and an image.

    At most `workers` tasks load the model once each (default: one task per partition, and a load per Python worker where Spark
    reuses them). Rows stay where they are and partitions are put together; with `spread` they are dealt out first, to as many
    tasks as run at once by default, which a source with few splits or a shuffle merged by bytes calls for: prediction time
    has nothing to do with input bytes. A batch has at most `batch` rows and `budget` bytes of prompts and images.
    """
    rows = df.select(*keep, "prompt", "image")
    if spread:
        rows = rows.repartition(workers or slots(df))
    elif workers:
        rows = rows.coalesce(workers)
    schema = df.select(*keep).schema.add("text", "string").add("error", "string")
    return rows.mapInPandas(_runner(factory, batch, budget, keep), schema, profile=profile)


def _finished(raw: DataFrame, stage: str, on_error: str, clean: str) -> DataFrame:
    text = {"full": H.clean_html, "strip": H.strip, "none": lambda c: c}[clean](F.col("text"))
    failed = {"report": F.lit(None).cast("string"), "empty": F.lit(""),
              "prefix": F.concat(F.lit("Error: "), F.col("error"))}[on_error]
    pred = F.when(F.col("error").isNull(), text).otherwise(failed)
    return raw.withColumn("stage", F.lit(stage)).withColumn("pred_html", pred).drop("text")


def batch_predict(df: DataFrame, factory: Callable[[], Predictor], stage: str = "pre", prompt: Column | None = None,
                  on_error: str = "report", clean: str = "full", batch: int = 8, workers: int | None = None, spread: bool = False,
                  profile: ResourceProfile | None = None) -> DataFrame:
    """(sample_id, stage, pred_html, error); a failing row gives null, '' or 'Error: ...'.

    The answers are checkpointed: a model call is too dear, and seldom repeatable enough, to be
    run again by every branch that reads them.
    """
    rows = df.select("sample_id", "image", (F.lit("") if prompt is None else prompt).alias("prompt"))
    raw = materialize(run_predictor(rows, ["sample_id"], factory, batch, workers=workers, spread=spread, profile=profile))
    return _finished(raw, stage, on_error, clean).select("sample_id", "stage", "pred_html", "error")


def _keyed(df: DataFrame, prompt: Column | None) -> DataFrame:
    rows = df.select("sample_id", "image", (F.lit("") if prompt is None else prompt).alias("prompt"))
    return rows.withColumn("_key", content_key(F.col("prompt"), F.col("image")))


KNOWN_ROWS = 100_000  # cached keys, 64 bytes each, that are broadcast


def _one_per_key(keyed: DataFrame, known: DataFrame | None, workers: int) -> DataFrame:
    """(_key, prompt, image): one row of each key that is not known, in `workers` partitions.

    A key has many copies, so a partition first drops those it has seen, and one row per task and key crosses the shuffle
    at most. A small cache filters rows before that, a large one where they arrive: images are shuffled once either way.
    """
    deal = lambda df: df.repartition(workers, "_key")
    local = keyed.select("_key", "prompt", "image")
    if known is None:
        dealt = deal(once_per_task(local, "_key"))
    elif known.count() <= KNOWN_ROWS:
        dealt = deal(once_per_task(local.join(F.broadcast(known.select("_key")), "_key", "left_anti"), "_key"))
    else:
        dealt = deal(once_per_task(local, "_key")).join(deal(known.select("_key")), "_key", "left_anti")
    return dealt.dropDuplicates(["_key"])


def dedup_predict(df: DataFrame, factory: Callable[[], Predictor], stage: str = "pre", prompt: Column | None = None,
                  on_error: str = "report", clean: str = "full", batch: int = 8, min_hot: int = HOT_ROWS,
                  workers: int | None = None, cache: str | None = None, profile: ResourceProfile | None = None) -> DataFrame:
    """`batch_predict`, generating once per distinct (prompt, image).

    Keys are counted without the images and stored; images of equal content are dropped in the task that reads them, so a copy
    does not cross the shuffle; the answers go back by a join that spreads a key with many copies. Ids may repeat or be
    null: every row is kept once.

    `cache` names a table of answers by key, one per model and prompt template: known keys are not predicted again, new answers are
    appended. Errors are not kept, so a failed key is tried again.
    """
    workers = workers or slots(df)
    keyed = _keyed(df, prompt)
    rows = store(keyed.select("sample_id", "_key"), "keys")
    distinct = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("n"))
    known = cached_answers(df.sparkSession, cache)
    new = materialize(run_predictor(_one_per_key(keyed, known, workers), ["_key"], factory, batch, workers=workers, profile=profile))
    if cache is not None:
        new.where("error IS NULL").select("_key", "text").write.mode("append").parquet(cache)
    raw = new if known is None else new.unionByName(
        known.join(distinct.select("_key"), "_key", "left_semi").withColumn("error", F.lit(None).cast("string")))
    answers = _finished(raw, stage, on_error, clean)
    back = salted_join(answers, rows, "_key", counted_hot_keys(distinct, "_key", min_hot), spread=["sample_id"])
    return back.select("sample_id", "stage", "pred_html", "error")


def cached_answers(spark: SparkSession, cache: str | None) -> DataFrame | None:
    """(_key, text) of a stored cache as it is now; a key that two jobs answered has one row. None without a cache."""
    if cache is None:
        return None
    schema = T_.StructType([T_.StructField("_key", T_.StringType()), T_.StructField("text", T_.StringType())])
    try:
        found = spark.read.schema(schema).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return store(found.groupBy("_key").agg(F.min("text").alias("text")), "cached")


def tokenize(df: DataFrame, encode: Callable[[], Callable[[str], tuple]], text: str = "html_table") -> DataFrame:
    """Add (input_ids, labels, error) from a user-supplied encoder, given as a factory."""
    @F.pandas_udf("input_ids array<int>, labels array<int>, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = encode()

        def one(value):
            try:
                ids, labels = encoder(value)
                return list(ids), list(labels), None
            except Exception as e:  # the row is reported, the job goes on
                return None, None, f"Encoding failed: {e}"

        for values in batches:
            yield pd.DataFrame([one(v) for v in values], columns=["input_ids", "labels", "error"], dtype=object)

    return C.once(df, "_enc", run(F.col(text))).select(*df.columns, "_enc.input_ids", "_enc.labels", "_enc.error")


def map_rows(df: DataFrame, fn: dict[str, Column] | Callable[[pd.DataFrame], pd.DataFrame], schema: str | None = None) -> DataFrame:
    """Row to row: named Columns, or an opaque function of batches of rows with the schema of what it returns."""
    if schema is None:
        return df.select(*[c.alias(n) for n, c in fn.items()])

    def run(frames):
        for frame in frames:
            yield fn(frame)
    return df.mapInPandas(run, schema)


def ocr_job(df: DataFrame, factory: Callable[[], Predictor], k: int = 20, prompt: Column | None = None) -> DataFrame:
    """(row_index, html_table_length, ground_truth_html, ocr_result) of the k longest tables."""
    chosen = T.topk_longest(C.not_null_html(df), k)
    chosen = chosen.withColumn("prompt", F.lit("") if prompt is None else prompt)
    raw = run_predictor(chosen, ["sample_id", "rank", "html_length", "html_table"], factory, batch=1,
                        workers=min(k, slots(df)), spread=True)
    return _finished(raw, "ocr", on_error="prefix", clean="none").select(
        (F.col("rank") - 1).alias("row_index"), F.col("html_length").alias("html_table_length"),
        F.col("html_table").alias("ground_truth_html"), F.col("pred_html").alias("ocr_result"))


def ocr_summary(results: DataFrame) -> DataFrame:
    """Status rows without the payload."""
    status = C.ocr_status(F.col("ocr_result"))
    return results.select("row_index", "html_table_length", status.alias("status"),
                          F.when(status == "error", F.col("ocr_result")).alias("error_message"))


def ocr_pairs(results: DataFrame) -> DataFrame:
    """Long form of the successful rows: one html file per row and side."""
    good = results.where(C.ocr_status(F.col("ocr_result")) == "success")
    sides = F.inline(F.array(*[
        F.struct(F.lit(side).alias("side"), F.col(col).alias("html"))
        for side, col in (("ground_truth", "ground_truth_html"), ("ocr_result", "ocr_result"))]))
    name = F.format_string("row_%02d_%s.html", F.col("row_index") + 1, F.col("side"))
    return good.select("row_index", sides).withColumn("html_file", name)
