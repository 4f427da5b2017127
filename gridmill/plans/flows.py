"""The usual jobs, composed from operators. Tables that several passes read are written once."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame

from gridmill.operators import curate as C, pairing as J, predict as P, ranking as T, sampling as S, teds as E
from gridmill.sources import work


def curate_and_split(samples: DataFrame, num: int = 85, den: int = 100, seed: int = 3407) -> DataFrame:
    """Clean, validate and split exactly. The curated table is stored: counting and finding the cut
    point then read its ids only, instead of cleaning everything again."""
    return S.split_exact(work.stage(C.filter_and_clean(samples), "curated"), num, den, seed)


def split_ids(samples: DataFrame, num: int = 85, den: int = 100, seed: int = 3407) -> DataFrame:
    """(sample_id, split) of the valid samples; only their ids are stored."""
    return S.split_exact(work.stage(C.filter_and_clean(samples).select("sample_id"), "valid_ids"), num, den, seed)


def manifest(samples: DataFrame, k: int = 20) -> DataFrame:
    """File names and lengths of the k longest valid samples, without fetching their rows."""
    return T.export_manifest(T.topk_ids(C.filter_and_clean(samples), k))


def holdout(samples: DataFrame, k: int = 20) -> DataFrame:
    """The k longest valid samples, cleaned and ranked.

    Ranking reads no images; the wide rows are fetched from the raw table by id, so cleaning is
    repeated for k rows only.
    """
    ids = T.topk_ids(C.filter_and_clean(samples), k)
    return C.filter_and_clean(T.with_ids(samples, ids, k))


def stored_by_sample(df: DataFrame, name: str, buckets: int | None = None) -> DataFrame:
    """Store rows in buckets of sample_id, sorted: tables stored this way with equal `buckets` are joined and grouped by
    sample without a shuffle, however often. The table is in the session's catalog, its files are in the work folder."""
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = work.fresh_path(spark, name)
    table = path.rsplit("/", 1)[-1].replace("-", "_")
    rows = df.repartition(n, "sample_id")  # one file per bucket
    rows.write.bucketBy(n, "sample_id").sortBy("sample_id").option("path", path).saveAsTable(table)
    return spark.table(table)


def compare_stages(truth: DataFrame, preds: DataFrame, before: str, after: str, value: str = "teds_full",
                   clean: str = "full") -> DataFrame:
    """One row per predicted sample: its text at either stage and how much higher the later one scores.

    score_delta is null where either stage has no score or the sample is not in `truth`.
    """
    texts = J.compare_stages(preds, before, after)
    delta = J.score_delta(E.score_made(truth, preds, [before, after], clean), before, after, value)
    return texts.join(delta, "sample_id", "left")


def evaluate(samples: DataFrame, factory: Callable, stage: str, n: int | None = None,
             prompt: Column | None = None, policy: str = "zero") -> DataFrame:
    """Predict the first n valid samples (all of them by default), score them, average."""
    truth = C.filter_and_clean(samples)
    truth = work.stage(truth if n is None else S.first_n(truth, n), "truth")
    preds = P.dedup_predict(truth, factory, stage, prompt)
    return E.eval_by_stage(truth, preds, [stage], policy)
