"""Training-log analytics: cadence, throughput, smoothing, checkpoints, metric merging."""

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gridmill.functions.order import div
from gridmill.operators import ordered as R
from gridmill.sources.work import stage

LOG_EVERY = 10        # fixed value: logs are looked at on every tenth step
EVAL_FROM_STEP = 50   # fixed value: first step that may be evaluated


def cadence(log: DataFrame, every: int, start: int = 1) -> DataFrame:
    """Log rows on which a periodic action falls."""
    return log.where((F.col("step") % every == 0) & (F.col("step") >= start))


def gated_cadence(log: DataFrame, every: int, start: int = EVAL_FROM_STEP) -> DataFrame:
    """Periodic rows labelled evaluate, or skip while the run is younger than `start`."""
    return cadence(log, every).withColumn("action", F.when(F.col("step") >= start, "evaluate").otherwise("skip"))


def rate(step: Column, micros: Column, last_step: Column, last_micros: Column, per_step: int) -> Column:
    """Samples per second since the previous log, null for a first log or no progress."""
    seconds = (micros - last_micros) / 1e6
    return F.when(step > last_step, (step - last_step) * per_step / F.nullif(seconds, F.lit(0.0)))


def throughput(log: DataFrame, batch: int, accum: int, every: int = LOG_EVERY, block: int = R.BLOCK) -> DataFrame:
    logged = log.where(F.col("step") % every == 0).select("run_id", "step", F.unix_micros("ts").alias("_us"))
    last = F.struct(F.col("step").alias("step"), F.col("_us").alias("us"))
    w = R.inside(["run_id"], "step")
    rows = R.with_carry(
        R.with_block(logged, "step", block).withColumn("_prev", F.lag(last).over(w)), ["run_id"],
        [F.max("step").alias("_step"), F.max_by("_us", "step").alias("_last")],
        lambda before, whole: [
            F.lag(F.struct(F.col("_step").alias("step"), F.col("_last").alias("us"))).over(before).alias("_carry")])
    prev = F.coalesce(F.col("_prev"), F.col("_carry"))
    per_second = rate(F.col("step"), F.col("_us"), prev["step"], prev["us"], batch * accum)
    return rows.select("run_id", "step", per_second.alias("samples_per_sec"))


def elapsed_minutes(log: DataFrame, every: int = LOG_EVERY, block: int = R.BLOCK) -> DataFrame:
    """Minutes since the first log of the run, on every tenth step that has a loss."""
    timed = log.select("run_id", "step", "loss", F.unix_micros("ts").alias("_us"))
    rows = R.with_carry(
        R.with_block(timed, "step", block), ["run_id"], [F.min("_us").alias("_first")],
        lambda before, whole: [F.min("_first").over(whole).alias("_start")])
    shown = rows.where((F.col("step") % every == 0) & F.col("loss").isNotNull())
    return shown.select("run_id", "step", "loss", ((F.col("_us") - F.col("_start")) / 6e7).alias("minutes"))


def ema_smooth(log: DataFrame, weight: float = 0.9, value: str = "loss", block: int | None = None,
               index_block: int = R.BLOCK) -> DataFrame:
    """Debiased exponential average: sum(w^(i-j) x_j) / sum(w^(i-j)) over j <= i, per run.

    Inside a block of rows the weighted sum is a running sum of x_j * w^-j scaled back. Blocks
    are short enough for w^-j to stay finite, and what earlier blocks add to their successor is
    a weighted sum of block totals; beyond `reach` blocks the weight underflows to zero. Weight 0
    does not smooth, weight 1 is the running mean.
    """
    if weight == 0:
        return log.where(F.col(value).isNotNull()).select("run_id", "step", value, F.col(value).cast("double").alias("smoothed"))
    if weight == 1:
        return _running_mean(log, value, index_block)
    decay = abs(math.log(weight))
    size = block or max(1, int(200 / decay))
    reach = math.ceil(750 / (size * decay))
    rows = R.with_index(log.where(F.col(value).isNotNull()).select("run_id", "step", value),
                        ["run_id"], "step", index_block)
    rows = R.with_block(rows, "pos", size).withColumn("_in", F.col("pos") - F.col("_block") * size)
    w = R.inside(["run_id"], "pos").rowsBetween(W.unboundedPreceding, 0)
    local = F.sum(F.col(value) * F.pow(F.lit(weight), -F.col("_in"))).over(w) * F.pow(F.lit(weight), F.col("_in"))
    tail = F.sum(F.col(value) * F.pow(F.lit(weight), size - 1 - F.col("_in")))

    def carry(before, whole):
        lags = [F.coalesce(F.lag("_tail", k).over(before), F.lit(0.0)) * weight ** (size * (k - 1))
                for k in range(1, reach + 1)]
        return [sum(lags[1:], lags[0]).alias("_carry")]

    rows = R.with_carry(rows.withColumn("_local", local), ["run_id"], [tail.alias("_tail")], carry)
    total = F.col("_local") + F.col("_carry") * F.pow(F.lit(weight), F.col("_in") + 1)
    mass = (1 - F.pow(F.lit(weight), F.col("pos") + 1)) / (1 - weight)
    return rows.select("run_id", "step", F.col(value), (total / mass).alias("smoothed"))


def _running_mean(log: DataFrame, value: str, block: int) -> DataFrame:
    rows = R.with_index(log.where(F.col(value).isNotNull()).select("run_id", "step", value), ["run_id"], "step", block)
    run = R.inside(["run_id"], "pos").rowsBetween(W.unboundedPreceding, 0)
    rows = R.with_block(rows, "pos", block).withColumn("_sum", F.sum(value).over(run))
    rows = R.with_carry(rows, ["run_id"], [F.sum(value).alias("_total")],
                        lambda before, whole: [F.coalesce(F.sum("_total").over(R.earlier(before)), F.lit(0)).alias("_before")])
    mean = (F.col("_sum") + F.col("_before")) / (F.col("pos") + 1)
    return rows.select("run_id", "step", F.col(value), mean.alias("smoothed"))


def best_checkpoint(log: DataFrame, loss: str = "loss") -> DataFrame:
    """Checkpoint with the lowest loss of every run; the earliest one wins a tie."""
    best = F.min(F.struct(F.col(loss).alias("loss"), F.col("step").alias("step")))
    return log.where(F.col(loss).isNotNull()).groupBy("run_id").agg(best.alias("b")).select(
        "run_id", F.col("b.step").alias("step"), F.col("b.loss").alias("loss"))


def retained_checkpoints(log: DataFrame, limit: int, save_every: int) -> DataFrame:
    """The newest `limit` checkpoints of every run, plus its best one.

    `row_number() <= limit` is cut per map task before the shuffle, so a long run sends at most
    `limit` rows per task.
    """
    saved = cadence(log, save_every).select("run_id", "step", "loss")
    newest_first = W.partitionBy("run_id").orderBy(F.desc("step"))
    newest = saved.withColumn("_r", F.row_number().over(newest_first)).where(F.col("_r") <= limit)
    best = best_checkpoint(saved).withColumn("is_best", F.lit(True))
    every = newest.select("run_id", "step", "loss", F.lit(False).alias("is_best")).unionByName(best)
    return every.groupBy("run_id", "step", "loss").agg(F.max("is_best").alias("is_best"))


def append_metrics(log: DataFrame, evals: DataFrame, metrics: list[str], block: int = R.BLOCK) -> DataFrame:
    """Merge every evaluation into the last log row at or before its step.

    Later evaluations overwrite earlier ones on the same row. Steps grow within a run, so the
    last log step so far is a running maximum over logs and evaluations laid side by side.
    """
    packed = F.struct(*metrics)
    none = F.lit(None)
    row = log.select(F.struct("*").alias("_row"))
    marks = row.select(F.col("_row.run_id").alias("run_id"), F.col("_row.step").alias("step"), F.col("_row.step").alias("_log"),
                       F.lit(0).alias("_kind"), none.cast(evals.select(packed.alias("m")).schema["m"].dataType).alias("_m"), "_row")
    marks = stage(marks.unionByName(evals.select(
        "run_id", "step", none.cast("bigint").alias("_log"), F.lit(1).alias("_kind"), packed.alias("_m"),
        none.cast(row.schema["_row"].dataType).alias("_row"))), "marks")  # both sources are read once
    w = R.inside(["run_id"], "step", "_kind").rowsBetween(W.unboundedPreceding, 0)
    seen = R.with_carry(
        R.with_block(marks.drop("_row"), "step", block).withColumn("_seen", F.max("_log").over(w)), ["run_id"],
        [F.max("_log").alias("_top")],
        lambda before, whole: [F.max("_top").over(R.earlier(before)).alias("_carry")])
    latest = (seen.where(F.col("_kind") == 1)
              .withColumn("step_of_log", F.coalesce("_seen", "_carry"))
              .groupBy("run_id", "step_of_log").agg(F.max_by("_m", "step").alias("_m"))
              .select("run_id", F.col("step_of_log").alias("step"), "_m"))
    rows = marks.where(F.col("_kind") == 0).select("run_id", "step", "_row")
    return rows.join(latest, ["run_id", "step"], "left").select("_row.*", *[F.col(f"_m.{m}") for m in metrics])


def progress_marks(df: DataFrame, ok: Column, every: int, block: int = R.BLOCK) -> DataFrame:
    """Rows processed and rows valid so far, reported at every `every`-th row by position."""
    flags = stage(df.select("sample_id", F.coalesce(ok, F.lit(False)).cast("bigint").alias("_ok")), "flags")  # judged once
    w = R.inside([], "sample_id")
    run = w.rowsBetween(W.unboundedPreceding, 0)
    rows = R.with_block(flags, "sample_id", block).withColumns(
        {"_rank": F.row_number().over(w), "_valid": F.sum("_ok").over(run)})
    rows = R.with_totals_before(rows, [F.count(F.lit(1)).alias("_n"), F.sum("_ok").alias("_v")], ["_n", "_v"])
    counted = rows.select((F.col("_rank") + F.col("_n_before")).alias("processed"),
                          (F.col("_valid") + F.col("_v_before")).alias("valid"))
    return counted.where(F.col("processed") % every == 0)
