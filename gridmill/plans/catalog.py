"""One query per operator, over whole tables. Nested results are flattened to scalar columns."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridmill.functions import html as H, messages as M, tokens as K
from gridmill.operators import (curate as C, observed as B, pairing as J, predict as P, ranking as T, reports as R, runlog as L,
                                sampling as S, teds as E)
from gridmill.plans import flows, stubs
from gridmill.sources import derived as D, keyed, tables as IO, work
from gridmill.sources.files import write_files
from gridmill.streaming import streams as ST

INSTRUCTION = "Transcribe the pictured grid as markup."
FLAT_PROMPT = "Give the markup of the grid in the picture."
BATCH_PROMPT = "<image>\nTranscribe the grid."
SYSTEM = "You transcribe pictures of grids."

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def on_samples(name: str, build: Callable[[DataFrame], DataFrame], source=D.samples) -> None:
    QUERIES[name] = lambda spark, folder: build(source(spark, folder))


def text(c):
    """Image bytes of the derived tables are text."""
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def pick(df: DataFrame, **exprs) -> DataFrame:
    """sample_id and named expressions."""
    return df.select("sample_id", *[e.alias(n) for n, e in exprs.items()])


def html():
    return F.col("html_table")


def ids():
    return F.col("input_ids")


# --- sources and sinks --------------------------------------------------------------------------

@query
def load_split(spark, folder):
    path = work.fresh_path(spark, "samples")
    IO.write_samples(D.samples(spark, folder), path)
    return IO.read_samples(spark, path, "validation").select(
        "sample_id", "split", "html_table", text("image").alias("image"))


@query
def load_all_splits(spark, folder):
    path = work.fresh_path(spark, "samples")
    IO.write_samples(D.samples(spark, folder), path)
    return IO.read_samples(spark, path).select("sample_id", "split", F.length(html()).alias("html_length"))


on_samples("sample_n", lambda df: S.sample_n(df.select("sample_id", "split"), 5000, 42))
@query
def scan_image_folder(spark, folder):
    """The image files of a folder that holds a file per document."""
    out = work.fresh_path(spark, "images")
    write_files(D.image_files(spark, folder), out)
    return IO.scan_images(spark, out).select(F.substring_index("path", "/", -1).alias("file"), "length")


@query
def export_samples(spark, folder):
    valid = C.filter_and_clean(D.samples(spark, folder))
    return IO.export_samples(valid, 20, work.fresh_path(spark, "holdout"))


@query
def export_predictions(spark, folder):
    ids = T.topk_ids(C.filter_and_clean(D.samples(spark, folder)), 20)
    files = IO.prediction_files(D.predictions(spark, folder), ids, 20)
    path = work.fresh_path(spark, "predictions")
    IO.export_predictions(files, path)
    return IO.read_predictions(spark, path)


def _ocr(spark, folder):
    return P.ocr_job(D.samples(spark, folder), stubs.stub_model, 20, F.lit(INSTRUCTION))


@query
def ocr_job(spark, folder):
    return _ocr(spark, folder)


def _exported(spark, folder):
    path = work.fresh_path(spark, "ocr")
    IO.export_ocr(_ocr(spark, folder), path)
    return path


@query
def export_ocr_pairs(spark, folder):
    return IO.read_ocr_pairs(spark, _exported(spark, folder))


@query
def ocr_summary(spark, folder):
    return IO.read_ocr_summary(spark, _exported(spark, folder))


def _answers(spark, folder):
    """OCR results of every row that has html."""
    made = P.batch_predict(C.not_null_html(D.samples(spark, folder)), stubs.stub_model, "ocr", F.lit(INSTRUCTION),
                           on_error="prefix", clean="none")
    return made.select(F.col("pred_html").alias("ocr_result"))


@query
def success_count(spark, folder):
    return R.success_count(_answers(spark, folder))


@query
def status_split(spark, folder):
    status = C.ocr_status(F.col("ocr_result"))
    return _answers(spark, folder).groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query
def append_metrics(spark, folder):
    """The stored log after a stream of evaluations has been merged into it."""
    path = work.fresh_path(spark, "log")
    IO.append_log(D.training_log(spark, folder), 0, path)
    evals = D.evaluations(spark, folder, _stream(spark, folder, "events"))
    IO.stream_metrics(evals, path, ["avg_full", "n_evaluated"], work.fresh_path(spark, "log-state"))
    return keyed.read(spark, path).select("run_id", "step", "loss", F.round("avg_full", 6).alias("avg_full"), "n_evaluated")


# --- scalar functions ---------------------------------------------------------------------------

on_samples("clean_html", lambda df: pick(df, cleaned=H.clean_html(html())))
on_samples("clean_html_inline", lambda df: pick(df, stage=F.col("stage"), cleaned=H.clean_html(F.col("pred_html"))),
           D.predictions)
on_samples("strip_prediction", lambda df: pick(df, stripped=H.strip(html())))
on_samples("truncate_html", lambda df: pick(df, html_table=H.truncate_html(html(), 8000)))
on_samples("truncate_html_tiered", lambda df: pick(df, html_table=H.truncate_html(html(), H.tier_limit(F.col("sample_id") % 3 * 4))))
on_samples("char_length", lambda df: pick(df, html_length=F.length(html())))
on_samples("preview", lambda df: pick(df, preview=H.preview(html())))
on_samples("count_table_tags", lambda df: pick(df, n_open=H.count_table_open(html()), n_close=H.count_table_close(html())))
on_samples("sample_file_name", lambda df: pick(df, html_file=H.sample_file(F.col("sample_id"), ".html")))
on_samples("path_stem_suffix", lambda df: df.select(
    "path", H.path_stem(F.col("path")).alias("stem"), H.path_suffix(F.col("path")).alias("suffix")), D.image_paths)


def _parts(df: DataFrame) -> DataFrame:
    turns = df.select("sample_id", F.posexplode("messages").alias("turn", "m"))
    parts = turns.select("sample_id", "turn", F.col("m.role").alias("role"), F.posexplode("m.content").alias("part", "p"))
    return parts.select("sample_id", "turn", "role", "part", "p.type", "p.text", text("p.image").alias("image"))


def _flat(df: DataFrame) -> DataFrame:
    turns = df.select("sample_id", text(F.col("images")[0]).alias("image"), F.posexplode("messages").alias("turn", "m"))
    return turns.select("sample_id", "turn", "m.role", "m.content", "image")


def _flat_of(prompt):
    return lambda df: _flat(df.select("sample_id", M.to_flat_messages(prompt, html()).alias("messages"),
                                      M.images_of(F.col("image")).alias("images")))


on_samples("to_parts_messages", lambda df: _parts(
    df.select("sample_id", M.to_parts_messages(INSTRUCTION, html(), F.col("image")).alias("messages"))))
on_samples("to_flat_messages", _flat_of(FLAT_PROMPT))
on_samples("to_flat_messages_batch", _flat_of(BATCH_PROMPT))
on_samples("to_prompt_messages", lambda df: _parts(
    df.select("sample_id", M.to_prompt_messages(INSTRUCTION, F.col("image"), SYSTEM).alias("messages"))))
on_samples("prompt_turn", lambda df: df.select(
    "conv_id", M.prompt_turn(F.col("messages"))["role"].alias("role"),
    M.prompt_turn(F.col("messages"))["content"].alias("content")), D.first_turns)
on_samples("ground_truth_of", lambda df: df.select(
    "conv_id", M.ground_truth(F.col("messages"), default=F.lit("")).alias("truth")), D.first_turns)


# --- tokens -------------------------------------------------------------------------------------

LO, HI = D.PRESERVED


def _joined(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def _encoded(name, build):
    on_samples(name, build, D.encoded)


def _clamped(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "input_ids": K.clamp_ids(F.col("input_ids"), D.VOCAB, D.SPECIALS, LO, HI),
        "labels": K.clamp_ids(F.col("labels"), D.VOCAB, D.SPECIALS, LO, HI, ignore=K.IGNORE)})


_encoded("truncate_tokens", lambda df: pick(df, input_ids=_joined(K.truncate_tokens(ids(), 20)), attention=F.size(K.truncate_tokens(F.col("attention_mask"), 20)),
    was_cut=F.size(ids()) > 20))
_encoded("strip_prompt_tokens", lambda df: pick(df, generated=_joined(K.strip_prompt(ids(), F.slice(ids(), 1, 5)))))
_encoded("clamp_token_ids", lambda df: pick(_clamped(df), input_ids=_joined(ids())))
_encoded("clamp_labels", lambda df: pick(_clamped(df), labels=_joined(F.col("labels"))))
_encoded("clamp_counts", lambda df: pick(df, n_clamped=K.clamped_count(ids(), D.VOCAB, D.SPECIALS, LO, HI),
    n_preserved=K.preserved_count(ids(), D.VOCAB, D.SPECIALS, LO, HI)))
_encoded("validate_token_range", lambda df: pick(C.with_range_error(df, D.VOCAB), error=F.col("error")))
_encoded("error_type", lambda df: pick(C.with_range_error(df, D.VOCAB), error_type=H.error_type(F.col("error"))))
_encoded("safe_filter", lambda df: pick(C.safe_filter(df, 30, D.VOCAB), split=F.col("split"), html_table=html()))
_encoded("error_histogram", lambda df: R.error_histogram(C.with_status(df, 30, D.VOCAB)))
_encoded("first_errors", lambda df: R.first_errors(C.with_status(df, 30, D.VOCAB), 5))
_encoded("filter_token_length", lambda df: pick(C.filter_token_length(df, 20), n_tokens=F.size(ids())))
_encoded("filter_encodable", lambda df: pick(C.filter_encodable(_clamped(df), 30), split=F.col("split"), html_table=html()))
_encoded("audit_clamped", lambda df: C.audit_clamped(_clamped(df), D.VOCAB, D.SPECIALS, LO, HI))
on_samples("zip_arrays", lambda df: df.select(
    "sample_id", F.posexplode(K.zip_strip_prompt(F.col("outs"), F.col("prompts"))).alias("at", "g"),
).select("sample_id", "at", _joined(F.col("g")).alias("generated")), D.batched_ids)


# --- filters and reports ------------------------------------------------------------------------

on_samples("valid_html", lambda df: C.with_cleaned(df).select(
    "sample_id", H.valid_html(html(), F.col("cleaned"), F.col("image")).alias("valid")))
on_samples("reject_reason", lambda df: C.with_reject_reason(df).select("sample_id", "reason"))
on_samples("filter_and_clean", lambda df: C.filter_and_clean(df).select(
    "sample_id", "split", "html_table", text("image").alias("image")))
on_samples("not_null_html", lambda df: C.not_null_html(df).select("sample_id", "split"))
on_samples("filter_rows", lambda df: C.filter_rows(df, F.contains(html(), F.lit("<td>")) & F.col("image").isNotNull())
           .select("sample_id", "split"))
on_samples("filter_char_length", lambda df: C.filter_char_length(df, 300).select("sample_id", "html_table"))
on_samples("nonblank_pair", lambda df: C.nonblank(df, "truth", "pred").select("sample_id", "stage"),
           lambda s, d: J.pair_predictions(
               D.samples(s, d).select("sample_id", html().alias("truth")),
               D.predictions(s, d).select("sample_id", "stage", F.col("pred_html").alias("pred"))))
SPLITS = ["train", "validation"]


@query
def require_non_empty(spark, folder):
    """Rows of the curated table, after a write that fails where a split is left empty."""
    out = work.fresh_path(spark, "curated")
    B.write_curated(D.samples(spark, folder), out, SPLITS)
    return IO.read_samples(spark, out).agg(F.count(F.lit(1)).alias("n"))


@query
def observed_filter_report(spark, folder):
    """filter_report from the metrics of the write itself."""
    metrics = B.write_curated(D.samples(spark, folder), work.fresh_path(spark, "curated"), SPLITS)
    return B.filter_report(spark, metrics, SPLITS)


on_samples("filter_report", R.filter_report)
on_samples("reject_histogram", R.reject_histogram)
on_samples("split_report", R.split_report)
on_samples("size_before_after", lambda df: R.size_report(df, F.length(html()) <= 300))
on_samples("training_step_plan", lambda df: R.step_plan(
    R.split_report(df).select("split", "n"), D.step_settings()))


# --- sampling and ranking -----------------------------------------------------------------------

on_samples("train_val_split", flows.split_ids)
on_samples("ratio_split", lambda df: S.split_exact(df.select("sample_id", "split"), 99, 100, 42))
on_samples("seeded_shuffle", lambda df: S.seeded_index(df, 3407).select("sample_id", "position"))
on_samples("assign_training_batches", lambda df: S.assign_batches(df, 4, 2, 4, 42, drop_last=True))
on_samples("first_n_eval", lambda df: S.first_n(C.filter_and_clean(df), 10).select("sample_id", "html_table"))
on_samples("tiered_eval_sample", lambda df: S.tiered_sample(df.select("sample_id", "split"), 4, 5))
on_samples("topk_longest", lambda df: flows.holdout(df, 20).select("sample_id", "html_length", "html_table"))
on_samples("topk_ranked", flows.manifest)


# --- run logs -----------------------------------------------------------------------------------

def _log(name, build):
    on_samples(name, build, D.metrics_log)


_log("log_throughput", lambda log: L.throughput(log, 1, 4).select(
    "run_id", "step", F.round("samples_per_sec", 6).alias("samples_per_sec")))
_log("eval_cadence", lambda log: L.cadence(log, 10).select("run_id", "step", "loss"))
_log("gated_cadence", lambda log: L.gated_cadence(log, 10).select("run_id", "step", "action"))
_log("elapsed_minutes", lambda log: L.elapsed_minutes(log).withColumn("minutes", F.round("minutes", 6)))
_log("ema_smooth", lambda log: L.ema_smooth(log).withColumn("smoothed", F.round("smoothed", 6)))
_log("best_checkpoint", L.best_checkpoint)
_log("retained_checkpoints", lambda log: L.retained_checkpoints(log, 3, 5))
on_samples("progress_marks", lambda df: L.progress_marks(
    C.with_reject_reason(df), F.col("reason").isNull(), 1000))


# --- pairing ------------------------------------------------------------------------------------

@query
def pair_predictions(spark, folder):
    truth = C.filter_and_clean(D.samples(spark, folder)).select("sample_id", "html_table")
    return J.pair_predictions(truth, D.predictions(spark, folder))


@query
def compare_stages(spark, folder):
    preds = work.stage(D.predictions(spark, folder), "predictions")
    truth = C.filter_and_clean(D.samples(spark, folder))
    return flows.compare_stages(truth, preds, "pre", "post").withColumn("score_delta", F.round("score_delta", 6))


@query
def pair_by_stem(spark, folder):
    return J.pair_by_stem(IO.only_images(D.image_paths(spark, folder)), D.html_paths(spark, folder))


def _predictions(df: DataFrame) -> DataFrame:
    return df.select("sample_id", "stage", "pred_html", "error")


on_samples("batch_predict", lambda df: _predictions(P.batch_predict(df, stubs.stub_model, "pre", F.lit(INSTRUCTION))))
on_samples("eval_predict", lambda df: _predictions(P.batch_predict(
    df, stubs.stub_model, "eval", F.lit(INSTRUCTION), on_error="empty", clean="strip")))
on_samples("dedup_predict", lambda df: _predictions(P.dedup_predict(df, stubs.stub_model, "pre", F.lit(INSTRUCTION))))
on_samples("tokenize", lambda df: P.tokenize(df.select("sample_id", "html_table"), stubs.stub_tokenizer).select(
    "sample_id", F.size("input_ids").alias("n_tokens"),
    F.aggregate("input_ids", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("sum_ids"), "error"))
on_samples("map_rows", lambda df: P.map_rows(df, {
    "sample_id": F.col("sample_id"), "n_chars": F.coalesce(F.length("html_table"), F.lit(-1)).cast("long")}))


# --- scoring ------------------------------------------------------------------------------------

on_samples("shred_table", lambda df: E.shred_table(df.select("sample_id", "html_table"), tasks=32))


def _scored(spark, folder):
    return E.eval_table(C.filter_and_clean(D.samples(spark, folder)), D.predictions(spark, folder), ["pre", "post"])


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@query
def teds_structure(spark, folder):
    return _rounded(_scored(spark, folder), "teds_structure").select("sample_id", "stage", "teds_structure")


@query
def teds_full(spark, folder):
    return _rounded(_scored(spark, folder), "teds_full").select("sample_id", "stage", "teds_full")


@query
def eval_table(spark, folder):
    return _rounded(_scored(spark, folder), "teds_structure", "teds_full").select(
        "sample_id", "stage", "teds_structure", "teds_full", "error")


@query
def teds_avg_zero_policy(spark, folder):
    return _rounded(E.average_scores(_scored(spark, folder), [], "zero"), "avg_structure", "avg_full")


@query
def teds_avg_skip_policy(spark, folder):
    return _rounded(E.average_scores(_scored(spark, folder), [], "skip"), "avg_structure", "avg_full")


@query
def eval_by_stage(spark, folder):
    return _rounded(E.average_scores(_scored(spark, folder), ["stage"], "zero"), "avg_structure", "avg_full")


@query
def predict_and_score(spark, folder):
    """Predict every valid sample, score the answers, average: a model that repeats what it is told fails on some images."""
    return _rounded(flows.evaluate(D.samples(spark, folder), stubs.echo_model, "echo", prompt=F.col("html_table")),
                    "avg_structure", "avg_full")


# --- streams ------------------------------------------------------------------------------------

def _stream(spark, folder, name):
    """A table of the folder as a file stream; the glob admits a single file as well as a folder."""
    return spark.readStream.schema(D.table(spark, folder, name).schema).parquet(f"{folder}/{name}.parquet*")


@query
def stream_clean_filter(spark, folder):
    stream = D.samples(spark, folder, lambda name: _stream(spark, folder, name))
    done = ST.run_available(ST.clean_filter(stream), name="cleaned")
    return done.select("sample_id", "split", "html_table", text("image").alias("image"))


@query
def stream_filter_report(spark, folder):
    """filter_report from the metrics that the triggers of a cleaning stream report."""
    stream = D.samples(spark, folder, lambda name: _stream(spark, folder, name))
    _, progress = ST.run_watched(ST.watched(stream, SPLITS), B.Progress())
    return B.filter_report(spark, progress.metrics(), SPLITS)


@query
def stream_monitor_5m(spark, folder):
    log = D.metrics_log(spark, folder, _stream(spark, folder, "events"))
    done = ST.run_keyed(ST.monitor(log), ["window_start"], F.date_trunc("day", "window_start"), name="monitor")
    return done.select(F.unix_seconds("window_start").alias("window_start"), "n",
                       F.round("sum_loss", 4).alias("sum_loss"), "max_step")


@query
def stream_throughput(spark, folder):
    log = D.metrics_log(spark, folder, _stream(spark, folder, "events"))
    with ST.on_rocksdb(spark):
        done = ST.run_available(ST.throughput(log, 1, 4), name="throughput")
    return done.select("run_id", "step", F.round("samples_per_sec", 6).alias("samples_per_sec"))


@query
def stream_dedup(spark, folder):
    """Requests of an event stream: of equal ones the first is answered, with one model call for each content."""
    events = _stream(spark, folder, "events")
    requests = events.select(
        F.col("ts").cast("timestamp").alias("ts"), F.concat_ws("/", "event_type", "props").alias("prompt"),
        F.col("user_id").cast("string").cast("binary").alias("image"))
    requests = requests.withColumn("sample_id", F.xxhash64("prompt", "image"))
    path = lambda name: work.fresh_path(spark, f"requests-{name}")
    answers = ST.predict_once(ST.dedup(requests, "60 days"), stubs.stub_model, path("cache"), path("answers"), path("state"))
    return answers.groupBy("pred_html", "error").agg(F.count(F.lit(1)).alias("n"))


@query
def stream_eval_avg(spark, folder):
    path = work.fresh_path(spark, "scored")
    _scored(spark, folder).write.parquet(path)
    stored = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    return _rounded(ST.run_keyed(ST.eval_avg(stored), ["stage"], F.lit(0), name="averages"), "avg_structure", "avg_full")
