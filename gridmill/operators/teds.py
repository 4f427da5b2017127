"""Scoring of predicted tables by tree-edit-distance similarity, as a Spark job.

Much of the work is avoided or placed before any tree is read: blank and tableless sides are
settled by Column expressions, of equal pairs one is scored, and the distinct pairs are dealt to tasks by
estimated cost. Only the comparison of one pair runs in Python.
"""

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from gridmill import schema as S
from gridmill.functions import html as H, tree
from gridmill.operators import curate as C
from gridmill.operators.balance import dealt_by_cost
from gridmill.operators.pairing import content_key
from gridmill.operators.skew import HOT_ROWS, counted_hot_keys, hot_keys, once_per_task, salted_join
from gridmill.sources.work import stage

NODE_TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string()]
SEEN = 200_000  # pairs remembered per task
TASK_PAIRS = 100_000  # distinct pairs of a scoring task at most, on average
READ_ROWS = 64  # rows of a batch that are Python texts at a time
SCORES = T.StructType([T.StructField("key", T.StringType()), T.StructField("teds_structure", T.DoubleType()),
                       T.StructField("teds_full", T.DoubleType()), T.StructField("score_error", T.StringType())])
SCORE_TYPES = [pa.string(), pa.float64(), pa.float64(), pa.string()]

CLEANERS = {"full": H.clean_html, "strip": H.strip, "none": lambda c: c}


def _shredder(html: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, columns = [], [[] for _ in S.NODE]
            for at, (text,) in enumerate(_rows_of(batch, html)):
                found = tree.parse(text, tree.lenient_span) if text is not None else []
                if found:
                    tags, colspans, rowspans, parts, _, parents, depths = zip(*found)
                    cells = [("".join(map("".join, p)) if p else "") if t == "td" else None for t, p in zip(tags, parts)]
                    rows.extend([at] * len(found))
                    for column, values in zip(columns, (range(len(found)), parents, depths, tags, colspans, rowspans, cells)):
                        column.extend(values)
            repeated = batch.select(keep).take(pa.array(rows, pa.int64()))
            nodes = [pa.array(c, t) for c, t in zip(columns, NODE_TYPES)]
            yield pa.RecordBatch.from_arrays([*repeated.columns, *nodes], [*keep, *S.NODE.names])
    return run


def shred_table(df: DataFrame, html: str = "html_table", tasks: int | None = None) -> DataFrame:
    """One row per table element, in document order: id, parent, depth, tag, spans, cell text.

    A span that is no number is null (scoring such a table is an error instead).
    Parsing is heavy next to reading; `tasks` deals the rows out first when the input has fewer
    splits than the cluster has cores.
    """
    keep = [c for c in df.columns if c != html]
    rows = df.select(*keep, html)
    rows = rows if tasks is None else rows.repartition(tasks, *keep)
    return rows.mapInArrow(_shredder(html, keep), T.StructType([*df.select(*keep).schema, *S.NODE]))


def _score(truth: str, pred: str) -> tuple:
    """Scores of one pair; equal texts are read once, so that they obey the same rules."""
    try:
        a = tree.read_trees(truth)
        b = a if truth == pred else tree.read_trees(pred)
        if a is None or b is None:
            return 0.0, 0.0, None
        if a is b:
            return 1.0, 1.0, None
        largest = max(a[2], b[2])
        return tree.similarity(a[1], b[1], largest), tree.similarity(a[0], b[0], largest), None
    except ValueError as e:
        return None, None, f"parse_failed: {e}"


def _scorer():
    @F.pandas_udf("teds_structure double, teds_full double, score_error string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        seen = {}  # copies of a pair are scored once per task; digests and three values each

        def score(truth, pred):
            if truth is None:
                return None, None, None
            key = hashlib.blake2b(f"{len(truth)}:{truth}{pred}".encode(), digest_size=16).digest()
            if key not in seen:
                if len(seen) >= SEEN:
                    seen.clear()
                seen[key] = _score(truth, pred)
            return seen[key]

        for truths, preds in batches:
            yield pd.DataFrame([score(t, p) for t, p in zip(truths, preds)],
                               columns=["teds_structure", "teds_full", "score_error"])
    return run


def _surely_read(html: Column) -> Column:
    """Does a text begin with a table and set no spans? Then the table can be read, and equals its copy."""
    return html.startswith("<table>") & ~(F.contains(html, F.lit("=")) & F.rlike(html, F.lit("(?iu)(?:col|row)span")))


def _rows_of(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """The values of some columns row by row; few rows at a time become Python objects."""
    columns = [batch.column(n) for n in names]
    for at in range(0, batch.num_rows, READ_ROWS):
        yield from zip(*(c.slice(at, READ_ROWS).to_pylist() for c in columns))


def _settled(df: DataFrame, truth: str, pred: str, clean: str, failure: Column | None, blank: str = "zero") -> DataFrame:
    """The other columns, `known` (the result where no tree is needed), `truth` and `pred` (null where it is known)."""
    clean_of = CLEANERS[clean]
    keep = [c for c in df.columns if c not in (truth, pred)]
    failure = F.lit(None).cast("string") if failure is None else failure
    raw = df.select(*keep, failure.alias("_failure"), F.col(truth).alias("_t"), F.col(pred).alias("_p"))
    both = C.once(raw, "_c", F.struct(clean_of(F.col("_t")).alias("truth"), clean_of(F.col("_p")).alias("pred")))
    both = both.select(*keep, "_failure", "_c.truth", "_c.pred")

    result = lambda score, error: F.struct(score.cast("double").alias("score"), error.cast("string").alias("error"))
    absent = lambda c: ~H.has_table(F.col(c))
    none = F.lit(None)
    known = F.when(F.col("_failure").isNotNull(), result(none, F.col("_failure")))
    if blank == "skip":
        empty = lambda c: F.coalesce(H.strip(F.col(c)) == "", F.lit(True))
        known = known.when(empty("truth") | empty("pred"), result(none, F.lit("blank")))
    known = known.when(absent("truth") | absent("pred"), result(F.lit(0.0), none))
    known = known.when((F.col("truth") == F.col("pred")) & _surely_read(F.col("truth")), result(F.lit(1.0), none))
    cases = C.once(both, "known", known)
    side = lambda c: F.when(F.col("known").isNull(), F.col(c)).alias(c)  # settled rows send no html to Python
    return cases.select(*keep, "known", side("truth"), side("pred"))


def score_pairs(df: DataFrame, truth: str, pred: str, clean: str = "full", failure: Column | None = None,
                tasks: int | None = None) -> DataFrame:
    """Add teds_structure, teds_full and score_error where the rows are; the two html columns are dropped.

    `clean` is what both sides go through first: full, strip or none. A side that is null, blank
    or has no table scores 0. Rows with a `failure` text get it as their error and no score. `tasks` deals the rows out by a hash
    of the row. For large tables `score_distinct` is the better way.
    """
    sent = _settled(df, truth, pred, clean, failure)
    keep = [c for c in sent.columns if c not in ("known", "truth", "pred")]
    dealt = sent if tasks is None else sent.repartition(tasks, *keep)
    scored = C.once(dealt, "_s", _scorer()(F.col("truth"), F.col("pred")))
    pick = lambda done, found: F.when(F.col("known").isNull(), F.col(found)).otherwise(F.col(done))
    return scored.select(*keep, pick("known.score", "_s.teds_structure").alias("teds_structure"),
                         pick("known.score", "_s.teds_full").alias("teds_full"),
                         pick("known.error", "_s.score_error").alias("score_error"))


def pair_cost(truth: Column, pred: Column) -> Column:
    """About what a comparison takes: the product of the numbers of elements, and reading both texts."""
    nodes = lambda c: (F.octet_length(c) - F.octet_length(F.replace(c, F.lit("<"), F.lit("")))) / 2 + 1  # opening and closing tags
    return nodes(truth) * nodes(pred) + (F.length(truth) + F.length(pred)) / 20 + 1


def _score_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = set()
    for batch in batches:
        rows = []
        for key, truth, pred in _rows_of(batch, "key", "truth", "pred"):
            if key not in seen:
                seen.add(key)
                rows.append((key, *_score(truth, pred)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), SCORE_TYPES)], SCORES.names)


def score_distinct(df: DataFrame, truth: str, pred: str, clean: str = "full", failure: Column | None = None, min_hot: int = HOT_ROWS,
                   tasks: int | None = None, blank: str = "zero") -> DataFrame:
    """`score_pairs` for tables of any size: equal pairs are scored once and tasks have about equal cost.

    With blank = "skip", a pair with a side that is null or blank after cleaning has the error `blank` instead of the score 0.

    `tasks` is the least number of scoring tasks; there are more where the distinct pairs are many, since a task remembers its keys.
    Equal texts that surely can be read need no tree, and no shuffle either.

    Cleaned pairs are stored once. The costs of distinct pairs, by content digest, say where a pair is scored; copies are dropped in the
    tasks that read them and meet the scores again by digest, a join that spreads pairs with many copies.
    """
    tasks = tasks or 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = _settled(df, truth, pred, clean, failure, blank)
    keep = [c for c in sent.columns if c not in ("known", "truth", "pred")]
    is_open = F.col("known").isNull()
    both = stage(sent.withColumns({"key": F.when(is_open, F.base64(F.unhex(content_key(F.col("truth"), F.col("pred"))))),
                                   "cost": F.when(is_open, pair_cost(F.col("truth"), F.col("pred")))}), "pairs")
    todo = both.where("key IS NOT NULL")
    costs = stage(todo.groupBy("key").agg(F.max("cost").alias("cost"), F.count(F.lit(1)).alias("n")), "costs")
    copies, distinct = costs.agg(F.coalesce(F.max("n"), F.lit(0)), F.count(F.lit(1))).first()
    tasks = max(tasks, -(-distinct // TASK_PAIRS))
    sides = todo.select("key", "truth", "pred")
    dealt = dealt_by_cost(once_per_task(sides, "key") if copies > 1 else sides, costs, tasks)
    scores = stage(dealt.mapInArrow(_score_once, SCORES), "scores")
    found = salted_join(scores, todo.select(*keep, "key"), "key", counted_hot_keys(costs, "key", min_hot), spread=keep).drop("key")
    settled = both.where("key IS NULL").select(*keep, F.col("known.score").alias("teds_structure"),
                                               F.col("known.score").alias("teds_full"), F.col("known.error").alias("score_error"))
    return found.select(*settled.columns).unionByName(settled)


def eval_table(truth: DataFrame, preds: DataFrame, stages: list[str], clean: str = "full", min_hot: int = HOT_ROWS,
               tasks: int | None = None, blank: str = "zero") -> DataFrame:
    """Every truth row at every expected stage with its prediction's scores.

    A failed generation leaves no row, so stages are named by the caller: what is missing or failed
    has an error and no score. Predictions of other stages are left out.

    Distinct pairs are scored once, in `tasks` tasks of about equal cost.
    """
    pair = F.concat_ws("/", "sample_id", "stage").alias("_pair")
    expected = truth.select("sample_id", F.explode(F.array(*map(F.lit, stages))).alias("stage"),
                            F.col("html_table").alias("truth_html")).select("*", pair)
    made = preds.where(F.col("stage").isin(*stages)).select(pair, "pred_html", "error")
    pairs = salted_join(expected, made, "_pair", hot_keys(made, "_pair", min_hot), how="left").drop("_pair")
    failure = F.when(F.col("pred_html").isNull() | F.col("error").isNotNull(),
                     F.coalesce(F.col("error"), F.lit("no prediction")))
    scored = score_distinct(pairs.withColumn("_f", failure).drop("error"), "truth_html", "pred_html", clean, F.col("_f"), min_hot, tasks, blank)
    return scored.drop("_f").withColumnRenamed("score_error", "error")


def score_made(truth: DataFrame, preds: DataFrame, stages: list[str], clean: str = "full", min_hot: int = HOT_ROWS,
               tasks: int | None = None) -> DataFrame:
    """The rows of `eval_table` that can have a score: those of predictions that were made, for samples that are in `truth`.

    What is missing or failed has none, so its rows need not be listed, and a truth row travels once, not once per stage.
    """
    made = preds.where(F.col("stage").isin(*stages) & F.col("pred_html").isNotNull() & F.col("error").isNull())
    made = made.select("sample_id", "stage", "pred_html")
    pairs = salted_join(truth.select("sample_id", F.col("html_table").alias("truth_html")), made, "sample_id",
                        hot_keys(made, "sample_id", min_hot))
    return score_distinct(pairs, "truth_html", "pred_html", clean, None, min_hot, tasks).withColumnRenamed("score_error", "error")


def average_scores(scored: DataFrame, by: list[str], policy: str = "zero") -> DataFrame:
    """Mean scores. Policy zero: failures count as 0. Policy skip: failures are left out, and with them the blank pairs of a
    table that was scored with blank = "skip"."""
    if policy == "zero":
        mean, n = lambda c: F.avg(F.coalesce(F.col(c), F.lit(0.0))), F.count(F.lit(1))
    else:
        mean, n = lambda c: F.avg(c), F.count("teds_full")
    aggs = [F.coalesce(mean("teds_structure"), F.lit(0.0)).alias("avg_structure"),
            F.coalesce(mean("teds_full"), F.lit(0.0)).alias("avg_full"), n.alias("n_evaluated")]
    return scored.groupBy(*by).agg(*aggs) if by else scored.agg(*aggs)


def eval_by_stage(truth: DataFrame, preds: DataFrame, stages: list[str], policy: str = "zero",
                  clean: str = "full", blank: str = "zero") -> DataFrame:
    return average_scores(eval_table(truth, preds, stages, clean, blank=blank), ["stage"], policy)
