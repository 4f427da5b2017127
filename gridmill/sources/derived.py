"""Samples, predictions, token rows and training logs derived from the stock tables.

Everything is computed row by row from `documents` (one table row per line of prose), `orders`
(a small grid per order) and `pages` (raw web pages), so the derivation never shuffles.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from gridmill.functions import order as O

# Fixed values of the token rows.
VOCAB = 151_643
PRESERVED = (VOCAB, VOCAB + 100)
SPECIALS = [151_645, 151_900]

HEAD = "<tr><th>part</th><th>qty</th><th>flag</th></tr>"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


BETWEEN = "</td><td>"
ROW, END = "<tr><td>", "</td></tr>"


def _lines(text: Column) -> Column:
    """A table row per line; the lines are not taken apart, so that a long text is copied once."""
    return F.concat(F.lit(ROW), F.replace(text, F.lit("\n"), F.lit(END + ROW)), F.lit(END))


def grids(spark: SparkSession, folder: str, read: Callable | None = None) -> DataFrame:
    """(sample_id, k, head, body, cut, img): the well-formed tables of both sources; `cut` is `body` without its last 1 to 3 rows."""
    read = read or (lambda name: table(spark, folder, name))
    kept = lambda n: F.greatest(n - 1 - (F.col("k") % 3).cast("int"), F.lit(0))
    k, text = F.col("doc_id"), F.col("text")
    lines = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    docs = read("documents").select((k * 3).alias("sample_id"), k.alias("k"), text, lines.alias("n")).select(
        "sample_id", "k", F.lit("").alias("head"), _lines(text).alias("body"),
        F.when(kept(F.col("n")) == 0, F.when(text.isNotNull(), "")).otherwise(
            _lines(F.call_function("substring_index", text, F.lit("\n"), kept(F.col("n"))))).alias("cut"),
        F.concat(F.lit("img"), F.md5(text.cast("binary"))).alias("img"))
    k = F.col("o_orderkey")
    rows = F.transform(F.sequence(F.lit(1), (k % 6 + 1).cast("int")), lambda i: F.concat(F.lit(ROW), F.concat_ws(
        BETWEEN, (F.col("o_custkey") + i).cast("string"), ((k * 7 + i * 3) % 50).cast("string"), F.col("o_orderstatus")), F.lit(END)))
    orders = read("orders").select(
        (k * 3 + 1).alias("sample_id"), k.alias("k"), rows.alias("rows"), F.concat(F.lit("img"), F.col("o_custkey")).alias("img")).select(
        "sample_id", "k", F.lit(HEAD).alias("head"), F.array_join("rows", "").alias("body"),
        F.array_join(F.slice("rows", 1, kept(F.size("rows"))), "").alias("cut"), "img")
    return docs.unionByName(orders)


def _table(head: Column, body: Column) -> Column:
    return F.concat(F.lit("<table>"), head, body, F.lit("</table>"))


def _dressed(k: Column, tb: Column) -> Column:
    """The table as a careless source would deliver it, by k mod 10."""
    put = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    m = k % 10
    return (
        F.when(m == 0, tb)
        .when(m == 1, put("```html\n", tb, "\n```"))
        .when(m == 2, put("<html><body>", tb, "</body></html>"))
        .when(m == 3, put(" ```HTML\n<HTML> <Body>", tb, "</BODY>\n</html> ```  "))
        .when(m == 4, put("\n", tb, "\n"))
        .when(m == 5, F.replace(tb, F.lit("</table>"), F.lit("")))
        .when(m == 7, "<div>no grid here</div>")
        .when(m == 8, "<table>")
        .when(m == 9, put(tb, tb))
    )


def samples(spark: SparkSession, folder: str, read: Callable | None = None) -> DataFrame:
    """(sample_id, split, html_table, image) over all three sources; `read` may open streams."""
    made = grids(spark, folder, read).select(
        "sample_id", _dressed(F.col("k"), _table(F.col("head"), F.col("body"))).alias("html_table"),
        F.when(F.col("k") % 20 != 9, F.col("img")).cast("binary").alias("image"))
    pages = (read("pages") if read else table(spark, folder, "pages")).select(
        (F.col("page_id") * 3 + 2).alias("sample_id"), F.col("html").alias("html_table"),
        F.concat(F.lit("img"), F.col("page_id")).cast("binary").alias("image"))
    split = F.when(F.col("sample_id") % 7 == 0, "validation").otherwise("train")
    return made.unionByName(pages).select("sample_id", split.alias("split"), "html_table", "image")


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """(sample_id, stage, pred_html, error) with edits whose distance is known.

    By k mod 5, `pre` is: the same table, the last rows cut off, one more character in the first
    cell, a wider first cell, a failure. `post` is the same table or a failure. Where k mod 13 is 5 both
    rows are missing, where k mod 11 is 3 that of `pre`.
    """
    g = grids(spark, folder)
    k = F.col("k")
    same = _table(F.col("head"), F.col("body"))
    rest = F.substring(F.col("body"), F.lit(len(ROW) + 1), F.octet_length("body"))
    first_td = lambda new: _table(F.col("head"), F.concat(F.lit(ROW.removesuffix("<td>") + new), rest))
    m = k % 5
    pre = (F.when(m == 0, same).when(m == 1, _table(F.col("head"), F.col("cut")))
           .when(m == 2, first_td("<td>9")).when(m == 3, first_td('<td colspan="2">')))
    stages = F.inline(F.array(
        F.struct(F.lit("pre").alias("stage"), pre.alias("pred_html")),
        F.struct(F.lit("post").alias("stage"), F.when(m != 4, same).alias("pred_html"))))
    error = F.when(F.col("pred_html").isNull(), "generation failed")
    missing = (k % 13 == 5) | ((k % 11 == 3) & (F.col("stage") == "pre"))
    return g.select("sample_id", "k", stages).where(~missing).select(
        "sample_id", "stage", "pred_html").withColumn("error", error)


def encoded(spark: SparkSession, folder: str) -> DataFrame:
    """(sample_id, split, html_table, image, input_ids, labels, attention_mask, error)."""
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("k"))
    failed = F.col("k") % 17 == 0
    ids = F.transform(F.sequence(F.lit(1), (F.col("k") % 40 + 1).cast("int")), lambda i: F.when(
        (i == 1) & (F.col("k") % 50 == 0), F.lit(-1)).otherwise(
        (F.col("k") * 7919 + i.cast("bigint") * 104729) % 152100).cast("int"))
    rows = orders.withColumn("input_ids", F.when(~failed, ids))
    labels = F.transform("input_ids", lambda x, i: F.when(i < F.col("k") % 5, F.lit(-100)).otherwise(x))
    return rows.select(
        F.col("k").alias("sample_id"), F.when(F.col("k") % 7 == 0, "validation").otherwise("train").alias("split"),
        F.when(F.col("k") % 10 != 6, F.concat(F.lit("<table>"), F.col("k"), F.lit("</table>"))).alias("html_table"),
        F.concat(F.lit("img"), F.col("k")).cast("binary").alias("image"),
        "input_ids", labels.alias("labels"), F.transform("input_ids", lambda x: F.lit(1)).alias("attention_mask"),
        F.when(failed, F.concat(F.lit("Encoding failed: key "), F.col("k"))).alias("error"))


def metrics_log(spark: SparkSession, folder: str, source: DataFrame | None = None) -> DataFrame:
    """(run_id, step, ts, loss) from events; also from a streaming read of them."""
    events = table(spark, folder, "events") if source is None else source
    return events.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("step"),
                         F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("loss"))


def evaluations(spark: SparkSession, folder: str, source: DataFrame | None = None) -> DataFrame:
    """(run_id, step, avg_full, n_evaluated): purchases read as evaluations; also from a streaming read of events."""
    events = table(spark, folder, "events") if source is None else source
    return events.where(F.col("event_type") == "purchase").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("step"),
        (F.col("value") / 1000).alias("avg_full"), (F.col("event_id") % 10 + 1).alias("n_evaluated"))


def training_log(spark: SparkSession, folder: str) -> DataFrame:
    """The log rows next to `evaluations`: every other event."""
    return metrics_log(spark, folder, table(spark, folder, "events").where(F.col("event_type") != "purchase"))


def image_paths(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    """(path): one file per document, of nine kinds; and more columns of the document."""
    suffixes = F.array(*[F.lit(s) for s in (".jpg", ".JPEG", ".png", ".bmp", ".tiff", ".webp", ".txt", ".gif", "")])
    suffix = F.element_at(suffixes, (F.col("doc_id") % 9 + 1).cast("int"))
    return table(spark, folder, "documents").select(
        F.concat(F.lit("/img/"), F.col("source"), F.lit("/d"), F.col("doc_id"), suffix).alias("path"), *more)


def image_files(spark: SparkSession, folder: str) -> DataFrame:
    """(name, content): the files of `image_paths`, each with the text of its document."""
    paths = image_paths(spark, folder, "text")
    return paths.select(F.substring_index("path", "/", -1).alias("name"), F.col("text").cast("binary").alias("content"))


def html_paths(spark: SparkSession, folder: str) -> DataFrame:
    """(path): a page for every document."""
    return table(spark, folder, "documents").select(
        F.concat(F.lit("/html/d"), F.col("doc_id"), F.lit(".html")).alias("path"))


def batched_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(sample_id, prompts, outs): a batch of two prompts and outputs per order."""
    e = encoded(spark, folder)
    prompt = F.slice("input_ids", 1, 3)
    return e.select("sample_id", F.array(prompt, F.slice("input_ids", 1, 1)).alias("prompts"),
                    F.array(F.col("input_ids"), F.col("input_ids")).alias("outs"))


def first_turns(spark: SparkSession, folder: str) -> DataFrame:
    """(conv_id, messages): the messages of the two lowest turns of every conversation, whatever their numbers.

    The rank is cut per map task before the shuffle, so a long conversation sends two turns per task.
    """
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").withColumn(
        "_r", F.dense_rank().over(W.partitionBy("conv_id").orderBy(F.asc_nulls_last("turn")))).where(F.col("_r") <= 2)
    message = F.when(F.col("turn").isNotNull(), F.struct("role", F.col("text").alias("content")))
    at = lambda r: F.max(F.when(F.col("_r") == r, message))
    both = turns.groupBy("conv_id").agg(at(1).alias("a"), at(2).alias("b"))
    return both.select("conv_id", F.array_compact(F.array("a", "b")).alias("messages"))


def step_settings() -> list[tuple[int, int, int, int]]:
    """Fixed values: (batch, accumulation, devices, epochs) settings of the step plan."""
    return [(1, 4, 1, 6), (1, 8, 1, 1), (2, 4, 4, 3)]
