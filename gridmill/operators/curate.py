"""Cleaning, validation and length control over sample and token tables."""

from pyspark.sql import Column, DataFrame, functions as F

from gridmill.functions import html as H, tokens as K


def once(df: DataFrame, name: str, expr: Column) -> DataFrame:
    """Add a column that is computed exactly once per row.

    A plain projection would be substituted into every later filter and expression that uses
    it, repeating the regex work; predicates are not pushed through a generator.
    """
    return df.select("*", F.explode(F.array(expr)).alias(name))


def with_cleaned(df: DataFrame) -> DataFrame:
    return once(df, "cleaned", H.clean_html(F.col("html_table")))


def with_reject_reason(df: DataFrame) -> DataFrame:
    """Add `cleaned` and `reason` (null = valid)."""
    lowered = once(with_cleaned(df), "_lowered", F.lower("cleaned"))
    reason = H.reject_reason(F.col("html_table"), F.col("cleaned"), F.col("image"), F.col("_lowered"))
    return once(lowered, "reason", reason).drop("_lowered")


def filter_and_clean(df: DataFrame) -> DataFrame:
    """Keep valid samples, with their html replaced by its cleaned form.

    A sample without html or image is never valid; said first, the scan can leave it out.
    """
    present = df.where(F.col("html_table").isNotNull() & F.col("image").isNotNull())
    kept = with_reject_reason(present).where(F.col("reason").isNull())
    return kept.select(*[F.col("cleaned").alias(c) if c == "html_table" else F.col(c) for c in df.columns])


def not_null_html(df: DataFrame) -> DataFrame:
    return df.where(F.col("html_table").isNotNull())


def filter_rows(df: DataFrame, cond: Column) -> DataFrame:
    """Keep rows where the condition is true; unknown counts as false."""
    return df.where(F.coalesce(cond, F.lit(False)))


def filter_char_length(df: DataFrame, limit: int) -> DataFrame:
    return filter_rows(df, F.length("html_table") <= limit)


def filter_token_length(df: DataFrame, limit: int) -> DataFrame:
    """Keep rows whose encoding succeeded and fits the limit."""
    return filter_rows(df, F.col("input_ids").isNotNull() & (F.size("input_ids") <= limit))


def filter_encodable(df: DataFrame, limit: int) -> DataFrame:
    """Drop encoding failures, then over-long rows; the token columns do not survive."""
    fits = filter_token_length(df.where(F.col("error").isNull()), limit)
    return fits.drop("input_ids", "labels", "attention_mask", "error")


def with_range_error(df: DataFrame, vocab: int) -> DataFrame:
    """Replace `error` by the encoding error or else the token-range error."""
    found = F.coalesce(F.col("error"), K.token_range_error(F.col("input_ids"), F.col("labels"), vocab))
    return once(df, "_found", found).withColumn("error", F.col("_found")).drop("_found")


def with_status(df: DataFrame, limit: int, vocab: int) -> DataFrame:
    """Label each row: empty_html, bad_tokens (with its error), too_long or valid."""
    blank = F.coalesce(H.strip(F.col("html_table")) == "", F.lit(True))
    status = (
        F.when(blank, "empty_html")
        .when(F.col("error").isNotNull(), "bad_tokens")
        .when(F.size("input_ids") > limit, "too_long")
        .otherwise("valid")
    )
    labelled = once(with_range_error(df, vocab), "status", status)
    # a row skipped for its empty html is never encoded, so it has no error either
    return labelled.withColumn("error", F.when(F.col("status") == "bad_tokens", F.col("error")))


def safe_filter(df: DataFrame, limit: int, vocab: int) -> DataFrame:
    """Rows that have html, encode into the vocabulary and fit the length limit."""
    return with_status(df, limit, vocab).where(F.col("status") == "valid").drop("status", "error")


def nonblank(df: DataFrame, *names: str) -> DataFrame:
    """Drop rows where any of the columns is null or blank."""
    for name in names:
        df = filter_rows(df, H.strip(F.col(name)) != "")
    return df


def ocr_status(text: Column) -> Column:
    """success or error, by the literal prefix convention of OCR results."""
    return F.when(F.startswith(text, F.lit("Error")), "error").otherwise("success")


def audit_clamped(df: DataFrame, vocab: int, specials, lo: int, hi: int, enforce: bool = True) -> DataFrame:
    """One row (n_rows, n_bad); with `enforce`, computing it fails when an id is out of range."""
    bad = K.outside_after_clamp(F.col("input_ids"), vocab, specials, lo, hi) | K.outside_after_clamp(
        F.col("labels"), vocab, specials, lo, hi, ignore=K.IGNORE)
    audit = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.coalesce(bad, F.lit(False))).alias("n_bad"))
    if not enforce:
        return audit
    fail = F.raise_error(F.format_string("%d rows hold token ids outside the vocabulary", F.col("n_bad")))
    return audit.select("n_rows", F.when(F.col("n_bad") > 0, fail.cast("bigint")).otherwise(F.col("n_bad")).alias("n_bad"))


def require_non_empty(df: DataFrame, what: str = "dataset") -> DataFrame:
    """Stop the job when nothing is left (reads until the first row only)."""
    if df.isEmpty():
        raise ValueError(f"{what} is empty after filtering")
    return df
