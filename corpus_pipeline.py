"""The corpus pipeline: stages that each apply one operator to what the stage before kept.

Every stage but the last returns the columns of documents; repeated runs give the same rows.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridmill.llm import bpe, decontaminate, quality_rules, secrets, simhash
from gridmill.llm.queries import WORD_BPE, coded_digests, table
from gridmill.sources.work import stage


def carried(docs: DataFrame, *needed: str) -> DataFrame:
    """Whole rows as one column beside what a stage works on, so that no other column's name can clash."""
    return docs.select(F.struct("*").alias("_row"), *needed)


def drop_low_quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the base rule and the learned rules keep; null and empty texts have too few words.

    Repeated rows have one verdict. An empty table stays empty; without labels the base rule alone decides.
    """
    judged = quality_rules.judge(carried(docs, "doc_id", "text"), table(spark, folder, "labels"))
    return judged.where("kept").select("_row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates, as `op1` links them.

    Of repeated rows one stays; texts that are null, empty or blank are one group; a null doc_id comes after all others. An
    empty table stays empty.
    """
    return simhash.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark.

    A null or empty text has no words and stays, repeated rows stay or go together, an empty benchmark takes nothing.
    """
    found = decontaminate.with_hits(carried(docs, "text"), table(spark, folder, "benchmark"))
    return found.where("NOT hits.contaminated").select("_row.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced and n_chars counted anew.

    A null text stays null, and its n_chars is null; repeated rows stay.
    """
    masked = secrets.redacted(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def encode(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents with their token ids (binary, unsigned 32-bit) and the digests of ids and decoded text.

    Older columns of these names are replaced.
    """
    coded = bpe.encode(carried(docs, "text"), WORD_BPE, decoded="decoded")
    added = ["ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    return coded.select(*[F.col("_row")[c].alias(c) for c in docs.columns if c not in added], "ids", *coded_digests())


STAGES = [("quality rules", drop_low_quality), ("near duplicates", drop_near_duplicates),
          ("decontamination", drop_contaminated), ("secrets", redact_secrets), ("encoding", encode)]

ORACLE_SQL = None  # the stages learn, hash and encode beyond what SQL expresses; tests use brute force


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over the whole documents table, each written as Parquet and read again."""
    docs = table(spark, folder, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, folder), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, folder)
