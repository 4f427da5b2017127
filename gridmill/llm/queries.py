"""The registered queries of the numbered operators."""

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridmill.llm import (bpe, conversations, decontaminate, language_model, merkle, oracle, quality_rank, quality_rules, secrets, simhash,
                          token_counts, token_files, url_filter, warc)
from gridmill.sources.work import fresh_path

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op2_token_counts(spark: SparkSession, folder: str, limit: int = 2048) -> DataFrame:
    docs = table(spark, folder, "documents").select(
        "doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    counted = token_counts.with_prefix_counts(docs, WORD_BPE).select(
        "doc_id", "n_bytes", token_counts.n_tokens("prefix_tokens").alias("n_tokens"),
        token_counts.words_within("prefix_tokens", limit).alias("words_within_limit"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op3_token_files(spark: SparkSession, folder: str, end_id: int = 2) -> DataFrame:
    out = fresh_path(spark, "token_files")
    token_files.write_token_table(table(spark, folder, "documents"), out, BYTE_BPE, end_id)
    read = token_files.read_token_table(spark, out)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


# The rules of the contract.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"),
             ("block", "net/fr/")]


def op4_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    return url_filter.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op5_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.with_secrets(table(spark, folder, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(r.kind) for r in secrets.BASE_RULES],
                        F.sha2(secrets.digest(base), 256).alias("base_sha256"),
                        secrets.digest(F.col("secrets")).alias("spans"))


def _in_fold(fold: int, of: int) -> Column:
    """Whether a document is held out, by the crc32 of its doc_id as text."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % of == fold, F.lit(False)).alias("held_out")


def op6_quality_rank(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", _in_fold(0, 5), "text")
    labels = table(spark, folder, "labels").where(~_in_fold(0, 5)).select("doc_id", "quality")
    scored = quality_rank.with_score(docs, quality_rank.learn(docs, labels))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= quality_rank.CUT).cast("int").alias("predicted"))


def op7_language_model(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", _in_fold(2, 7), "text")
    return language_model.score(docs, "held_out").withColumnRenamed("key", "doc_id")


def coded_digests() -> list[Column]:
    return [F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
            F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")]


def op8_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return bpe.encode(docs, WORD_BPE, decoded="decoded").select("doc_id", *coded_digests())


def op9_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontaminate.with_hits(docs, table(spark, folder, "benchmark"))
    return found.select("doc_id", "hits.n_words", "hits.n_hit", F.size("hits.items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"), "hits.contaminated")


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))
    counts = [F.col("stats")[c].alias(c) for c in quality_rules.COUNTS]
    return judged.select("doc_id", *counts, quality_rules.base_failed().alias("base_failed"), "kept")


def op11_warc(spark: SparkSession, folder: str) -> DataFrame:
    out = fresh_path(spark, "archives")
    warc.write_archives(table(spark, folder, "pages").select("page_id", "url", "html"), out)
    return warc.read_pages(spark, out, payload=False).select(
        F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"),
        F.col("refers_to").cast("long").alias("refers_to"))


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    leaf = lambda n_chars: merkle.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))
    tampered = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    more = F.col("n_chars").cast("decimal(20)") + 1
    made = merkle.manifest(docs, "lang", "doc_id", leaf(F.col("n_chars")), F.when(tampered, leaf(more)))
    return made.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("siblings", ""), 256).alias("proof_sha256"),
                       "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return conversations.audit(conversations.damaged(rows)).withColumnRenamed("conv", "conv_id")


QUERIES = {f.__name__: f for f in (
    op1_simhash, op2_token_counts, op3_token_files, op4_url_filter, op5_secrets, op6_quality_rank, op7_language_model,
    op8_bpe, op9_decontaminate, op10_quality_rules, op11_warc, op12_merkle_manifest,
    op13_conversation_repair)}
ORACLE = oracle.ORACLE
