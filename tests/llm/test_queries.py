"""The registered queries over odd tables, all contract columns, against plain Python."""

import zlib
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridmill.llm import quality_rank, quality_rules
from gridmill.llm.queries import QUERIES
from tests.llm.helpers import DOCS, ODD, docs, prose
from tests.llm.test_filters import SECRETS, plain_spans
from tests.llm.test_models import plain_statistics
from tests.llm.test_simhash import plain_fingerprint, plain_groups

WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with odd and repeated texts, a null key and clashing columns, and labels for some of them."""
    import random
    rng = random.Random(21)
    texts = ODD + SECRETS + [prose(rng, rng.randrange(3, 300)) for _ in range(60)]
    texts += [prose(rng, 9, 3) + " ###!! $$" for _ in range(20)] + [texts[-1], "long " * 3000]
    path = str(tmp_path_factory.mktemp("tables"))
    table = docs(spark, texts).withColumn("_text", F.lit("x")).withColumn("fp", F.lit(1)).withColumn("stats", F.lit("s"))
    table.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(len(texts) - 5)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, dict(enumerate(texts))


def rows(spark, name, folder, *columns):
    got = QUERIES[name](spark, folder)
    assert got.columns[:len(columns)] == list(columns)
    found = {r["doc_id"]: tuple(r)[1:len(columns)] for r in got.collect()}
    return found


def test_op1(spark, folder):
    path, texts = folder
    got = rows(spark, "op1_simhash", path, "doc_id", "fingerprint", "component_id")
    fps = [plain_fingerprint(t) for t in texts.values()]
    assert got == {i: (f"{f:016x}", g) for i, (f, g) in enumerate(zip(fps, plain_groups(fps)))}


def test_op2(spark, folder):
    path, texts = folder
    tool = Tokenizer.from_file(WORDS)
    got = QUERIES["op2_token_counts"](spark, path)
    found = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got.collect()}
    want = {}
    for i, t in texts.items():
        n = len(tool.encode(t or "", add_special_tokens=False).ids)
        want[i] = (len((t or "").encode()), n, n > 2048)
    assert found == want and any(x[2] for x in want.values())


def test_op5(spark, folder):
    path, texts = folder
    got = rows(spark, "op5_secrets", path, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    for i, t in texts.items():
        spans = [x[2] for x in plain_spans(t)]
        base = [s for s in spans if s.split(":")[0] in ("assign", "access", "hex")]
        kinds = [sum(s.startswith(k + ":") for s in base) for k in ("assign", "access", "hex")]
        assert got[i] == (*kinds, sha256(",".join(base).encode()).hexdigest(), ",".join(spans))


def test_op6(spark, folder):
    path, texts = folder
    got = rows(spark, "op6_quality_rank", path, "doc_id", "held_out", "score", "predicted")
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    table, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    ranker = quality_rank.learn(table, labels.where(~F.col("doc_id").isin([i for i in texts if held(i)])))
    scores = ranker.score(np.array([quality_rank.features(t) for t in texts.values()]))
    assert got == {i: (held(i), pytest.approx(float(s), abs=1e-12), int(s >= 0.3)) for i, s in enumerate(scores)}
    flipped = labels.withColumn("quality", F.when(F.col("doc_id").isin([i for i in texts if held(i)]), 1 - F.col("quality")).otherwise(F.col("quality")))
    flipped.write.mode("overwrite").parquet(f"{path}/other/labels.parquet")
    table.write.mode("overwrite").parquet(f"{path}/other/documents.parquet")
    assert rows(spark, "op6_quality_rank", f"{path}/other", "doc_id", "held_out", "score", "predicted") == got  # held-out labels are not seen


def test_op8(spark, folder):
    path, texts = folder
    tool = Tokenizer.from_file(WORDS)
    got = rows(spark, "op8_bpe", path, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    for i, t in texts.items():
        ids = tool.encode(t or "", add_special_tokens=False).ids
        decoded = tool.decode(ids, skip_special_tokens=False)
        assert got[i] == (len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256(decoded.encode()).hexdigest())


def holds(condition, value):
    return value > condition.cut if condition.above else value <= condition.cut


def test_op10(spark, folder):
    """Counts by plain statistics, the verdict by walking through the learned rules in their order."""
    path, texts = folder
    columns = ("doc_id", *quality_rules.COUNTS, "base_failed", "kept")
    got = rows(spark, "op10_quality_rules", path, *columns)
    table, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    rules = quality_rules.learn(quality_rules.labelled_sample(table, labels))
    for i, t in texts.items():
        n, chars, symbols, lines, repeat = counts = plain_statistics(t)
        words = (t or "").encode().split()
        every = [x for x in (t or "").split("\n") if x.encode().split()]
        share = lambda a, b: a / b if b else 0.0
        values = {"n_words": n, "word_length": share(chars, n), "symbol_share": share(symbols, chars), "bang_share": share((t or "").count("!"), chars),
                  "distinct_share": share(len(set(words)), n), "repeat_share": share(repeat, n), "dup_line_share": share(lines, len(every))}
        failed = n < 20 or 100 * repeat > 30 * n
        rejected = failed or any(all(holds(c, values[c.feature]) for c in rule) for rule in rules)
        assert got[i] == (*counts, failed, not rejected), i
