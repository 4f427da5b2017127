import random

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from gridmill.llm.queries import WORD_BPE
from tests.llm.helpers import DOCS, ODD, docs, prose
from tests.llm.test_filters import plain_hits, plain_spans, planted_keys
from tests.llm.test_simhash import plain_fingerprint, plain_groups


def test_stages_on_planted_cases(spark, tmp_path):
    rng = random.Random(11)
    good = [prose(rng, 80, 3000) for _ in range(40)]
    near = good[0].split()
    near[3] = "other"
    item = prose(rng, 30, 3000)
    texts = good + [good[1], " ".join(near), good[2] + " " + item, good[3] + " password = hunter2hunter2"] + ODD
    texts += [" ".join(w + "###" for w in prose(rng, 60, 3000).split()) for _ in range(40)]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(40)] + [(i, 0, 0) for i in range(len(texts) - 40, len(texts))]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    rows = {r["doc_id"]: r for r in P.run(spark, str(tmp_path)).collect()}
    left = [i for i in range(44)]
    fps = [plain_fingerprint(texts[i]) for i in left]
    left = [i for i, g in zip(left, plain_groups(fps)) if i == g]
    left = [i for i in left if not plain_hits(texts[i], [(1, item)])[3]]
    assert sorted(rows) == left and 42 not in left and 40 not in left
    tool = Tokenizer.from_file(WORD_BPE)
    for i, r in rows.items():
        assert np.frombuffer(r["ids"], "<u4").tolist() == tool.encode(r["text"], add_special_tokens=False).ids
        assert r["n_chars"] == len(r["text"]) and r["n_tokens"] == len(r["ids"]) // 4
        assert ("hunter2" in texts[i]) == bool(plain_spans(texts[i])) == ("[SECRET]" in r["text"])


def test_no_part_of_a_private_key_is_left(spark, tmp_path):
    rng = random.Random(12)
    keys = list(planted_keys(rng))[::5]
    texts = [f"{prose(rng, 60, 3000)} {key} {prose(rng, 60, 3000)}" for key, _ in keys] + [prose(rng, 80, 3000) for _ in range(20)]
    texts += [" ".join(w + "###" for w in prose(rng, 60, 3000).split()) for _ in range(20)]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i < len(texts) - 20), 0) for i in range(len(texts))]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(rng, 30, 3000))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = {r["doc_id"]: r for r in P.run(spark, str(tmp_path)).collect()}
    tool = Tokenizer.from_file(WORD_BPE)
    for i, (key, body) in enumerate(keys):
        text = rows[i]["text"]
        assert "[SECRET]" in text and "PRIVATE KEY" not in text and not any(b[:8] in text or b[-8:] in text for b in body)
        assert np.frombuffer(rows[i]["ids"], "<u4").tolist() == tool.encode(text, add_special_tokens=False).ids


def test_each_stage_takes_odd_tables(spark):
    folder = "/root/testdata/sf0.001"
    odd = docs(spark, ODD + ODD[:3]).union(spark.createDataFrame([(None, "a b", None, None, None)] * 2, DOCS))
    odd = odd.withColumn("stats", F.lit(1)).withColumn("kept", F.lit("no")).withColumn("hits", F.lit(2)).withColumn("ids", F.lit(3))
    for k, (name, step) in enumerate(P.STAGES):
        for table in (odd, odd.limit(0)):
            out = step(spark, table, folder)
            rows = out.collect()
            assert len(rows) <= table.count()
            if k < len(P.STAGES) - 1:
                assert out.columns == table.columns
            if name in ("secrets", "encoding"):
                assert len(rows) == table.count()
