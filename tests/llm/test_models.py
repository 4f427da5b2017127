import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmill.llm import language_model as L, quality_rank as R, quality_rules as Q
from gridmill.llm.queries import QUERIES
from tests.llm.helpers import ODD, docs, prose

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("order", [1, 2, 3])
def test_language_model_against_plain_counts(spark, order):
    rng = random.Random(order)
    texts = ODD[:6] + [prose(rng, rng.randrange(1, 60), 25) for _ in range(60)]
    table = docs(spark, texts + texts[6:8]).withColumn("held", F.col("doc_id") % 4 == 1).withColumn("key", F.lit("x")).repartition(3)
    rows = {r["key"]: r for r in L.score(table, "held", order=order).collect()}
    words = {r["doc_id"]: (r["text"] or "").encode().lower().split() + [None] for r in table.collect()}
    train = [w for d, w in words.items() if d % 4 != 1]
    counts = [Counter() for _ in range(order)]
    for w in train:
        padded = ["<s>"] * (order - 1) + w
        for i in range(order - 1, len(padded)):
            for k in range(order):
                counts[k][tuple(padded[i - k:i + 1])] += 1
    n, v, n_docs = sum(map(len, train)), len(counts[0]), len(train)
    model = L.Model(n, n_docs, v)
    packed = L.store(L.blocks(table.select(F.col("doc_id").alias("key"), "held", "text")), "t")
    totals = L.store(L.counted(packed, order), "t")
    L.learned(L.store(L.with_counts(packed, totals, order), "t"), model, order)
    for d, w in words.items():
        padded, base, score = ["<s>"] * (order - 1) + w, 0.0, 0.0
        for i in range(order - 1, len(padded)):
            base += math.log10((counts[0][(padded[i],)] + 1) / (n + v + 1))
            p = 1 / (v + 1)
            for k in range(order):
                context = tuple(padded[i - k:i])
                seen = n if k == 0 else n_docs if context[-1] == "<s>" else counts[k - 1][context]
                share = model.weights[k][int(seen).bit_length()] if seen else 0.0
                ml = counts[k][tuple(padded[i - k:i + 1])] / seen if seen else 0.0
                p = share * ml + (1 - share) * p
            score += math.log10(p)
        r = rows[d]
        assert (r["n_tokens"], r["train_tokens"]) == (len(w), n)
        assert r["n_known"] == sum(counts[0][(x,)] > 0 for x in w)
        assert abs(r["base_score"] - base) < 1e-9 * max(1, abs(base))
        assert abs(r["score"] - score) < 1e-9 * max(1, abs(score))
    assert all((w >= 0).all() and (w <= 1).all() for w in model.weights)


def test_language_model_is_better_than_its_base_on_held_out_text(spark):
    rows = QUERIES["op7_language_model"](spark, FOLDER).where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert rows[1] > rows[0]


def test_language_model_without_training_rows(spark):
    rows = L.score(docs(spark, ["a b", None]).withColumn("h", F.lit(True)), "h").collect()
    assert sorted((r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in rows) == [(1, 0, 0, 0), (3, 0, 0, 0)]
    assert L.score(docs(spark, []).withColumn("h", F.lit(True)), "h").collect() == []


def test_packed_numbers():
    for x in ([], [0], [1, 300, 2 ** 40], list(range(1000))):
        assert L.unpack(L.pack(np.array(x, np.uint64))).tolist() == x == L.unpack(L.pack(np.array(x, np.uint64), True), True).tolist()


def plain_statistics(text):
    import re
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    inside = {j for i in range(len(w) - 7) if seen[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside))


def junk(rng):
    return " ".join(w + rng.choice(["###", "***"]) for w in prose(rng, 60).split())


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(9)
    texts = [prose(rng, 60) if i % 4 else junk(rng) for i in range(600)] + ODD
    table = docs(spark, texts)
    labels = table.where("doc_id < 500").select("doc_id", F.when(F.col("doc_id") % 4 == 0, 0).otherwise(1).alias("quality"),
                                                F.lit(0).alias("toxic"))
    return table, labels


def test_ranker_on_unseen_rows(spark, labelled):
    table, labels = labelled
    noise = spark.createDataFrame([(None, 1, 0), (3, 0, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    ranker = R.learn(table, labels.union(noise).union(labels))
    out = R.with_score(table.withColumn("features", F.lit(1)), ranker).collect()
    assert len(out) == table.count() and all(0 <= r["score"] <= 1 for r in out)
    new = [r for r in out if 500 <= r["doc_id"] < 600]
    assert all((r["score"] >= R.CUT) == (r["doc_id"] % 4 != 0) for r in new)
    assert R.with_score(table.limit(0), ranker).collect() == []


def test_ranker_with_one_label_or_none(spark, labelled):
    table, labels = labelled
    assert R.learn(table, labels.where("quality = 1")) == 1.0
    assert R.learn(table, labels.limit(0)) == 0.5
    assert {r["score"] for r in R.with_score(table, 0.5).collect()} == {0.5}


def test_ranking_query_on_held_out_labels(spark):
    scored = QUERIES["op6_quality_rank"](spark, FOLDER).where("held_out")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    right = scored.join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0]
    assert right >= 0.8


def test_pairwise_loss_against_a_plain_optimiser():
    """Newton's weights have the loss that plain gradient descent over the listed pairs ends at."""
    rng = np.random.default_rng(7)
    y = (rng.random(80) < 0.6).astype(int)
    x = rng.normal(size=(80, 4)) + y[:, None] * np.array([1.0, -0.5, 0.2, 0.0])
    ranker = R.Ranker(x, y, opponents=3, penalty=0.05)
    z = ranker.expand(x)
    good, bad = [i for i in range(80) if y[i]], [i for i in range(80) if not y[i]]
    many, few = (good, bad) if len(good) >= len(bad) else (bad, good)
    pairs = [(m, few[(k * 3 + j) % len(few)]) for k, m in enumerate(many) for j in range(3)]
    wins = [(a, b) if many is good else (b, a) for a, b in pairs]
    d = np.array([z[a] - z[b] for a, b in wins])
    loss = lambda w: np.log1p(np.exp(-(d @ w))).mean() + 0.05 * (w @ w) / 2
    w = np.zeros(z.shape[1])
    for _ in range(20_000):
        w -= 0.3 * (-(d / (1 + np.exp(d @ w))[:, None]).mean(axis=0) + 0.05 * w)
    assert abs(loss(ranker.weights) - loss(w)) < 1e-9 and np.allclose(ranker.weights, w, atol=1e-4)


def test_the_order_of_stored_rows_does_not_matter(spark, labelled):
    table, labels = labelled
    one = R.learn(table.repartition(1), labels)
    two = R.learn(table.repartition(7, "text"), labels.repartition(5).union(spark.createDataFrame([(1, 2, 0), (601, 5, 0)], labels.schema)).where(
        "doc_id <> 1 OR quality = 2"))
    three = R.learn(table.repartition(7, "text").where("doc_id <> 1"), labels.where("doc_id <> 1"))
    assert np.array_equal(two.weights, three.weights)
    assert np.array_equal(one.weights, R.learn(table.repartition(5, "text"), labels.repartition(3)).weights)


def test_mixture_weights_against_a_plain_em(spark):
    """Expectation-maximisation, token by token, over counts from which each training token is taken out."""
    rng = random.Random(11)
    texts = [prose(rng, rng.randrange(1, 80), 12) for _ in range(80)]
    table = docs(spark, texts).withColumn("held", F.col("doc_id") % 5 == 1)
    packed = L.store(L.blocks(table.select(F.col("doc_id").alias("key"), "held", "text")), "t")
    totals = L.store(L.counted(packed, 2), "t")
    train = [t.split() + [None] for i, t in enumerate(texts) if i % 5 != 1]
    n, uni = sum(map(len, train)), Counter(w for t in train for w in t)
    model = L.learned(L.store(L.with_counts(packed, totals, 2), "t"), L.Model(n, len(train), len(uni)), 2)
    pairs = Counter(p for t in train for p in zip(["<s>", *t], t))
    uni_of = lambda w: len(train) if w == "<s>" else uni[w]

    def weights(rows, binned):
        """rows: (bucket, own estimate, estimate below); the jobs keep the ratio of both in bins of an eighth of an octave."""
        found = {b: 0.5 for b, *_ in rows}
        place = lambda r: 2 ** ((math.floor((math.log2(r) + 40) * 8 + 1) - 0.5) / 8 - 40) if r and binned else r
        ratios = [(b, place(own / below)) for b, own, below in rows]
        for _ in range(L.ROUNDS):
            sums = {b: [0.0, 0] for b in found}
            for b, ratio in ratios:
                sums[b][0] += found[b] * ratio / (found[b] * ratio + 1 - found[b])
                sums[b][1] += 1
            found = {b: s / k for b, (s, k) in sums.items()}
        return found

    first, second = [], []
    for t in train:
        for w in t:
            first.append(((n - 1).bit_length(), (uni[w] - 1) / (n - 1), 1 / (len(uni) + 1)))
    lower = weights(first, True)
    for t in train:
        for a, w in zip(["<s>", *t], t):
            context, share = uni_of(a) - 1, lower[(n - 1).bit_length()]
            if context > 0:
                below = share * (uni[w] - 1) / (n - 1) + (1 - share) / (len(uni) + 1)
                second.append((context.bit_length(), (pairs[a, w] - 1) / context, below))
    for k, rows in enumerate((first, second)):
        exact = weights(rows, False)
        for bucket, value in weights(rows, True).items():
            assert abs(model.weights[k][bucket] - value) < 1e-6
            assert abs(exact[bucket] - value) < 0.05  # what the bins change
