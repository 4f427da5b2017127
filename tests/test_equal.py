"""Equal texts and near copies: what scoring settles without trees, and what long texts cost."""

import time

import pytest

from gridmill.functions import tree as X
from gridmill.operators import teds as E

A = "<table><tr><td>a</td><td>b</td></tr></table>"


def test_equal_readable_texts_send_no_html_to_python(spark):
    spans = ["<table><tr><td colspan='x'>a</td></tr></table>", "<table><tr><td COLſPAN='x'>a</td></tr></table>", "<table><tr><td rowspan=2>a</td></tr></table>"]
    texts = [A, *spans, "<tablet>x", "<!-- <table> -->", "<table/>", "<table>"]
    df = spark.createDataFrame([(i, t, t) for i, t in enumerate(texts)], "sample_id long, t string, p string")
    sent = {r.sample_id for r in E._settled(df, "t", "p", "full", None).where("truth IS NOT NULL").collect()}
    assert sent == {1, 2, 3, 4, 5, 6}
    for made in (E.score_pairs(df, "t", "p"), E.score_distinct(df, "t", "p", tasks=3)):
        for r in made.collect():
            assert (r.teds_structure, r.teds_full, r.score_error) == E._score(texts[r.sample_id], texts[r.sample_id])


def test_more_distinct_pairs_have_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(E, "TASK_PAIRS", 10)
    used = []
    monkeypatch.setattr(E, "dealt_by_cost", lambda df, costs, tasks: used.append(tasks) or df.repartition(tasks, "key"))
    df = spark.createDataFrame([(i, A, A.replace(">b<", f">c{i}<")) for i in range(95)], "sample_id long, t string, p string")
    assert E.score_distinct(df, "t", "p", tasks=2).count() == 95 and used == [10]


def test_long_near_copies_cost_little():
    text = "word " * 10_000
    trees = [X.read_table(f"<table><tr><td>{t}</td></tr></table>") for t in (text, "9" + text, text[:25_000] + "xyz" + text[25_002:])]
    start = time.process_time()
    assert X.similarity(trees[0], trees[1]) == pytest.approx(1 - 1 / 50_001 / 3)
    assert X.similarity(trees[0], trees[2]) == pytest.approx(1 - 3 / 50_001 / 3)
    assert time.process_time() - start < 1
