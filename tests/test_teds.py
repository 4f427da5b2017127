import pytest
from pyspark.sql import functions as F

from gridmill import schema as S
from gridmill.operators import teds as E

A = "<table><tr><td>a</td><td>b</td></tr></table>"


def pairs(spark, rows):
    return spark.createDataFrame([(i, t, p) for i, (t, p) in enumerate(rows)], "sample_id long, t string, p string")


def test_scores(spark):
    rows = [(A, A), (A, None), (A, "  "), (A, "<div>no</div>"), (None, A), (A, A.replace(">b<", ">c<")),
            (A, "```html\n" + A + "\n```"), (A, A.replace("<td>a", "<td colspan='2'>a")), (A, A.replace("<td>a", "<td colspan='x'>a")),
            (A, "<table></table>"), (A + A, A)]
    out = {r.sample_id: r for r in E.score_pairs(pairs(spark, rows), "t", "p").collect()}
    got = {i: (r.teds_structure, r.teds_full) for i, r in out.items() if i != 8}
    assert got == {0: (1, 1), 1: (0, 0), 2: (0, 0), 3: (0, 0), 4: (0, 0), 5: (1, .75), 6: (1, 1), 7: (.75, .75),
                   9: (.25, .25), 10: (1, 1)}
    assert out[8].teds_full is None and out[8].score_error.startswith("parse_failed")


def test_cleaning_is_a_choice(spark):
    df = pairs(spark, [("  " + A, A + "\n"), (A, "<html>" + A + "</html>")])
    for clean in ("full", "strip", "none"):
        assert [r.teds_full for r in E.score_pairs(df, "t", "p", clean).orderBy("sample_id").collect()] == [1, 1]


def test_equal_texts_obey_the_same_rules(spark):
    bad = A.replace("<td>a", "<td colspan='x'>a")
    rows = [(t, t) for t in ("<tablet>x", "<!-- <table> -->", A, bad, "<table/>")]
    out = [(r.teds_full, r.score_error) for r in E.score_pairs(pairs(spark, rows), "t", "p").orderBy("sample_id").collect()]
    assert [x[0] for x in out] == [0, 0, 1, None, 1] and out[3][1].startswith("parse_failed")


def test_policies(spark):
    truth = spark.createDataFrame([(i, "train", A, b"i") for i in range(4)], S.SAMPLES)
    preds = spark.createDataFrame([(0, "s", A, None), (1, "s", None, "boom"), (2, "s", A.replace(">b<", ">c<"), None)], S.PREDICTIONS)
    scored = E.eval_table(truth, preds, ["s"])
    rows = {r.sample_id: (r.teds_full, r.error) for r in scored.collect()}
    assert rows == {0: (1.0, None), 1: (None, "boom"), 2: (.75, None), 3: (None, "no prediction")}
    zero = E.average_scores(scored, []).first()
    skip = E.average_scores(scored, [], "skip").first()
    assert (zero.avg_full, zero.n_evaluated) == (1.75 / 4, 4) and (skip.avg_full, skip.n_evaluated) == (.875, 2)
    none = E.average_scores(scored.where("error is not null"), [], "skip").first()
    assert (none.avg_full, none.n_evaluated) == (0.0, 0)
    by = {r.stage: (r.n_evaluated, r.avg_full) for r in E.eval_by_stage(truth, preds, ["s", "t"]).collect()}
    assert by == {"s": (4, 1.75 / 4), "t": (4, 0.0)}


def test_blank_pairs_may_be_left_out(spark):
    truth = spark.createDataFrame([(0, "train", A, b"i"), (1, "train", A, b"i"), (2, "train", " \n", b"i"), (3, "train", A, b"i")], S.SAMPLES)
    preds = spark.createDataFrame([(0, "s", A, None), (1, "s", "```html\n ```", None), (2, "s", A, None), (3, "s", "text", None)], S.PREDICTIONS)
    rows = {r.sample_id: (r.teds_full, r.error) for r in E.eval_table(truth, preds, ["s"], blank="skip").collect()}
    assert rows == {0: (1.0, None), 1: (None, "blank"), 2: (None, "blank"), 3: (0.0, None)}
    mean = lambda policy, **k: (lambda r: (r.avg_full, r.n_evaluated))(E.eval_by_stage(truth, preds, ["s"], policy, **k).first())
    assert mean("skip", blank="skip") == (0.5, 2) and mean("skip") == (0.25, 4) and mean("zero", blank="skip") == (0.25, 4)


@pytest.mark.parametrize("tasks", [None, 3])
def test_shred(spark, tasks):
    df = spark.createDataFrame([(1, A), (2, None), (3, "x")], "sample_id long, html_table string")
    rows = E.shred_table(df, tasks=tasks).orderBy("node_id").collect()
    assert [(r.sample_id, r.node_id, r.parent, r.depth, r.tag, r.text) for r in rows] == [
        (1, 0, -1, 0, "table", None), (1, 1, 0, 1, "tr", None), (1, 2, 1, 2, "td", "a"), (1, 3, 1, 2, "td", "b")]
    assert E.shred_table(df.select(F.col("sample_id"), "html_table")).columns == ["sample_id", *S.NODE.names]


def test_shred_reads_what_scoring_refuses(spark):
    deep = "<table>" + "<div>" * 3000 + "<tr><td colspan='x' rowspan='2'>a<b>c</b></td></tr></table>"
    df = spark.createDataFrame([(1, deep)], "sample_id long, html_table string")
    rows = E.shred_table(df).orderBy(F.desc("node_id")).collect()
    assert len(rows) == 3003
    assert (rows[0].tag, rows[0].colspan, rows[0].rowspan, rows[0].text) == ("td", None, 2, "a<b>c</b>")
    out = E.score_pairs(pairs(spark, [(deep, A), (A.replace(">a", " colspan='2'>a"), deep.replace("'x'", "'1'"))]), "t", "p").collect()
    assert out[0].score_error.startswith("parse_failed") and out[0].teds_full is None
    assert out[1].score_error is None and 0 < out[1].teds_full < 0.01


def test_deep_and_broken_tables(spark):
    deep = lambda n, t: "<table>" + "<div>" * n + f"<tr><td>{t}</td></tr></table>"
    broken = '<td a="' * 8000 + "'>" * 3
    rows = [(deep(2000, "a"), deep(2000, "a") + " "), (deep(2000, "a"), deep(2000, "b")), (deep(2000, "a"), deep(1999, "a")),
            (A, "<table>" + broken), (A, "<table>" + "<td" * 20000), (A, "<table>" + "<!--" * 20000 + ">")]
    out = [(r.teds_full, r.score_error) for r in E.score_pairs(pairs(spark, rows), "t", "p").orderBy("sample_id").collect()]
    assert [x[1] for x in out] == [None] * 6
    assert [round(x[0] * 2003, 6) for x in out[:3]] == [2003, 2002, 2002]
