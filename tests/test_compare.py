"""Stages compared: what is scored, and that nothing else changes."""

from pyspark.sql import functions as F

from gridmill import schema as S
from gridmill.functions import html as H
from gridmill.operators import pairing as J, teds as E
from gridmill.plans import flows
from gridmill.sources import derived as D
from gridmill.sources.work import stage

A = "<table><tr><td>a</td><td>b</td></tr></table>"
B = A.replace(">b<", ">c<")
ODD = "sample_id long, stage string, pred_html string, error string"
PREDS = [(0, "pre", B, None), (0, "post", A, None), (1, "pre", None, "boom"), (1, "post", A, None), (2, "post", "none", None),
         (3, "pre", B, None), (3, "pre", A, None), (3, "pre", A, None), (3, "post", B, None), (4, "pre", A, "late"), (4, "post", A, None),
         (5, "other", A, None), (6, "pre", "", None), (6, "post", f"```html\n{A}\n```", None), (8, "pre", A, None), (8, "post", B, None),
         (None, "pre", A, None), (None, "post", A, None), (9, "pre", A.replace("<td>a", "<td colspan='x'>a"), None), (9, "post", A, None)]
TRUTH = [(i, "train", A, b"i") for i in (0, 1, 2, 3, 4, 5, 6, 7, 9)]


def test_only_what_was_made_is_scored_and_the_deltas_stay(spark, monkeypatch):
    staged = {}
    monkeypatch.setattr(E, "stage", lambda df, name: staged.setdefault(name, stage(df, name)))
    truth, preds = spark.createDataFrame(TRUTH, S.SAMPLES), spark.createDataFrame(PREDS, ODD)
    made = flows.compare_stages(truth, preds, "pre", "post").collect()
    pairs = sorted((r.sample_id, r.stage) for r in staged["pairs"].collect())
    assert pairs == sorted((r[0], r[1]) for r in PREDS if r[0] in {t[0] for t in TRUTH} and r[1] != "other" and r[2] is not None and r[3] is None)
    staged.clear()
    scored = E.eval_table(truth, preds, ["pre", "post"])
    want = J.compare_stages(preds, "pre", "post").join(J.score_delta(scored, "pre", "post"), "sample_id", "left")
    assert sorted(made, key=repr) == sorted(want.collect(), key=repr)
    assert {r.sample_id: r.score_delta for r in made} == {
        0: .25, 1: None, 2: None, 3: -.25, 4: None, 5: None, 6: 1, 8: None, 9: None, None: None}


def test_hot_samples_are_dealt_out(spark):
    rows = [(i % 3 and i, "pre" if i % 2 else "post", B if i % 5 else A, None) for i in range(600)]
    truth, preds = spark.createDataFrame([(i, "train", A, b"i") for i in range(600)], S.SAMPLES), spark.createDataFrame(rows, ODD)
    keep = lambda df: sorted((r.sample_id, r.stage, r.teds_full) for r in df.collect())
    assert keep(E.score_made(truth, preds, ["pre", "post"], min_hot=20)) == sorted((i, s, 1.0 if t == A else .75) for i, s, t, _ in rows)


def test_bare_tables_are_clean(spark):
    texts = [A, A + " ", " " + A, "<table", "</table>", "<table</table>", "<TABLE></table>", "<table>x</table>```", "<table></body></table>", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", H.clean_html(F.col("t")).alias("c")).collect()}
    assert [got[i] for i in range(len(texts))] == [A, A, A, *texts[3:7], "<table>x</table>", "<table></body></table>", "", None]


def test_words_for_spans_without_a_value_need_no_tree(spark):
    texts = ["<table><tr><td>colspan</td></tr></table>", "<table><tr><td colspan=2>a</td></tr></table>", "<table><tr><td colspan>=</td></tr></table>"]
    df = spark.createDataFrame([(i, t, t) for i, t in enumerate(texts)], "sample_id long, t string, p string")
    assert {r.sample_id for r in E._settled(df, "t", "p", "full", None).where("truth IS NOT NULL").collect()} == {1, 2}
    assert [(r.teds_full, r.score_error) for r in E.score_pairs(df, "t", "p").collect()] == [(1, None)] * 3


def test_derived_tables_follow_their_lines(spark, tmp_path):
    texts = ["", "\n", "a\n", "\na", "a\r\nb c\n\nd", "<td>x\n<tr>", None, "é\n漢\n", "x" * 300, "one\ntwo\nthree\nfour\nfive"]
    docs = [(k, texts[k % len(texts)]) for k in range(200)] + [(None, "a\nb")]
    orders = [(k, (None, 7)[k % 3 > 0], (None, "O")[k % 4 > 0]) for k in range(200)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(str(tmp_path / "orders.parquet"))
    want = {}
    cells = lambda i, k, c, s: [x for x in (None if c is None else str(c + i), str((k * 7 + i * 3) % 50), s) if x is not None]
    sources = [(3 * k, k, "", None if t is None else [[x] for x in t.split("\n")]) for k, t in docs if k is not None]
    sources += [(3 * k + 1, k, D.HEAD, [cells(i, k, c, s) for i in range(1, k % 6 + 2)]) for k, c, s in orders]
    table = lambda head, rows: f"<table>{head}{''.join('<tr><td>' + '</td><td>'.join(r) + '</td></tr>' for r in rows)}</table>"
    for at, k, head, rows in sources:
        same = None if rows is None else table(head, rows)
        pre = same and [same, table(head, rows[:max(len(rows) - 1 - k % 3, 0)]), same.replace("<td>", "<td>9", 1),
                        same.replace("<td>", '<td colspan="2">', 1), None][k % 5]
        for name, text in (("pre", pre), ("post", same if k % 5 != 4 else None)):
            if k % 13 != 5 and not (k % 11 == 3 and name == "pre"):
                want[at, name] = text
    got = {(r.sample_id, r.stage): r.pred_html for r in D.predictions(spark, str(tmp_path)).where("sample_id IS NOT NULL").collect()}
    assert got == want
