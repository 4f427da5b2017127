"""Cleaning and validation rules at their edges."""

import random
import re

import pytest
from pyspark.sql import functions as F

from gridmill import schema as S
from gridmill.functions import html as H
from gridmill.operators import curate as C, reports as R

TABLE = "<table><tr><td>1</td></tr></table>"


def slow_clean(text):
    """The rule as stated: strip, then one wrapper after the other, then strip."""
    if not text:
        return text
    text = text.strip()
    for pattern, flags in ((r"^```(?:html)?\s*", re.I), (r"\s*```$", 0), (r"^<html>\s*", re.I), (r"\s*</html>$", re.I),
                           (r"^<body>\s*", re.I), (r"\s*</body>$", re.I)):
        text = re.sub(pattern, "", text, flags=flags)
    return text.strip()


def apply(spark, fn, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.select(fn(F.col("v")).alias("r"), "i").orderBy("i").select("r").collect()]


def test_clean_is_the_stepwise_rule(spark):
    rng = random.Random(11)
    pieces = ["```", "```html", "```HTML", "<html>", "</html>", "<BODY>", "</body>", "</Html>", " ", "\n", "\t", " ",
              "\x1c", " ", "\x85", "`", "<html", "html>", TABLE, "x", "é", "\U0001f600", "<html lang='en'>",
              "<!DOCTYPE html>"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 9))) for _ in range(4000)]
    texts += ["", None, " ```html\n<html><body>" + TABLE + "</body></html>\n``` ", "``````", "```" * 3]
    gap = lambda n: " " * n
    for n in (40, *range(60, 100), 200):  # around the tail window
        texts += [TABLE * 3 + "</body>" + gap(n) + "</html>\n```", TABLE * 3 + gap(n), TABLE * 3 + "</body></html>" + gap(n),
                  gap(n) + TABLE + gap(n) + "</body>" + gap(n) + "</html>" + gap(n) + "```", gap(n), "x</html>" + gap(n) + "```",
                  "é" * 60 + "</body>" + gap(n // 2) + "</html>" + gap(n // 3) + "```", "\U0001f600" * n + "</html>"]
    got = apply(spark, H.clean_html, texts)
    wrong = [(t, g, slow_clean(t)) for t, g in zip(texts, got) if g != slow_clean(t)]
    assert not wrong, wrong[:3]
    stripped = apply(spark, H.strip, texts)
    assert all(s == (t.strip() if t is not None else None) for s, t in zip(stripped, texts))


@pytest.mark.parametrize("html, image, reason", [
    (None, b"i", "too_short_raw"), ("", b"i", "too_short_raw"), ("   <table>    ", b"i", "too_short_raw"),
    ("x" * 9, b"i", "too_short_raw"), ("x" * 10, b"i", "no_table"), ("<html><p>x</p></html>", b"i", "no_table"),
    ("<table></table>x" + "y" * 3, b"i", "length_out_of_range"), ("<table></table>x" + "y" * 4, b"i", None),
    ("<table></table>" + "y" * (50000 - 15), b"i", None), ("<table></table>" + "y" * (50001 - 15), b"i", "length_out_of_range"),
    ("<TABLE><tr><td>1</td></tr></Table>", b"i", None), (TABLE, None, "no_image"), (TABLE + TABLE, b"i", None),
    ("<table><tr><td>" + TABLE + "</td></tr></table>", b"i", None), ("<tablet>" + "y" * 20, b"i", "unbalanced"),
    ("<html lang='en'>" + TABLE + "</html>", b"i", None), ("<!DOCTYPE html>" + TABLE, b"i", None),
    ("```html\n" + TABLE, b"i", None), (TABLE.replace("</table>", "") + " " * 30, b"i", "unbalanced"),
])
def test_reject_reason(spark, html, image, reason):
    df = spark.createDataFrame([(1, "train", html, image)], S.SAMPLES)
    assert C.with_reject_reason(df).first()["reason"] == reason
    kept = C.filter_and_clean(df).collect()
    assert (len(kept) == 1) == (reason is None)
    if kept:
        assert kept[0]["html_table"] == slow_clean(html) and kept[0].asDict().keys() == set(S.SAMPLES.names)
    report = R.filter_report(df).first()
    assert (report["kept"], report["removed"]) == ((1, 0) if reason is None else (0, 1))


def test_empty_table_reports(spark):
    empty = spark.createDataFrame([], S.SAMPLES)
    assert R.filter_report(empty).count() == 0 and R.split_report(empty).count() == 0
    with pytest.raises(ValueError):
        C.require_non_empty(empty)


def test_truncate_and_tiers(spark):
    assert apply(spark, lambda c: H.truncate_html(c, 4), ["abcd", "abcde", "äöüßé", None]) == ["abcd", "abcd...", "äöüß...", None]
    tiers = spark.range(10).select(H.tier_limit(F.col("id")).alias("n")).collect()
    assert [r.n for r in tiers] == [4000] * 4 + [6000] * 4 + [8000] * 2


def test_names(spark):
    paths = ["/a/b.PNG", "c.tar.gz", "/a.b/c", "/x/.png", "d.jpeg", "/e/f."]
    assert apply(spark, H.path_suffix, paths) == [".png", ".gz", "", "", ".jpeg", ""]
    assert apply(spark, H.path_stem, paths) == ["b", "c.tar", "c", ".png", "d", "f."]
    assert apply(spark, lambda c: H.sample_file(F.length(c), ".html"), ["a", "a" * 12, "a" * 123]) == [
        "sample_01.html", "sample_12.html", "sample_123.html"]
    assert apply(spark, H.error_type, ["A: b: c", "plain", None]) == ["A", "plain", None]


def test_unknown_filters_are_false(spark):
    df = spark.createDataFrame([(1, "train", None, None), (2, "train", "abc", None)], S.SAMPLES)
    assert [r.sample_id for r in C.filter_char_length(df, 3).collect()] == [2]
    assert [r.sample_id for r in C.nonblank(df, "html_table").collect()] == [2]
