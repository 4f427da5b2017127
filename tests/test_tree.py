"""The comparison of two tables, against plain textbook recursions on small trees."""

import random
from functools import lru_cache

import pytest

from gridmill.functions import tree as X


def slow_text(a, b):
    @lru_cache(None)
    def d(i, j):
        if not i or not j:
            return i + j
        return min(d(i - 1, j) + 1, d(i, j - 1) + 1, d(i - 1, j - 1) + (a[i - 1] != b[j - 1]))
    return d(len(a), len(b)) / max(len(a), len(b), 1)


def slow_distance(a, b):
    def sub(x, y):
        if x[:3] != y[:3]:
            return 1.0
        return slow_text(x[3], y[3]) if x[0] == "td" else 0.0

    @lru_cache(None)
    def d(f, g):
        if not f or not g:
            return float(sum(map(X.size, f)) + sum(map(X.size, g)))
        (v, w) = f[-1], g[-1]
        return min(d(f[:-1] + v[4], g) + 1, d(f, g[:-1] + w[4]) + 1, d(v[4], w[4]) + d(f[:-1], g[:-1]) + sub(v, w))
    return d((a,), (b,))


def random_table(rng):
    cell = lambda: (rng.choice(["td", "td", "th"]), rng.choice([1, 1, 2]), 1)
    text = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(0, 3)))
    make = lambda c: (*c, text() if c[0] == "td" else "", ())
    rows = lambda: tuple(("tr", 1, 1, "", tuple(make(cell()) for _ in range(rng.randint(0, 3))))
                         for _ in range(rng.randint(0, 3)))
    if rng.random() < 0.3:
        return ("table", 1, 1, "", (("thead", 1, 1, "", rows()), ("tbody", 1, 1, "", rows())))
    return ("table", 1, 1, "", rows())


@pytest.mark.parametrize("seed", range(60))
def test_distance_is_the_textbook_distance(seed):
    rng = random.Random(seed)
    a, b = random_table(rng), random_table(rng)
    want = slow_distance(a, b)
    assert X.tree_distance(a, b) == pytest.approx(want)
    assert X.tree_distance(b, a) == pytest.approx(want)
    assert X.forest_distance([a], [b]) == pytest.approx(want)
    assert X.tree_distance(a, a) == 0.0
    bare = slow_distance(X.without_text(a), X.without_text(b))
    assert X.tree_distance(X.without_text(a), X.without_text(b)) == pytest.approx(bare)


def test_near_copies_with_shared_ends():
    rng = random.Random(7)
    for _ in range(40):
        rows = list(random_table(rng)[4]) + list(random_table(rng)[4])
        other = rows[:]
        if other and rng.random() < 0.7:
            other.pop(rng.randrange(len(other)))
        if other and rng.random() < 0.7:
            other.insert(rng.randrange(len(other)), other[0])
        a, b = (("table", 1, 1, "", tuple(r)) for r in (rows, other))
        assert X.tree_distance(a, b) == pytest.approx(slow_distance(a, b))


def test_text_distances():
    left, right = ["", "abc", ("<b>", "x", "</b>")], ["abd", "", ("<b>", "y", "</b>")]
    got = X.text_distances(left, right)
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            assert got[i, j] == pytest.approx(slow_text(a, b))


def test_reading():
    t = X.read_table("x <p>no</p><TABLE><tr><td colspan='2'>a&amp;b<b>c</b><td>d</tr><tr><th rowspan=3>h</table> <table>")
    assert t == ("table", 1, 1, "", (
        ("tr", 1, 1, "", (("td", 2, 1, ("a", "&", "b", "<b>", "c", "</b>"), ()), ("td", 1, 1, "d", ()))),
        ("tr", 1, 1, "", (("th", 1, 3, "", ()),))))
    assert X.read_table("<div>no grid</div>") is None
    nested = X.read_table("<table><tr><td>a<table><tr><td>b</td></tr></table>c</td></tr></table>")
    assert X.size(nested) == 3
    with pytest.raises(ValueError):
        X.read_table("<table><tr><td colspan='x'>a</td></tr></table>")
    assert [(i, p, d, n[0]) for i, p, d, n in X.preorder(t)] == [
        (0, -1, 0, "table"), (1, 0, 1, "tr"), (2, 1, 2, "td"), (3, 1, 2, "td"), (4, 0, 1, "tr"), (5, 4, 2, "th")]


def test_large_tables_that_share_nothing():
    rows = lambda t: "".join(f"<tr><td>{t}{i}</td><td>{t}{i * 7 % 13}</td></tr>" for i in range(60))
    a, b = (X.read_table(f"<table>{rows(t)}</table>") for t in "xy")
    assert 0 < X.similarity(a, b) < 1


def test_whole_tags_are_found_at_once_and_as_the_long_way_finds_them():
    rng = random.Random(11)
    bits = ["<table>", "<tr>", "<td>", "a b", "</td>", "<td colspan=\"2\">", "<td x='\"'>", "</tr>", "<br/>", "&amp;", "é", "'", ">"]
    odd = ["<", "<td a='>'>", "<!-- x -->", "\"", "<td\"", "<td a<b>", "</"]
    for k in range(3000):
        html = "".join(rng.choice(bits + odd * (k % 2)) for _ in range(rng.randrange(20)))
        found = X.tokens(html)
        assert list(found) == list(X.any_tokens(html))
        assert k % 2 or isinstance(found, list)
