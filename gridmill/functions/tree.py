"""Per-pair helpers of the scoring job: read one table, compare two.

A node is a tuple (tag, colspan, rowspan, text, children). Only td nodes carry text: a string, or
a tuple of characters and tags when there are tags inside the cell (each tag is one token).
"""

import re
from bisect import bisect_left
from html import unescape

import numpy as np

CELLS = ("td", "th")
SECTIONS = ("thead", "tbody", "tfoot")
GRID = CELLS + SECTIONS + ("tr",)
VOID = ("br", "hr", "img", "input", "col", "wbr")
# an opening tag of the first group closes what is still open of the second
CLOSES = {"td": CELLS, "th": CELLS, "tr": ("tr",), **{s: SECTIONS + ("tr",) for s in SECTIONS}}

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/><]*)")
_MARK = re.compile("[\"'>]")
# Whole tags, with no < or > in quotes, and texts; the tags are those that `any_tokens` finds the long way too.
_TAG = r"""<(/?)([a-zA-Z][^\s/><]*+)((?:[^"'<>]++|"[^"<>]*+"|'[^'<>]*+')*+)>"""
_PLAIN = re.compile(_TAG)
_SCAN = re.compile(_TAG + "|([^<]++)")
_SPAN = re.compile(r"""\b(colspan|rowspan)\s*=\s*["']?\s*([^\s"'>]*)""", re.I)


def _close(path, *tags):
    """Drop open elements down to and including the innermost one of these tags, if any."""
    for at in range(len(path) - 1, -1, -1):
        if path[at][0] in tags:
            del path[at:]
            return


def lenient_span(text: str) -> int | None:
    return int(text) if text.isdecimal() else None


def tokens(html: str):
    """(closing, tag, attributes, text) of every tag and stretch of text; comments are blank."""
    found = _SCAN.findall(html)
    whole = sum([1 for t in found if t[1]]) == html.count("<")  # otherwise a < begins no whole tag
    return found if whole else any_tokens(html)


def any_tokens(html: str):
    """`tokens` of any text.

    Each way to the end of the text that finds no unquoted > is followed once, so broken tags
    cost no more than whole ones.
    """
    marks, plain, find, n = None, _PLAIN.match, html.find, len(html)
    last_comment, last_end, dead, at = html.rfind("-->"), html.rfind(">"), set(), 0

    def end_of_tag(start):
        nonlocal marks
        if marks is None:
            marks = [m.start() for m in _MARK.finditer(html)]
        seen, i = [], bisect_left(marks, start)
        while i < len(marks) and i not in dead:
            quote = html[marks[i]]
            if quote == ">":
                return marks[i]
            seen.append(i)
            closing = html.find(quote, marks[i] + 1)
            i = len(marks) if closing < 0 else bisect_left(marks, closing + 1)
        dead.update(seen)
        return -1

    while at < n:
        if html[at] != "<":
            end = find("<", at)
            end = n if end < 0 else end
            yield "", "", "", html[at:end]
            at = end
        elif last_end > at and (tag := plain(html, at)):
            yield *tag.groups(), ""
            at = tag.end()
        elif html.startswith("<!--", at) and last_comment >= at + 4:
            yield "", "", "", ""
            at = html.find("-->", at + 4) + 3
        elif html.startswith("<!", at) and last_end > at:
            yield "", "", "", ""
            at = html.find(">", at) + 1
        else:
            name = _NAME.match(html, at) if last_end > at else None
            end = end_of_tag(name.end()) if name else -1
            if end < 0:
                yield "", "", "", "<"
                at += 1
            else:
                yield name[1], name[2], html[name.end():end], ""
                at = end + 1


def parse(html: str, span=int) -> list[list]:
    """The nodes of the first table of a text in document order, none when the text has none. `span` reads a span.

    A node is a list: tag, spans, pieces of text, children, number of the parent (-1: none), depth.
    Rows and cells left open are closed by the next one, as browsers do. Inside a cell, any tag
    that is not part of the grid belongs to the cell's text, nested tables as a whole.
    """
    found, path, places, nested, cell = [], [], [], 0, None
    for closing, tag, attrs, text in tokens(html):
        if text:
            if cell:
                cell[3].append(unescape(text) if "&" in text else text)
            continue
        if not tag:
            continue
        tag = tag.lower()
        if found and not path:
            break
        elif cell and (nested or tag not in GRID and not (closing and tag == "table")):
            nested += (tag == "table") * (-1 if closing else 1)
            cell[3].append((f"<{closing}{tag}>",))
            continue
        elif closing:
            if path and path[-1][0] == tag:
                path.pop()
                places.pop()
            else:
                _close(path, tag)
                del places[len(path):]
        elif path or tag == "table":
            if tag in CLOSES and path:
                _close(path, *CLOSES[tag])
                del places[len(path):]
            spans = {k.lower(): span(v) for k, v in _SPAN.findall(attrs)} if attrs and tag in CELLS else {}
            node = [tag, spans.get("colspan", 1), spans.get("rowspan", 1), [], [], places[-1] if path else -1, len(path)]
            if path:
                path[-1][4].append(node)
            if tag not in VOID:
                path.append(node)
                places.append(len(found))
            found.append(node)
        cell = path[-1] if path and path[-1][0] in CELLS else None
    return found


def read_trees(html: str):
    """The tree of the first table, the same without text, and its size; None when the text has none. Bad spans raise ValueError."""
    found = parse(html)
    for node in reversed(found):  # children come before their parents and leave their trees in places 3 and 4
        tag, colspan, rowspan, parts, children = node[:5]
        if tag == "td":
            tagged = any(type(p) is tuple for p in parts)
            node[3] = tag, colspan, rowspan, tuple(t for p in parts for t in p) if tagged else "".join(parts), ()
            node[4] = tag, colspan, rowspan, "", ()
            node[5] = 1
        else:
            node[3] = tag, colspan, rowspan, "", tuple([c[3] for c in children])
            node[4] = tag, colspan, rowspan, "", tuple([c[4] for c in children])
            node[5] = 1 + sum([c[5] for c in children])
    return tuple(found[0][3:6]) if found else None


def read_table(html: str):
    """Tree of the first table, None when the text has none. Bad spans raise ValueError."""
    trees = read_trees(html)
    return trees and trees[0]


def _rebuilt(root, make):
    """A tree of make(node, new children) for every node, without recursion."""
    rows, todo = [], [(root, -1)]
    while todo:
        node, parent = todo.pop()
        todo.extend((child, len(rows)) for child in reversed(node[4]))
        rows.append((node, parent))
    children = [[] for _ in rows]
    for at in range(len(rows) - 1, -1, -1):
        node, parent = rows[at]
        new = make(node, tuple(reversed(children[at])))
        if parent < 0:
            return new
        children[parent].append(new)


def without_text(root):
    return _rebuilt(root, lambda node, children: (*node[:3], "", children))


def size(root) -> int:
    n, todo = 0, [root]
    while todo:
        n += 1
        todo.extend(todo.pop()[4])
    return n


def same(a, b) -> bool:
    """Are two trees equal? Very deep ones are compared without recursion."""
    try:
        return a == b
    except RecursionError:
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            if x[:4] != y[:4] or len(x[4]) != len(y[4]):
                return False
            todo.extend(zip(x[4], y[4]))
        return True


def preorder(root):
    """(node_id, parent, depth, node) in document order."""
    rows, todo = [], [(root, -1, 0)]
    while todo:
        node, parent, depth = todo.pop()
        at = len(rows)
        rows.append((at, parent, depth, node))
        todo.extend((child, at, depth + 1) for child in reversed(node[4]))
    return rows


def _running_min(values, step, group):
    """Per group: v[j] = min over k <= j of values[k] + (step[j] - step[k])."""
    big = group * (int(step.max(initial=0)) + values.size + 2)
    return np.minimum.accumulate(values - step - big) + step + big


FEW = 8  # texts on the right up to which every pair of texts is compared by itself


def _edits(a, b) -> int:
    """Edit distance of two texts: equal ends are taken off, the rest goes by columns of bits (Hyyro 2003)."""
    start, end, least = 0, 0, min(len(a), len(b))
    while start < least and a[start] == b[start]:
        start += 1
    while end < least - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start:len(a) - end], b[start:len(b) - end]
    if not a or not b:
        return len(a) + len(b)
    if len(a) < len(b):
        a, b = b, a
    at = {}
    for i, token in enumerate(b):
        at.setdefault(token, []).append(i)
    n = len(b)
    where = {token: _bits(places, n) for token, places in at.items()}
    full, last, up, down, score = (1 << n) - 1, 1 << (n - 1), (1 << n) - 1, 0, n
    for token in a:
        equal = where.get(token, 0)
        vertical = equal | down
        equal = (((equal & up) + up) ^ up) | equal
        more, less = down | (full & ~(equal | up)), up & equal
        score += bool(more & last) - bool(less & last)
        more = more << 1 | 1
        up, down = ((less << 1) | ~(vertical | more)) & full, more & vertical & full
    return score


def _bits(places: list[int], n: int) -> int:
    raw = bytearray(n // 8 + 1)
    for i in places:
        raw[i >> 3] |= 1 << (i & 7)
    return int.from_bytes(raw, "little")


def text_distances(left, right):
    """Normalised edit distance of every text on the left to every text on the right."""
    if len(right) <= FEW:
        return np.array([[_edits(a, b) / max(len(a), len(b), 1) for b in right] for a in left]).reshape(len(left), len(right))
    code = {}
    ids = lambda text: [code.setdefault(t, len(code)) for t in text]
    flat = np.array([x for t in right for x in [-1, *ids(t)]])
    length = np.array([len(t) for t in right])
    group = np.repeat(np.arange(len(right)), length + 1)
    heads = np.concatenate([[0], np.cumsum(length + 1)[:-1]])
    ends, step = heads + length, np.arange(flat.size) - heads[group]
    out = np.empty((len(left), len(right)))
    for r, text in enumerate(left):
        row = step.copy()
        for i, token in enumerate(ids(text), 1):
            best = np.minimum(row + 1, np.concatenate([[0], row[:-1]]) + (flat != token))
            best[heads] = i
            row = _running_min(best, step, group)
        out[r] = row[ends] / np.maximum(np.maximum(length, len(text)), 1)
    return out


def _postorder(forest):
    """Nodes below a common root in postorder: node, first leaf, depth; the root comes last."""
    nodes, first, depth = [], [], []
    todo = [(("", 1, 1, "", tuple(forest)), 0, None)]
    while todo:
        node, level, start = todo.pop()
        if start is None:
            todo.append((node, level, len(nodes)))
            todo.extend((child, level + 1, None) for child in reversed(node[4]))
        else:
            nodes.append(node)
            first.append(start)
            depth.append(level)
    return nodes, np.array(first), np.array(depth)


def _substitution(left, right):
    """Cost of turning each left node into each right node: 1, or the text distance of like cells."""
    kinds, texts = {}, ({}, {})
    kind = [np.array([kinds.setdefault(n[:3], len(kinds)) for n in side]) for side in (left, right)]
    cost = (kind[0][:, None] != kind[1][None, :]).astype(float)
    cells = [[i for i, n in enumerate(side) if n[0] == "td"] for side in (left, right)]
    if cells[0] and cells[1]:
        which = [np.array([seen.setdefault(side[i][3], len(seen)) for i in at])
                 for side, at, seen in zip((left, right), cells, texts)]
        between = text_distances(list(texts[0]), list(texts[1]))[which[0][:, None], which[1][None, :]]
        block = np.ix_(*cells)
        cost[block] = np.maximum(cost[block], between)
    return cost


def forest_distance(a, b) -> float:
    """Ordered edit distance of two forests (Zhang and Shasha 1989), one numpy row at a time.

    Subtrees of the second tree at equal depth do not overlap, so all of them share a row.
    """
    (na, fa, _), (nb, fb, db) = _postorder(a), _postorder(b)
    cost = _substitution(na, nb)
    tree = np.zeros((len(na), len(nb)))
    roots = lambda first: sorted({f: k for k, f in enumerate(first)}.values())  # highest node per first leaf
    layers = []
    roots_b = roots(fb)
    for level in sorted({db[k] for k in roots_b}, reverse=True):
        spans = [(fb[k], k) for k in roots_b if db[k] == level]
        width = np.array([k - f + 2 for f, k in spans])
        heads = np.concatenate([[0], np.cumsum(width)[:-1]])
        group = np.repeat(np.arange(len(spans)), width)
        step = np.arange(group.size) - heads[group]
        lead = np.array([f for f, _ in spans])[group]
        node = lead + step - 1
        inner = step > 0
        node[~inner] = 0
        whole = inner & (fb[node] == lead)
        before = np.where(inner, heads[group] + fb[node] - lead, 0)
        layers.append((heads, group, step, node, inner, whole, before))
    for k in roots(fa):
        for heads, group, step, node, inner, whole, before in layers:
            rows = np.empty((k - fa[k] + 2, step.size))
            rows[0] = step
            at = np.flatnonzero(whole)
            for x in range(fa[k], k + 1):
                i = x - fa[k] + 1
                best = rows[fa[x] - fa[k]][before] + tree[x][node]
                if fa[x] == fa[k]:
                    best[at] = rows[i - 1][at - 1] + cost[x][node[at]]
                best = np.minimum(best, rows[i - 1] + 1)
                best[heads] = i
                rows[i] = _running_min(best, step, group)
                if fa[x] == fa[k]:
                    tree[x][node[at]] = rows[i][at]
    return float(tree[-1, -1])


def tree_distance(a, b) -> float:
    """Edit distance of two trees; equal outer parts are taken off first.

    Equal nodes at the top may be matched to each other, and so may equal trees at either end of
    two forests: an edit script that does otherwise can be rewritten to do so at no extra cost.
    """
    left, right = [a], [b]
    while left and right:
        start, end, least = 0, 0, min(len(left), len(right))
        while start < least and same(left[start], right[start]):
            start += 1
        while end < least - start and same(left[-1 - end], right[-1 - end]):
            end += 1
        left, right = left[start:len(left) - end], right[start:len(right) - end]
        if len(left) == len(right) == 1 and left[0][:4] == right[0][:4]:
            left, right = list(left[0][4]), list(right[0][4])
            continue
        break
    if not left or not right:
        return float(sum(map(size, left)) + sum(map(size, right)))
    if len(left) == len(right) == 1 and not left[0][4] and not right[0][4]:
        return float(_substitution(left, right)[0, 0])
    return forest_distance(left, right)


def similarity(truth, pred, largest: int | None = None) -> float:
    """`largest` is the larger of both sizes, where it is known."""
    return 1.0 - tree_distance(truth, pred) / (largest or max(size(truth), size(pred)))
