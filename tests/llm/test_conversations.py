import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pytest

from gridmill.llm import conversations as C, queries

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SPACE = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """(cost, audit, repaired rows) by trying every edit; rows are (role, text, must go, truncated)."""
    @lru_cache(maxsize=None)
    def best(i, state):
        given = {"": "user", "s": "user", "u": "assistant", "a": "user"}[state]
        found = [(0, "")] if i == len(rows) and state in ("", "a") else []
        for cost, letter, j, then in ways(i, state, given):
            rest = memo(j, then)
            if rest:
                found.append((cost + rest[0], letter + rest[1]))
        return min(found) if found else None

    def ways(i, state, given):
        if i < len(rows):
            role, _, must, cut = rows[i]
            yield 4, "D", i + 1, state
            if not must:
                yield 3 + 3 * cut, "R", i + 1, given[0]
                if (state, role[:1]) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                    yield 3 * cut, "K", i + 1, role[0]

    def memo(i, state):
        """The best from here, with up to two insertions first."""
        found, cost, letters = [], 0, ""
        for _ in range(3):
            rest = best(i, state)
            if rest:
                found.append((cost + rest[0], letters + rest[1]))
            state = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
            cost, letters = cost + 3, letters + "I"
        return min(found) if found else None

    for i in range(len(rows), 0, -1):  # no deep recursion
        for state in ("", "s", "u", "a"):
            best(i, state)
    cost, audit = memo(0, "")
    out, state, it = [], "", iter(rows)
    for letter in audit:
        given = {"": "user", "s": "user", "u": "assistant", "a": "user"}[state]
        role, text = (given, "") if letter == "I" else next(it)[:2]
        if letter == "D":
            continue
        role = role if letter == "K" else given
        out.append((role, text))
        state = role[0]
    assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in out))
    return cost, audit, out


def expected(table, damage=True):
    convs = defaultdict(list)
    for conv, turn, role, text in table:
        show = lambda v: " " if v is None else str(v)
        fate = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20 if damage else 9
        role, text = show(role), show(text)
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(fate, text)
        role = "user" if fate == 4 else role
        convs[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(fate, 1)
    out = []
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), sha256(r[2].encode()).hexdigest()))
        seen, counts, judged = set(), dict(blank=0, duplicate=0, truncated=0), []
        for _, role, text in rows:
            end = text.rstrip(SPACE)
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            judged.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
        turns = {r[0] for r in rows if r[0] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        cost, audit, repaired = cheapest(tuple(judged))
        text = "\n".join(f"{r}:{t}" for r, t in repaired)
        out.append((conv, gaps, *counts.values(), illegal, cost, audit, sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(spark, tmp_path, table, schema=SCHEMA):
    spark.createDataFrame(table, schema).repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    made = queries.op13_conversation_repair(spark, str(tmp_path))
    assert made.columns == COLUMNS
    return sorted((tuple(r) for r in made.collect()), key=repr)


def some(rng, convs, turns, texts=("Hello there.", "What?", "no end", " ", "", "Yes!", "a.b")):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", "unknown"]
    return [(c, t, rng.choice(roles), rng.choice(texts) if rng.random() < .3 else f"Line {rng.random()}.")
            for c in range(convs) for t in range(rng.randrange(turns) + 1)]


def test_repairs_equal_an_exhaustive_search(spark, tmp_path):
    table = some(random.Random(1), 150, 9)
    odd = [(None, None, None, None), (None, 1, "user", "Hi."), (900, None, "user", "Q?"), (900, None, "assistant", "A."),
           (901, 5, "user", "漢字."), (901, 5, "user", "漢字."), (901, 9, "assistant", "x" * 400_000 + "."), (902, -(2**61), "user", "a."),
           (902, 2**61, "system", None), (903, None, "user", "\x1c"), (903, None, "user", "\x85.")]
    gone = next(n for n in range(10_000, 20_000) if zlib.crc32(f"{n}:0".encode()) % 20 == 0)
    odd.append((gone, 0, "user", "dropped."))
    found = got(spark, tmp_path, table + odd)
    assert found == expected(table + odd)
    assert (gone, 0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest()) in found


def test_a_conversation_over_many_stretches(spark, tmp_path, monkeypatch):
    """A conversation that range partitions cut in many places, and its repaired rows."""
    rng = random.Random(2)
    table = some(rng, 5, 4) + [(77, t, rng.choice(["user", "assistant"]), rng.choice(["same.", f"t{t}.", f"u{t}"])) for t in range(700)]
    monkeypatch.setattr(C, "stretches", narrow(C.stretches))
    assert got(spark, tmp_path, table) == expected(table)
    df = spark.createDataFrame(table, SCHEMA)
    fixed = C.repair(C.plain(df)).where("conv = 77").orderBy("place").collect()
    want = next(r for r in expected(table, damage=False) if r[0] == 77)
    assert sha256("\n".join(f"{r.role}:{r.text}" for r in fixed).encode()).hexdigest() == want[-1]
    assert "".join(r.edit for r in fixed) == want[7].replace("D", "")


def test_the_first_of_equal_rows_is_the_one_that_stays(spark, tmp_path):
    """Rows that come twice, or many times, stand before their duplicates, whatever a join does to their order."""
    table = 2 * some(random.Random(4), 200, 9) + 30 * [(950, 1, "user", "Again."), (950, 2, "assistant", "And no end")]
    assert got(spark, tmp_path, table) == expected(table)


def narrow(made):
    """Stretches with range partitions that adaptive execution leaves small."""
    def run(rows):
        conf = rows.sparkSession.conf
        conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            found = made(rows)
            assert found.where("conv = 77").count() > 3
            return found
        finally:
            conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    return run


def test_empty_table_and_clashing_columns(spark, tmp_path):
    assert got(spark, tmp_path / "none", []) == []
    table = some(random.Random(3), 12, 5)
    clash = f"{SCHEMA}, conv string, mark int, symbol string, gone boolean, at long, kind int, fate int, audit string, _tie int"
    assert got(spark, tmp_path / "clash", [(*r, "x", 1, "s", True, 2, 3, 4, "a", 5) for r in table], clash) == expected(table)


@pytest.mark.parametrize("seed", range(20))
def test_stretches_choose_as_the_whole_does(seed):
    rng = random.Random(seed)
    symbols = "".join(rng.choice("0123456789abcdef") * rng.choice([1, 1, 2, 7, 40]) for _ in range(12))
    audit, state = C.whole(symbols)
    cut = sorted(rng.sample(range(1, len(symbols)), 3))
    parts = [symbols[i:j] for i, j in zip([0, *cut], [*cut, None])]
    rests = [C.LAST]
    for part in reversed(parts[1:]):
        rests.append(C.times(C.matrix(part), rests[-1]))
    made, now = "", C.START
    for part, rest in zip(parts, reversed(rests)):
        text, now = C.chosen(part, rest, now)
        made += text
    assert (made, now) == (audit, state)
    assert C._paid(symbols, audit + C.closing(state)) == C.times(C.matrix(symbols), C.LAST)[C.START]


def test_powers_are_repeated_products():
    for symbol in "0123456789abcdef":
        step = made = C.matrix(symbol)
        for n in range(2, 40):
            made = C.times(made, step)
            assert np.array_equal(made, C.run_matrix(symbol, n))
