import random
import zlib
from collections import defaultdict
from hashlib import sha256

from gridmill.llm import merkle, queries
from pyspark.sql import functions as F
from tests.llm.helpers import DOCS


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf_of(row, n_chars):
    shown = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], n_chars, row[1])]
    return h("".join(shown))


def climb(nodes):
    """Root and the proof of every node, by plain lists."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, place in enumerate(at):
            run = nodes[place // 2 * 2:place // 2 * 2 + 2]
            proofs[i].append((place % 2, run[1 - place % 2] if len(run) == 2 else None))
            at[i] = place // 2
        nodes = [h("".join(nodes[i:i + 2])) for i in range(0, len(nodes), 2)]
    return nodes[0] if nodes else None, proofs


def expected(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf_of(r, r[4]), r))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: climb([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in langs}
    root, above = climb([trees[g][0] for g in langs])
    out = []
    for g, up in zip(langs, above):
        subroot, proofs = trees[g]
        for (_, _, leaf, r), proof in zip(sorted(groups[g], key=lambda x: x[:3]), proofs):
            node = leaf
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                node = leaf_of(r, r[4] + 1)
            for side, other in proof + up:
                node = h(node) if other is None else h(other + node) if side else h(node + other)
            seen = h("".join(x for _, x in proof + up if x))
            out.append((r[0], leaf, subroot, root, seen, node, node == root))
    return sorted(out, key=repr)


def check(spark, tmp_path, rows, schema=DOCS):
    spark.createDataFrame(rows, schema).repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_merkle_manifest(spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def some_rows(n, rng):
    return [(i, f"text {rng.random()}", rng.choice(["en", "en", "de", "é", "z"]), rng.choice(["a", None]), rng.randrange(99))
            for i in range(n)]


def test_entries_equal_plain_lists(spark, tmp_path):
    rows = some_rows(300, random.Random(1))
    odd = [(None, None, None, None, None), (7, "", "", "", 0), (7, "", "", "", 0), (7, "x" * 300_000, "en", "s", 5), (-3, "漢字🎉", "en", "s", 2**63 - 1),
           (14, "a\nb", None, "s", None), (None, "t", "en", "s", 1)]
    assert check(spark, tmp_path, rows + odd) == expected(rows + odd)


def test_trees_of_all_shapes(spark, tmp_path):
    for sizes in ([1], [1, 1, 1], [2, 3], [5, 6, 7, 8, 9]):
        rows = [(1000 * g + i, f"t{i}", f"l{g}", "s", i) for g, n in enumerate(sizes) for i in range(n)]
        assert check(spark, tmp_path, rows) == expected(rows)


def test_a_group_of_several_bands(spark, tmp_path, monkeypatch):
    made = merkle.manifest
    monkeypatch.setattr(merkle, "manifest", lambda *a: made(*a, up=2))
    rows = some_rows(270, random.Random(2))
    rows += [(1000 + i, "same", f"lang {i}", "s", i) for i in range(9)]
    assert check(spark, tmp_path, rows) == expected(rows)


def test_more_leaves_than_a_block(spark, tmp_path):
    rows = [(i, "t", "en", "s", i) for i in range(2500)] + [(5000, "t", "de", "s", 1)]
    assert check(spark, tmp_path, rows) == expected(rows)


def test_empty_table_and_clashing_columns(spark, tmp_path):
    assert check(spark, tmp_path / "none", []) == []
    rows = some_rows(20, random.Random(3))
    clash = f"{DOCS}, tree string, pos long, digest string, size int, root string, leaf string, _tie long, block int"
    assert check(spark, tmp_path / "clash", [(*r, "x", 1, "y", 2, "z", "l", 3, 4) for r in rows], clash) == expected(rows)


def test_versions_share_what_they_do_not_copy(spark):
    df = spark.createDataFrame([(i, "g", "a" * 64 if i != 5 else "b" * 64) for i in range(13)], "id long, g string, leaf string")
    made = merkle.manifest(df, "g", "id", F.col("leaf"), F.when(F.col("id") % 6 == 5, F.lit("c" * 64)))
    nodes = merkle.new_nodes(made, "id").collect()
    assert {r.id for r in nodes} == {5, 11}
    for r in made.where("version IS NOT NULL").collect():
        own = sorted((n for n in nodes if n.id == r.id), key=lambda n: n.level)
        assert [n.digest for n in own] == r.version and len(own) == 5  # a leaf and four ancestors
        assert own[0].digest == "c" * 64 and own[-1].digest == r.folded_root != r.root
        assert [n.shared for n in own if n.shared] == r.siblings
    assert made.where("version IS NULL AND folded_root <> root").count() == 0
