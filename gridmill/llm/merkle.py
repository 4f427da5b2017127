"""Merkle manifest of a dataset as a persistent tree.

Rows are leaves of one tree per group; the groups' roots, in order, are the leaves of the tree of the whole dataset.
Every two consecutive nodes have a parent, a last odd one has a parent of its own, until one node is left.

Trees are cut into aligned blocks of 1,024 nodes and ten levels: blocks of the leaves, blocks of those blocks' tops, and so on.
Tops are made bottom-up, one row per block and band. Paths come back top-down: a block needs one row, the path of its own
top, so no block of a higher band ever meets all the rows below it. A changed leaf makes a version of the tree in the task of its
block: new copies of its ancestors there, continued along the path of the block, while every other node is shared with the
tree as it was.
"""

from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from gridmill.llm.numbering import numbered
from gridmill.sources.work import stage

HEIGHT = 10  # levels of a block

Roof = Callable[[DataFrame, int], DataFrame]


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """A value that cannot run into its neighbour: its byte count, a colon and itself; `-` for null."""
    shown = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def levels(nodes: list[str], up: int) -> list[list[str]]:
    """The nodes and the `up` levels above them."""
    found = [nodes]
    for _ in range(up):
        below = found[-1]
        found.append([digest("".join(below[i:i + 2])) for i in range(0, len(below), 2)])
    return found


def siblings(found: list[list[str]], at: int) -> tuple[str, list[str]]:
    """Sides and siblings on the way up from a node: R or L, - where the node has a parent of its own."""
    sides, others = [], []
    for level in found[:-1]:
        other = at ^ 1
        if other < len(level):
            sides.append("R" if other > at else "L")
            others.append(level[other])
        else:
            sides.append("-")
        at >>= 1
    return "".join(sides), others


def copied(node: str, sides: str, others: list[str]) -> list[str]:
    """The node and the copies of its ancestors, the root last."""
    path, rest = [node], iter(others)
    for side in sides:
        if side == "R":
            node = digest(node + next(rest))
        elif side == "L":
            node = digest(next(rest) + node)
        else:
            node = digest(node)
        path.append(node)
    return path


def block_levels(nodes: list[str], size: int, up: int) -> list[list[str]]:
    """The levels of a block of a tree that has `size` nodes in this band."""
    return levels(nodes, min(up, (size - 1).bit_length()))


def _tops(batches: Iterator[pa.RecordBatch], up: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tops = []
        for size, nodes in zip(batch.column("size").to_pylist(), batch.column("nodes")):
            tops.append(block_levels(nodes.values.field("digest").to_pylist(), size, up)[-1][0])
        yield batch.append_column("top", pa.array(tops, pa.string()))


def _blocks(nodes: DataFrame, up: int) -> DataFrame:
    """One row per aligned block of (tree, size, pos, digest, row): its nodes in order and its top."""
    packed = F.array_sort(F.collect_list(F.struct("pos", "digest", "row"))).alias("nodes")
    made = nodes.groupBy("tree", "size", F.shiftright("pos", up).alias("block")).agg(packed)
    schema = T.StructType([*made.schema, T.StructField("top", T.StringType())])
    return stage(made.mapInArrow(lambda batches: _tops(batches, up), schema), "merkle")


def _unfolded(batches: Iterator[pa.RecordBatch], up: int) -> Iterator[pa.RecordBatch]:
    """Nodes of blocks with their paths up to the root of all."""
    for batch in batches:
        columns = [batch.column(c) for c in ("tree", "size", "nodes", "sides", "siblings", "subroot", "root")]
        for tree, size, nodes, sides, above, subroot, root in zip(*columns):
            nodes, sides, above = nodes.values, sides.as_py(), above.as_py()
            found = block_levels(nodes.field("digest").to_pylist(), size.as_py(), up)
            own = [siblings(found, i) for i in range(len(nodes))]
            same = lambda scalar: pa.array([scalar.as_py()] * len(nodes), pa.string())
            yield pa.RecordBatch.from_arrays(
                [same(tree), nodes.field("pos"), nodes.field("digest"), nodes.field("row"),
                 pa.array([s + sides for s, _ in own], pa.string()),
                 pa.array([o + above for _, o in own], pa.list_(pa.string())), same(subroot), same(root)],
                ["tree", "pos", "digest", "row", "sides", "siblings", "subroot", "root"])


def _paths(nodes: DataFrame, up: int, roof: Roof) -> DataFrame:
    """(tree, pos, digest, row, sides, siblings, subroot, root) of every node."""
    blocks = _blocks(nodes, up)
    tops = blocks.select("tree", (F.shiftright(F.col("size") - 1, up) + 1).alias("size"), F.col("block").alias("pos"),
                         F.col("top").alias("digest"), F.lit(True).alias("row"))
    more = tops.agg(F.max("size")).first()[0] or 0
    above = _paths(tops, up, roof) if more > 1 else roof(tops, up)
    above = above.select("tree", F.col("pos").alias("block"), "sides", "siblings", "subroot", "root")
    schema = T.StructType([
        nodes.schema["tree"], T.StructField("pos", T.LongType()), T.StructField("digest", T.StringType()), nodes.schema["row"],
        T.StructField("sides", T.StringType()), T.StructField("siblings", T.ArrayType(T.StringType())),
        T.StructField("subroot", T.StringType()), T.StructField("root", T.StringType())])
    return blocks.join(above, ["tree", "block"]).mapInArrow(lambda batches: _unfolded(batches, up), schema)


def _end(tops: DataFrame, up: int) -> DataFrame:
    """The tops of whole trees are roots; there is nothing above them."""
    return tops.select("tree", "pos", F.lit("").alias("sides"), F.array().cast("array<string>").alias("siblings"),
                       F.col("digest").alias("subroot"), F.col("digest").alias("root"))


def _under_one_root(tops: DataFrame, up: int) -> DataFrame:
    """The tops of whole trees are the leaves, in the order of the trees, of the tree above."""
    ranked = numbered(tops.select(F.lit("").alias("tree"), "digest", F.col("tree").alias("row")), "tree", ["row"], "merkle_trees")
    found = _paths(ranked, up, _end)
    return tops.select("tree", "pos").join(
        found.select(F.col("row").alias("tree"), "sides", "siblings", F.col("digest").alias("subroot"), "root"), "tree")


def _versions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, sides, others = (batch.column(c).to_pylist() for c in ("digest", "sides", "siblings"))
        version, folded = [], []
        for own, other, way, by in zip(digests, batch.column("changed").to_pylist(), sides, others):
            path = copied(own if other is None else other, way, by)
            version.append(None if other is None else path)
            folded.append(path[-1])
        yield batch.append_column("version", pa.array(version, pa.list_(pa.string()))).append_column(
            "folded_root", pa.array(folded, pa.string()))


def manifest(df: DataFrame, group: str, key: str, leaf: Column, changed: Column, up: int = HEIGHT) -> DataFrame:
    """Per row of df, the manifest's entry of it.

    The columns: key, leaf (hex digest), pos (place among the group's leaves), subroot, root, sides and siblings (the proof: for
    each level up to root, R or L where a sibling stands on that side, - where none does; the siblings, lowest first),
    version (the copies that `changed`, another digest of the leaf, makes of the leaf and its ancestors up to its own
    root; null where `changed` is null) and folded_root (the root that follows from the changed, else the own, leaf and
    the siblings).

    A group's leaves ascend by key, nulls first, those of one key by leaf; equal rows have an entry each. Groups are ordered as
    text in UTF-8 bytes, null (a group of its own) first. An empty table has no entries. Other columns are not read.
    Blocks have `up` levels; the entries do not depend on it.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("tree")
    rows = df.select(tree, F.col(key).alias("key"), leaf.alias("digest"), changed.alias("changed"))
    placed = numbered(rows, "tree", ["key", "digest"], "merkle_leaves").select(
        "tree", "size", "pos", "digest", F.struct("key", "changed").alias("row"))
    found = _paths(placed, up, _under_one_root)
    flat = found.select(F.col("row.key").alias(key), F.col("row.changed").alias("changed"), "digest", "pos", "subroot", "root",
                        "sides", "siblings")
    schema = T.StructType([*flat.schema, T.StructField("version", T.ArrayType(T.StringType())),
                           T.StructField("folded_root", T.StringType())])
    return flat.mapInArrow(_versions, schema).drop("changed").withColumnRenamed("digest", "leaf")


def new_nodes(entries: DataFrame, key: str) -> DataFrame:
    """(key, level, digest, shared): what each version of a manifest adds to the tree, and the sibling it shares there.

    `shared` is null at the root and beside a parent of its own. No other node belongs to the version alone.
    """
    sibling = F.expr("""transform(sequence(1, length(sides) + 1), i ->
        if(i <= length(sides) AND substr(sides, i, 1) <> '-',
           siblings[length(replace(substr(sides, 1, i), '-', '')) - 1], NULL))""")
    nodes = F.posexplode(F.arrays_zip(F.col("version").alias("digest"), sibling.alias("shared")))
    return entries.where("version IS NOT NULL").select(key, nodes.alias("level", "node")).select(key, "level", "node.digest", "node.shared")
