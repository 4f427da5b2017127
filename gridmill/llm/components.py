"""Connected components by contraction, for graphs whose hubs may hold a third of all nodes."""

from pyspark.sql import DataFrame, functions as F

from gridmill.sources.work import keep


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge; edges are (a, b), the root is some node of the component.

    Each round orders the nodes by a new hash, points every node at the first of its neighbours and itself,
    replaces both ends of every edge by what they point at and drops the edges that became loops, until none
    is left. Random orders have no long runs, so a chain shrinks by a share in each round. The first
    neighbour is a mergeable aggregate and the joins are on unique keys, so a hub is never gathered in one
    task. Rounds are written to the checkpoint folder. Repeated edges count once; edges with a null end and loops are left out,
    and a table without other edges has no nodes.
    """
    left = keep(edges.where("a <> b").select("a", "b").distinct())
    found, turn = None, 0
    while not left.isEmpty():
        turn += 1
        place = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("h"), F.col(c).alias("n"))
        both = left.union(left.select("b", "a"))
        points = keep(both.groupBy("a").agg(F.min(place("b")).alias("m")).select(
            F.col("a").alias("node"), F.least(place("a"), F.col("m"))["n"].alias("to")))
        if found is None:
            found = points.select("node", F.col("to").alias("root"))
        else:
            found = keep(found.join(points, found["root"] == points["node"], "left").select(
                found["node"], F.coalesce(points["to"], found["root"]).alias("root")))
        of = lambda name, new: points.select(F.col("node").alias(name), F.col("to").alias(new))
        moved = left.join(of("a", "x"), "a").join(of("b", "y"), "b")
        left = keep(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0) if found is None else found
