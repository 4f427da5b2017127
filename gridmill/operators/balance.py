"""Rows dealt to tasks by what they cost.

Costs of distinct keys are added up per hash cell, a mergeable histogram of a fixed number of cells per task. A key that alone is a
noticeable part of a task is listed by itself; there are few of those, because together they are at most the whole.
Cells and listed keys then go to the tasks largest first, each to the least loaded one. Both lists follow the number of tasks, never the
data, so they are made on the driver and broadcast.
"""

import heapq

from pyspark.sql import Column, DataFrame, functions as F

CELLS = 16  # hash cells per task
PART = 8    # a key that costs more than one PART of a task's share is listed


def _cell(key: Column, tasks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(CELLS * tasks)).cast("int")


def assignment(costs: DataFrame, tasks: int) -> tuple[dict[str, int], dict[int, int]]:
    """Task of every listed key and of every cell, for a table of distinct (key, cost), costs above zero."""
    total = costs.agg(F.sum("cost")).first()[0] or 0
    large = F.col("cost") * tasks * PART > total
    listed = costs.where(large).select("key", "cost").collect()  # fewer than PART x tasks
    cells = costs.where(~large).groupBy(_cell(F.col("key"), tasks).alias("cell")).agg(F.sum("cost").alias("cost")).collect()
    units = sorted([(r.cost, 0, r.key) for r in listed] + [(r.cost, 1, r.cell) for r in cells], reverse=True)
    loads = [(0, t) for t in range(tasks)]
    found = ({}, {})
    for cost, kind, name in units:
        load, task = heapq.heappop(loads)
        found[kind][name] = task
        heapq.heappush(loads, (load + cost, task))
    return found


def dealt_by_cost(df: DataFrame, costs: DataFrame, tasks: int) -> DataFrame:
    """The rows of df in `tasks` partitions of about equal cost; rows of one key are in one partition.

    `costs` has every key of df once with its cost: what its first row takes, since copies are thought to be free.
    """
    listed, cells = assignment(costs, tasks)
    spark = df.sparkSession
    table = lambda pairs, schema: F.broadcast(spark.createDataFrame(list(pairs.items()), schema))
    placed = df.withColumn("_cell", _cell(F.col("key"), tasks)).join(table(listed, "key string, _own int"), "key", "left")
    placed = placed.join(table(cells, "_cell int, _shared int"), "_cell", "left")
    return placed.withColumn("_task", F.coalesce("_own", "_shared", F.lit(0))).repartitionById(tasks, F.col("_task")).select(*df.columns)
