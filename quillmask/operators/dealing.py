"""Dealing rows to partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame


def dealt(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """rows dealt by key in one shuffle, so that groups and joins that hold the key need no other and aggregate nothing before it.

    One input file may hold very many rows that are all different; partial aggregates of them only fill the memory of the few tasks that read.
    The parts are one for every 4 MB of input, two a core at least, and 200 at most: up to there Spark's shuffle writes without sorting or spilling.
    """
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(min(200, max(2 * cores, -(-size // 2**22))), key)
