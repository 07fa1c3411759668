"""Exact places of rows within groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def ranked(rows: DataFrame, group: list[str], order: list[str], rank: str = "rank", total: str = "total") -> DataFrame:
    """``rows`` with their place (from 0) among the rows of their group, and the group's size.

    Rows are dealt out by ranges of group and order, so that a large group lies
    in many tasks. A row's place is its place within its task's part of the group
    and the number of the group's rows in the tasks before: one row for each
    group and task that meet. Nulls come first, null groups are groups of their
    own, and rows that are equal in ``order`` are placed in any order, which the
    written table then keeps.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(f"`{c}`") for c in [*group, *order]]
    sorted_rows = rows.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)
    placed = written(sorted_rows.withColumn("_at", F.monotonically_increasing_id()).withColumn("_task", F.shiftright("_at", 33)), "ranked")
    named = [F.col(f"`{c}`").alias(f"_g{k}") for k, c in enumerate(group)]
    parts = placed.groupBy(*named, F.col("_task").alias("_t")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy(*[f"_g{k}" for k in range(len(group))])
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("_before", before).withColumn("_total", F.sum("_n").over(whole)).drop("_n")
    same: list[Column] = [F.col(f"`{c}`").eqNullSafe(F.col(f"_g{k}")) for k, c in enumerate(group)]
    joined = placed.join(parts, reduce(lambda a, b: a & b, [F.col("_task") == F.col("_t"), *same]))
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("_at") - F.col("_first") + F.col("_before")).alias(rank), F.col("_total").alias(total))
