"""Row numbers over a sorted table without bringing a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gazetide.session import cut_lineage

_PLACE_BITS = 33  # monotonically_increasing_id(): partition number above, place below


def number_rows(df: DataFrame, group: str, order: list[Column], name: str = "row_no") -> DataFrame:
    """Number the rows of every ``group`` from 1 in ``order``; the order must be total.

    Rows are range-partitioned by group and order, so a large group spans many tasks; the
    number is the place inside the task plus the rows of the group in earlier tasks. The
    table of offsets has at most (tasks + groups) rows; the planner broadcasts it while small.
    """
    keys = [F.col(group).asc(), *order]
    sorted_rows = cut_lineage(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    ).withColumn("_task", F.shiftright("_id", _PLACE_BITS))
    runs = sorted_rows.groupBy(group, "_task").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    earlier = W.partitionBy(group).orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    offsets = runs.select(
        F.col(group).alias("_group"), F.col("_task").alias("_run"), "_first",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
    )
    return (
        sorted_rows.join(
            offsets,
            F.col(group).eqNullSafe(F.col("_group")) & (F.col("_task") == F.col("_run")),
        )
        .withColumn(name, F.col("_before") + F.col("_id") - F.col("_first") + 1)
        .drop("_id", "_task", "_group", "_run", "_first", "_before")
    )
