"""Exact row numbers that survive a hot group.

A plain window puts a whole group into one task. Here rows are range-partitioned
by (group, order), numbered inside each range, and shifted by the number of rows
of the same group in earlier ranges. Only the counts per (group, range) travel,
and only groups that cross a range border need a shift.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinloom.operators.lineage import cut


def number_rows(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Add ``name`` = 1, 2, ... inside each group; ``order`` must be total in it."""
    spread = (
        df.repartitionByRange(*[F.col(c) for c in group + order])
        .withColumn("_range", F.spark_partition_id())
    )
    # The range borders come from a sample; writing once fixes them for both uses.
    spread, _ = cut(spread)
    local = Window.partitionBy(*group, "_range").orderBy(*order)
    numbered = spread.withColumn("_at", F.row_number().over(local))
    counts = spread.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    crossing = counts.groupBy(*group).agg(
        F.collect_list(F.struct("_range", "_n")).alias("_all")
    ).where(F.size("_all") > 1)
    earlier = crossing.withColumn("_mine", F.explode("_all")).select(
        *group,
        F.col("_mine._range").alias("_range"),
        F.aggregate(
            F.filter("_all", lambda x: x["_range"] < F.col("_mine._range")),
            F.lit(0).cast("bigint"),
            lambda acc, x: acc + x["_n"],
        ).alias("_shift"),
    )
    return (
        numbered.join(earlier, [*group, "_range"], "left")
        .withColumn(name, (F.col("_at") + F.coalesce("_shift", F.lit(0))).cast("bigint"))
        .drop("_at", "_range", "_shift")
    )
