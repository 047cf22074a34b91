"""Row numbers within groups, for groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cadenza.session import stored


def running_index(df: DataFrame, groups: list[str], order: list[Column], name: str = "index") -> DataFrame:
    """df with `name`: 1, 2, ... within each group (nulls are a group) in the given order.

    Rows are dealt by ranges of (group, order), so a group that holds a third of all rows covers a third of the tasks; a
    row's number is its number in its range plus the sizes of its group's earlier ranges.  The ranges are written to the
    shared folder, so that a task that runs again sees the same ones.
    """
    keys = [F.col(g).asc_nulls_last() for g in groups]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = stored(df.repartitionByRange(n, *keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = d.groupBy(*groups, "_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*groups).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)), F.col("_range").alias("_r"), before.alias("_before"))
    local = d.withColumn("_local", F.row_number().over(W.partitionBy(*groups, "_range").orderBy(*order)))
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)], F.col("_range") == F.col("_r"))
    return local.join(sizes, same).withColumn(name, F.col("_local") + F.col("_before")).select(*df.columns, name)
