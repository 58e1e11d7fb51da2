"""Consecutive numbers without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def numbered(df: DataFrame, order: list[str | Column], name: str, start: int = 0) -> DataFrame:
    """df with consecutive numbers in a total order: range-partitioned sort, counts per partition, offsets (one row a partition)."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialize(rows.withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "numbered")
    counts = rows.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_o", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_o")
    return rows.join(F.broadcast(before), "_p").withColumn(name, F.col("_o") + F.col("_i") + start).drop("_p", "_i", "_o")


def head_tail_split(df: DataFrame, order: list[str], percent: int) -> DataFrame:
    """split: 'validation' for the first percent of the rows in order, 'train' for the rest."""
    n = df.count()
    out = numbered(df, order, "_nr")
    return out.withColumn("split", F.when(F.col("_nr") < n * percent // 100, "validation").otherwise("train")).drop("_nr")


def prefix_subset(df: DataFrame, order: list[str | Column], rows: int) -> DataFrame:
    """The first rows in a total order (a limit on the sort, so no task sorts more than it keeps)."""
    return df.orderBy(*order).limit(rows)


def occurrence_ids(df: DataFrame, map_col: str, order: list[str], name: str = "occurrence") -> DataFrame:
    """A row for each key of a map column, in the map's order, numbered through the whole table from 0."""
    rows = df.select(*order, F.posexplode(F.map_keys(map_col)).alias("_at", "key"))
    return numbered(rows, [*order, "_at"], name).drop("_at")
