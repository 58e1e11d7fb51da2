"""Incremental merging of a delta index into an existing one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def delta_documents(new: DataFrame, old: DataFrame, key: str = "title") -> tuple[DataFrame, DataFrame]:
    """(documents whose key is new, documents whose key is gone); NULL keys belong to neither."""
    a, b = new.filter(F.col(key).isNotNull()), old.filter(F.col(key).isNotNull())
    return a.join(b.select(key), key, "left_anti"), b.join(a.select(key), key, "left_anti")


def upsert_entities(old: DataFrame, delta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged, mapping delta id -> old id). Rows of one title merge: id and type of the old one, descriptions and text units of both, old first."""
    cols = ["id", "title", "type", "descriptions", "text_unit_ids"]
    mapping = delta.select("title", F.col("id").alias("delta_id")).join(old.select("title", F.col("id").alias("old_id")), "title").select("delta_id", "old_id")
    rows = old.select(*cols).withColumn("_o", F.lit(0)).unionByName(delta.select(*cols).withColumn("_o", F.lit(1)))
    merged = rows.groupBy("title").agg(
        F.min_by("id", "_o").alias("id"), F.min_by("type", "_o").alias("type"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_o", "descriptions"))), lambda x: x["descriptions"])).alias("descriptions"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_o", "text_unit_ids"))), lambda x: x["text_unit_ids"]))).alias("text_unit_ids"),
    )
    return merged, mapping


def upsert_relationships(old: DataFrame, delta: DataFrame) -> DataFrame:
    """Rows of one (source, target) merge: id of the old one, mean weight, both descriptions; degrees as counts of rows (source and target side)."""
    from .graph import degree_of_update

    cols = ["id", "source", "target", "descriptions", "weight"]
    rows = old.select(*cols).withColumn("_o", F.lit(0)).unionByName(delta.select(*cols).withColumn("_o", F.lit(1)))
    merged = rows.groupBy("source", "target").agg(
        F.min_by("id", "_o").alias("id"), F.avg("weight").alias("weight"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_o", "descriptions"))), lambda x: x["descriptions"])).alias("descriptions"),
    )
    return degree_of_update(merged)


def moved_communities(old: DataFrame, delta: DataFrame) -> DataFrame:
    """Delta rows with communities renumbered past the greatest old one, their parents too; -1 stays -1."""
    top = old.agg(F.coalesce(F.max("community"), F.lit(-1)).alias("_m"))
    shift = lambda c: F.when(F.col(c) == -1, -1).otherwise(F.col(c) + F.col("_m") + 1)
    return delta.crossJoin(F.broadcast(top)).withColumns({"community": shift("community"), "parent": shift("parent")}).drop("_m")


def append_communities(old: DataFrame, delta: DataFrame) -> DataFrame:
    return old.unionByName(moved_communities(old, delta))


def remap_ids(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """df (with a key id) with ids inside an array column replaced where mapping(delta_id, old_id) has them, in order."""
    e = df.select("id", F.posexplode(column).alias("_i", "_x")).join(mapping.withColumnRenamed("delta_id", "_x"), "_x", "left")
    back = e.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", F.coalesce("old_id", "_x").alias("v")))), lambda x: x["v"]).alias("_new"))
    return df.join(back, "id", "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def append_text_units(old: DataFrame, delta: DataFrame, mapping: DataFrame) -> DataFrame:
    return old.unionByName(remap_ids(delta, "entity_ids", mapping).select(*old.columns))


def append_renumbered(old: DataFrame, delta: DataFrame, column: str = "human_readable_id") -> DataFrame:
    """Union with the delta's numbers continued from the old maximum."""
    top = old.agg(F.coalesce(F.max(column), F.lit(-1)).alias("_m"))
    return old.unionByName(delta.crossJoin(F.broadcast(top)).withColumn(column, F.col(column) + F.col("_m") + 1).drop("_m").select(*old.columns))


def missing_rows(todo: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """What is left to do: rows whose key isn't among those done."""
    return todo.join(done.select(*key).distinct(), key, "left_anti")
