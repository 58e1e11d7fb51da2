"""Problem 6: occurrences and record counts of every distinct value, in a vertical layout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .norm import core


def record_bitmaps(df: DataFrame, id_col: str, term_col: str) -> DataFrame:
    """The vertical layout: term, word (number of a run of 64 record ids), bits (which of them hold the term), occurrences.

    Only runs that hold a set bit are stored, which is what compresses the bitmap; each has its occurrence counter beside it.
    Bitmaps of parts of a table are merged by union: group by term and word, bit_or the bits, add the counters.
    Record ids must be whole numbers (a string id is an error; number such records first, as operators.ids.numbered does).
    Rows whose term is NULL or empty, or whose id is NULL, are left out. All steps combine on the map side, so a term
    or id that holds a third of the rows needs no special care.
    """
    if dict(df.dtypes)[id_col] not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"record ids must be whole numbers, not {dict(df.dtypes)[id_col]}")
    kept = df.select(F.col(id_col).cast("long").alias("_id"), F.col(term_col).alias("term")).filter("_id IS NOT NULL AND term <> ''")
    return kept.groupBy("term", F.shiftright("_id", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(_id & 63 as int))")).alias("bits"), F.count("*").alias("occurrences")
    )


def term_frequencies(df: DataFrame, id_col: str, value_col: str, rare: int = 3, common: float = 0.02) -> DataFrame:
    """term, occurrences, records, mark for each distinct core of value_col.

    records is the cardinality of the term's record bitmap: a record holding a term in several rows counts once.
    mark is 'rare' if records < rare, else 'common' if records > common x distinct ids of the table (rows without a term
    count there too; NULL ids don't), else NULL. NULL and empty values have no term; an empty table has no rows.
    """
    bitmaps = record_bitmaps(df.select(F.col(id_col).alias("_i"), core(value_col).alias("_t")), "_i", "_t")
    counts = bitmaps.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum(F.bit_count("bits").cast("long")).alias("records"))
    ids = df.select(F.col(id_col).cast("long").alias("_id")).filter("_id IS NOT NULL")
    ids = ids.groupBy(F.shiftright("_id", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_id & 63 as int))")).alias("b"))
    total = ids.agg(F.coalesce(F.sum(F.bit_count("b").cast("long")), F.lit(0)).alias("_all"))
    mark = F.when(F.col("records") < rare, "rare").when(F.col("records") > F.lit(common) * F.col("_all"), "common")
    return counts.crossJoin(F.broadcast(total)).select("term", "occurrences", "records", mark.alias("mark"))
