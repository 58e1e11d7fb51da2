"""Problem 4: records that differ only in how their fields are written or placed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .norm import core

#: A group of copies with more rows than this share of the table is joined by broadcast: there are at most 1 / share such groups.
HOT_SHARE = 1e-3
HOT_ROWS = 5_000
#: Relation labels up to which membership is tested with an IN list; more of them are joined.
IN_LIST = 4_096


def multiset_hash(pairs: list[tuple[str, Column]], salt: str) -> Column:
    """Commutative hash of (field name, value) pairs: the order in which the pairs are given doesn't matter.

    Each pair's hash is cut to 56 bits, so that the sum of up to 128 of them can't overflow.
    """
    return reduce(lambda a, b: a + b, [F.shiftrightunsigned(F.xxhash64(F.lit(salt), F.lit(n), v), 8) for n, v in pairs])


def triple_roles(df: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Columns row_id, head, relation, tail holding cores, with the relation label found in whichever column it stands.

    A label in relation_type wins, then one in head, then one in tail; of the other two fields the left one is the head.
    Without any label the columns are taken as they stand. Rows with a NULL field or an empty core are left out.
    """
    names = ("head", "relation_type", "tail")
    cores = df.select("row_id", *[core(n).alias(f"_{i}") for i, n in enumerate(names)])
    cores = cores.filter(" AND ".join(f"_{i} IS NOT NULL AND _{i} <> ''" for i in range(3)))
    flags = [F.lit(False)] * 3
    if labels is not None:
        known = labels.select(core("relation_type").alias("label")).filter("label <> ''").distinct()
        rows = known.limit(IN_LIST + 1).collect()
        if len(rows) <= IN_LIST:
            flags = [F.col(f"_{i}").isin([r.label for r in rows]) for i in range(3)]
        else:
            for i in range(3):
                cores = cores.join(known.select(F.col("label").alias(f"_{i}"), F.lit(True).alias(f"is{i}")), f"_{i}", "left")
            flags = [F.coalesce(F.col(f"is{i}"), F.lit(False)) for i in range(3)]
    at = F.when(flags[1], 1).when(flags[0], 0).when(flags[2], 2).otherwise(1)
    return cores.select(
        "row_id",
        F.when(at == 0, F.col("_1")).otherwise(F.col("_0")).alias("head"),
        F.when(at == 0, F.col("_0")).when(at == 2, F.col("_2")).otherwise(F.col("_1")).alias("relation"),
        F.when(at == 2, F.col("_1")).otherwise(F.col("_2")).alias("tail"),
    )


def copies(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """One row for each input row: id_col, kept (the least id of its set of copies) and n_copies.

    Rows with equal `fields` are copies. They are grouped by two 56-bit multiset hashes of the (field name, value) pairs,
    aggregated on the map side first, and rows meet their group in a hash join; groups holding more than a thousandth of the rows are
    joined by broadcast. Fields of all members are then compared: grouped by fingerprint and values (a hash aggregation as well), a set
    that turns out to hold different values is divided by them, so a hash collision merges nothing. Nothing is sorted.
    Repeated ids are copies of one another only if their fields are equal too. NULL in a field is a value of its own.
    An empty table gives an empty result.
    """
    pairs = [(f, F.coalesce(F.col(f).cast("string"), F.lit("\0"))) for f in fields]
    named = [F.col(f).alias(f"_f{i}") for i, f in enumerate(fields)]
    rows = materialize(df.select(F.col(id_col).alias("_id"), *named, multiset_hash(pairs, "a").alias("_a"), multiset_hash(pairs, "b").alias("_b")), "copies")
    values, key = [f"_f{i}" for i in range(len(fields))], ["_a", "_b"]
    groups = rows.groupBy(*key).agg(F.min("_id").alias("kept"), F.count("*").alias("n_copies")).filter("n_copies > 1")
    groups = materialize(groups, "groups")
    total = groups.agg(F.sum("n_copies")).first()[0] or 0
    most = max(HOT_ROWS, HOT_SHARE * total)
    hot, cold = groups.filter(F.col("n_copies") > most), groups.filter(F.col("n_copies") <= most)
    rest, found = rows, None
    if not hot.isEmpty():
        found = rows.join(F.broadcast(hot), key)
        rest = rows.join(F.broadcast(hot.select(*key)), key, "left_anti")
    met = rest.join(cold.hint("shuffle_hash"), key, "left")
    joined = materialize(met if found is None else met.unionByName(found), "joined")
    members = joined.filter("n_copies IS NOT NULL")
    sets = members.groupBy(*key, *values).agg(F.min("_id").alias("_kept"), F.count("*").alias("_n"))
    mixed = materialize(sets.groupBy(*key).agg(F.count("*").alias("_sets")).filter("_sets > 1").select(*key), "mixed")
    if mixed.isEmpty():
        return joined.select(F.col("_id").alias(id_col), F.coalesce("kept", "_id").alias("kept"), F.coalesce("n_copies", F.lit(1).cast("long")).alias("n_copies"))
    # fingerprints that different values share, next to never
    same = [F.col(f"m.{v}").eqNullSafe(F.col(f"s.{v}")) for v in (*key, *values)]
    odd = members.join(mixed, key, "left_semi").alias("m").join(sets.join(mixed, key, "left_semi").alias("s"), reduce(lambda a, b: a & b, same))
    sure = joined.join(mixed, key, "left_anti").select(F.col("_id").alias(id_col), F.coalesce("kept", "_id").alias("kept"), F.coalesce("n_copies", F.lit(1).cast("long")).alias("n_copies"))
    return sure.unionByName(odd.select(F.col("m._id").alias(id_col), F.col("s._kept").alias("kept"), F.col("s._n").alias("n_copies")))


def triple_copies(triples: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Copies among triples, whatever column the relation label stands in: row_id, kept, n_copies."""
    return copies(triple_roles(triples, labels), "row_id", ["head", "relation", "tail"])
