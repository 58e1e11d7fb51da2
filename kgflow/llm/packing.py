"""Problem 7: documents of varying token length packed into sequences of fixed capacity (swap-based local search)."""

from __future__ import annotations

import os
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, spread

#: Place of the vocabulary file of a public tokenizer.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Sequences that one task fills: documents are dealt at random to groups of about so many.
GROUP_SEQUENCES = 500
#: Tasks at most that fill groups; each fills its groups one after another.
TASKS = 20_000
#: Copies of one document and size that one row lists.
BLOCK = 10_000
PIECE = 500


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """id_col, n_tokens: tokens of each whole text under a public tokenizer; 0 for NULL and empty texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer)
        t.encode_special_tokens = True
        for whole in batches:
            for at in range(0, len(whole), PIECE):
                pdf = whole.iloc[at : at + PIECE]
                sizes = [len(x) for x in t.encode_batch_fast([x or "" for x in pdf["t"]], add_special_tokens=False)]
                yield pd.DataFrame({id_col: pdf[id_col], "n_tokens": sizes})

    rows = df.select(id_col, F.col(text_col).alias("t"))
    return spread(rows).mapInPandas(run, f"{id_col} {dict(df.dtypes)[id_col]}, n_tokens long")


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Items (by number) in bins: in falling size, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect_left(room, (sizes[i], -1))
        if at < len(room):
            left, b = room.pop(at)
            bins[b].append(i)
        else:
            left, b = capacity, len(bins)
            bins.append([i])
        insort(room, (left - sizes[i], b))
    return bins


def local_search(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins after exchanges between underfull ones, each of which raises the sum of squared fills, until none helps (the sum is bounded, so it ends).

    The emptiest bin gives: an item moves to the fullest bin that has room for it; or it is exchanged for a smaller item of
    a fuller bin, or for two items of it that are smaller together, so that the fuller bin becomes fuller. A bin that
    has given all its items is gone.
    """
    fill = [sum(sizes[i] for i in b) for b in bins]
    tried: set[int] = set()
    while True:
        open_bins = sorted((b for b in range(len(bins)) if 0 < fill[b] < capacity and b not in tried), key=lambda b: (fill[b], b))
        if len(open_bins) < 2:
            break
        giver, others, changed = open_bins[0], sorted((b for b in range(len(bins)) if 0 < fill[b] < capacity), key=lambda b: (-fill[b], b)), False
        for i in sorted(bins[giver], key=lambda i: -sizes[i]):
            for b in others:
                if b == giver or fill[b] < fill[giver]:
                    continue
                room = capacity - fill[b]
                if sizes[i] <= room:
                    out: list[int] = []
                elif one := [j for j in bins[b] if 0 < sizes[i] - sizes[j] <= room]:
                    out = [min(one, key=lambda j: (sizes[j], j))]
                else:
                    out = _two(bins[b], sizes, sizes[i] - room, sizes[i] - 1)
                    if not out:
                        continue
                gone = sum(sizes[j] for j in out)
                bins[giver].remove(i)
                bins[b].append(i)
                for j in out:
                    bins[b].remove(j)
                    bins[giver].append(j)
                fill[b] += sizes[i] - gone
                fill[giver] += gone - sizes[i]
                changed = True
                break
        if changed:
            tried.clear()
        else:
            tried.add(giver)
    return [b for b in bins if b]


def _two(items: list[int], sizes: list[int], least: int, most: int) -> list[int]:
    """Two items whose sizes add up to least..most, as small together as there are; or none."""
    by = sorted(items, key=lambda i: (sizes[i], i))
    best: tuple[int, list[int]] | None = None
    for x, i in enumerate(by):
        for j in by[x + 1 :]:
            s = sizes[i] + sizes[j]
            if s > most or (best and s >= best[0]):
                break
            if s >= least:
                best = (s, [i, j])
    return best[1] if best else []


def pack(sizes: DataFrame, capacity: int, id_col: str = "doc_id", size_col: str = "n_tokens") -> DataFrame:
    """id_col, part_no, sequence_id, offset, n_tokens: where each document lies.

    A document of at most `capacity` tokens is one part. A longer one is divided into full sequences and a rest, which is
    packed like a document. Rows of one id and size are counted and numbered; groups of about GROUP_SEQUENCES sequences are dealt by the
    hash of id, size and number, so hot ids don't gather and the result depends on the rows alone. Each group is filled by best
    fit and then improved by local search until no exchange helps; groups have partitions of their own (up to TASKS), whatever their
    size in bytes. Documents without tokens get one part of size 0 and no sequence. Repeated rows are documents of their own. An
    empty table has no rows.
    """
    kind = dict(sizes.dtypes)[id_col]
    rows = sizes.groupBy(F.col(id_col).alias("_id"), F.coalesce(F.col(size_col).cast("long"), F.lit(0)).alias("_n")).agg(F.count("*").alias("_c"))
    rows = materialize(rows, "sizes")
    total = rows.agg(F.sum(F.col("_n") * F.col("_c"))).first()[0] or 0
    groups = max(1, round(total / capacity / GROUP_SEQUENCES))
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_c") - 1) / BLOCK)))
    rows = rows.select("_id", "_n", "_c", block.alias("_b"))
    rows = rows.select("_id", "_n", F.explode(F.sequence(F.col("_b") * BLOCK, F.least("_c", (F.col("_b") + 1) * BLOCK) - 1)).alias("_copy"))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_hash", "_copy"], kind="stable")
        group, out, rest, of = int(pdf["_group"].iloc[0]) << 32, [], [], []
        number = 0
        for i, n in zip(pdf["_id"], pdf["_n"]):
            for part in range(n // capacity):
                out.append((i, part, group + number, 0, capacity))
                number += 1
            if n % capacity:
                rest.append(n % capacity)
                of.append((i, n // capacity))
        for b in local_search(best_fit(rest, capacity), rest, capacity):
            at = 0
            for j in sorted(b):
                out.append((*of[j], group + number, at, rest[j]))
                at += rest[j]
            number += 1
        return pd.DataFrame(out, columns=[id_col, "part_no", "sequence_id", "offset", "n_tokens"])

    dealt = rows.filter("_n > 0").withColumn("_hash", F.xxhash64("_id", "_n", "_copy")).withColumn("_group", F.pmod("_hash", F.lit(groups)).cast("int"))
    dealt = dealt.repartition(min(groups, TASKS), "_group")
    schema = f"{id_col} {kind}, part_no int, sequence_id long, offset long, n_tokens long"
    none = rows.filter("_n <= 0").select(F.col("_id").alias(id_col), F.lit(0).alias("part_no"), F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset"), F.lit(0).cast("long").alias("n_tokens"))
    return dealt.groupBy("_group").applyInPandas(fill, schema).unionByName(none)


def packing_checks(packed: DataFrame, sizes: DataFrame, capacity: int, id_col: str = "doc_id", size_col: str = "n_tokens") -> DataFrame:
    """One row on `packed`, the result for `sizes`: documents, over_full (sequences with more than capacity tokens), overlapping
    (parts that don't begin where the one before ends), changed (documents whose parts don't add up to their size), divided (documents in
    several parts which would fit one sequence), wasteful (whether more than 1 in 100 sequences, and one, exceed the least number possible)."""
    order = Window.partitionBy("sequence_id").orderBy("offset")
    seq = packed.filter("sequence_id IS NOT NULL").withColumn("_gap", F.col("offset") != F.coalesce(F.lag(F.col("offset") + F.col("n_tokens")).over(order), F.lit(0)))
    bins = seq.groupBy("sequence_id").agg(F.sum("n_tokens").alias("n"), F.sum(F.col("_gap").cast("int")).alias("gaps"))
    bins = bins.agg(F.count("*").alias("bins"), F.sum("n").alias("n"), F.coalesce(F.sum((F.col("n") > capacity).cast("int")), F.lit(0)).alias("over_full"), F.coalesce(F.sum("gaps"), F.lit(0)).alias("overlapping"))
    want = sizes.groupBy(id_col).agg(F.sum(F.coalesce(F.col(size_col), F.lit(0))).alias("_want"), F.max(F.coalesce(F.col(size_col), F.lit(0))).alias("_most"), F.count("*").alias("_docs"))
    got = packed.groupBy(id_col).agg(F.sum("n_tokens").alias("_got"), F.count("*").alias("_parts"))
    both = want.join(got, want[id_col].eqNullSafe(got[id_col]), "full")
    docs = both.agg(
        F.coalesce(F.sum("_docs"), F.lit(0)).alias("documents"), F.count(F.when(~F.col("_want").eqNullSafe(F.col("_got")), 1)).alias("changed"),
        F.count(F.when((F.col("_most") <= capacity) & (F.col("_parts") != F.col("_docs")), 1)).alias("divided"),
    )
    wasteful = F.col("bins") > F.ceil(F.col("n") / capacity) * 1.01 + 1
    return docs.crossJoin(bins).select("documents", "over_full", "overlapping", "changed", "divided", F.coalesce(wasteful, F.lit(False)).alias("wasteful"))
