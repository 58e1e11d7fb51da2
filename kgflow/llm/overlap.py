"""Problem 1: same or near-same records across splits (disjoint grams by the pigeonhole principle, chained seeds, alignment)."""

from __future__ import annotations

from bisect import bisect_right
from collections import deque
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize, spread
from .norm import words
from .winnow import gram_hashes, unit_ids

#: Words of a gram; records outside train of under SHORT words need grams of SHORT_K to hold enough disjoint ones.
K, SHORT_K, SHORT = 3, 2, 12
#: Words of a block, inside which a record's grams are chosen together.
BLOCK = 64
#: Buckets in which grams of train are counted (1 MB), and bits that tell which grams were chosen (4 MB; 16 MB for over MANY grams).
SKETCH, BITS, MANY = 1 << 18, 1 << 25, 2_000_000
#: Grams of train up to which all are joined at once; more are joined in PASSES parts by their hashes, one after another, so that their files never lie on disk together.
AT_ONCE, PASSES = 50_000_000, 4
#: Records a gram has in one group of the join, about: those of a more frequent gram are spread over several.
GROUP = 20_000
PIECE = 4_000


def distance(a: list[str], b: list[str], most: int) -> int:
    """Word edit distance of a and b, or most + 1 if it is greater (bit-parallel over b's words)."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    lo, end_a, end_b = 0, len(a), len(b)
    while lo < end_a and lo < end_b and a[lo] == b[lo]:
        lo += 1
    while end_a > lo and end_b > lo and a[end_a - 1] == b[end_b - 1]:
        end_a, end_b = end_a - 1, end_b - 1
    a, b = a[lo:end_a], b[lo:end_b]
    if not a or not b:
        return min(len(a) + len(b), most + 1)
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    m = len(a)
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    for j, w in enumerate(b):
        eq = at.get(w, 0)
        xv = eq | mv
        xh = ((eq & pv) + pv ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        score += bool(ph & high) - bool(mh & high)
        if score - (len(b) - 1 - j) > most:
            return most + 1
        ph, mh = (ph << 1 | 1) & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
    return min(score, most + 1)


def chain(seeds: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
    """The longest chain of seeds (places of equal k-grams) in which each begins where the one before has ended, or later, on both sides."""
    seeds = sorted(seeds)
    ends, last, before = [0], [-1], []  # of the chains of each length the least end in the second text, and the seed that ends it
    waiting: deque[tuple[int, int]] = deque()  # (seed, its chain's length) that later seeds may not follow yet
    for n, (x, y) in enumerate(seeds):
        while waiting and seeds[waiting[0][0]][0] + k <= x:
            m, size = waiting.popleft()
            end = seeds[m][1] + k
            if size == len(ends):
                ends.append(end)
                last.append(m)
            elif end < ends[size]:
                ends[size], last[size] = end, m
        size = bisect_right(ends, y)
        before.append(last[size - 1])
        waiting.append((n, size))
    for m, size in waiting:
        if size == len(ends):
            ends.append(seeds[m][1] + k)
            last.append(m)
    at, out = last[-1], []
    while at >= 0:
        out.append(seeds[at])
        at = before[at]
    return out[::-1]


def extended(a: list[str], b: list[str], seeds: list[tuple[int, int]], k: int, most: int) -> tuple[int, int]:
    """(edits, seeds chained) of a and b aligned from their chained seeds: what lies before, between and after the seeds is aligned piece by piece.

    It is the edit distance or, where the chain isn't on a best alignment, somewhat more; most + 1 stands for more than `most`.
    """
    chained, edits, x, y = chain(seeds, k), 0, 0, 0
    for i, j in [*chained, (len(a), len(b))]:
        edits += distance(a[x:i], b[y:j], most - edits)
        if edits > most:
            return most + 1, len(chained)
        x, y = i + k, j + k
    return edits, len(chained)


def classes_of(df: DataFrame, id_col: str, text_col: str, is_train: Column, is_eval: Column) -> tuple[DataFrame, DataFrame]:
    """(classes, members). classes: cls (the least id of records with equal word sequences), w, train, eval. members: cls, id, train."""
    rows = df.select(F.col(id_col).alias("id"), words(text_col).alias("w"), is_train.alias("train"), is_eval.alias("eval")).filter("w <> '' AND id IS NOT NULL AND (train OR eval)")
    classes = materialize(rows.groupBy("w").agg(F.min("id").alias("cls"), F.max("train").alias("train"), F.max("eval").alias("eval")), "classes")
    key = [F.xxhash64("w").alias("h1"), F.xxhash64(F.lit("2"), "w").alias("h2")]
    members = rows.select("id", "train", "eval", *key).join(classes.select("cls", *key), ["h1", "h2"])
    return classes, materialize(members.select("cls", "id", "train", "eval"), "members")


def grams_of(pdf: pd.DataFrame, k: int, seen: dict[str, int]) -> tuple[np.ndarray, ...]:
    """(record number, place, hash) of every k-gram, words of each record, and two columns of 64 bits that tell which words it holds."""
    coded = [unit_ids(w.split(" "), seen) for w in pdf["w"]]
    if len(seen) > 300_000:
        seen.clear()
    sizes, ids = np.array([len(c) for c in coded], dtype=np.int64), np.concatenate(coded)
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sizes)), sizes)
    n = max(len(ids) - k + 1, 0)
    inside = np.flatnonzero(owner[:n] == owner[k - 1 : k - 1 + n])
    mixed = gram_hashes(ids, 1)
    bit = np.uint64(1) << (mixed & np.uint64(63))
    half = (mixed >> np.uint64(6) & np.uint64(1)).astype(bool)
    held = np.stack([np.bitwise_or.reduceat(np.where(half == h, bit, np.uint64(0)), starts) for h in (False, True)])
    return owner[inside], inside - starts[owner[inside]], gram_hashes(ids, k)[inside], sizes, held


def bucket(fp: np.ndarray) -> np.ndarray:
    return (fp >> np.uint64(30) & np.uint64(SKETCH - 1)).astype(np.int64)


def by_length(whole: pd.DataFrame) -> list[tuple[pd.DataFrame, int]]:
    """Records of train by the words a gram of theirs holds: a record of SHORT words is near to ones of 4/5 as many and of 5/4 as many."""
    n = whole["w"].str.count(" ") + 1
    return [(whole[n * 5 >= SHORT * 4], K), (whole[(n >= 4) & (n * 4 < SHORT * 5)], SHORT_K)]


def gram_counts(train: DataFrame) -> np.ndarray:
    """For each bucket of grams, how many there are in the records, all of which are counted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, int] = {}
        n = np.zeros(SKETCH, np.int64)
        for whole in batches:
            for pdf, k in by_length(whole):
                for at in range(0, len(pdf), PIECE):
                    n += np.bincount(bucket(grams_of(pdf.iloc[at : at + PIECE], k, seen)[2]), minlength=SKETCH)
        b = np.flatnonzero(n)
        yield pd.DataFrame({"b": b.astype(np.int32), "n": n[b]})

    table = materialize(spread(train.select("w")).mapInPandas(run, "b int, n long").groupBy("b").agg(F.sum("n").alias("n")), "counts")
    got = table.toPandas()
    discard(table)
    out = np.zeros(SKETCH, np.float32)
    out[got["b"].to_numpy(dtype=int)] = got["n"].to_numpy(dtype=float)
    return out


def choose(cost: np.ndarray, sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of size // 4 + 1 k-grams of each row that share no word and together cost least; cost has one more row of places than needed."""
    want = sizes // 4 + 1
    longest, most = int(sizes.max()), int(want.max())
    best = [np.full((len(sizes), most + 1), np.inf, np.float32)]
    best[0][:, 0] = 0
    take = [np.zeros((len(sizes), most + 1), bool)]
    for i in range(1, longest + 1):
        skip = best[-1]
        use = np.full_like(skip, np.inf)
        if i >= k:
            use[:, 1:] = best[i - k][:, :-1] + cost[:, i - k, None]
        take.append(use < skip)
        best.append(np.minimum(use, skip))
    at, left, rows, places = sizes.copy(), want.copy(), [], []
    for i in range(longest, 0, -1):
        here = np.flatnonzero((at == i) & (left > 0))
        got = take[i][here, left[here]]
        rows.append(here[got])
        places.append(np.full(got.sum(), i - k))
        at[here] -= np.where(got, k, 1)
        left[here] -= got
    return np.concatenate(rows), np.concatenate(places)


def chosen_grams(held_out: DataFrame, counts: np.ndarray) -> DataFrame:
    """fp, salt, e, ea, en, e1, e2: n // 4 + 1 grams of each record of n words that share no word."""
    sent = held_out.sparkSession.sparkContext.broadcast(counts)

    def some(pdf: pd.DataFrame, k: int, seen: dict[str, int]) -> pd.DataFrame:
        owner, place, fp, n, held = grams_of(pdf, k, seen)
        count = sent.value[bucket(fp)]
        # blocks of about equal size, with n // 4 + 1 grams each
        blocks = -(-n // BLOCK)
        first = np.cumsum(blocks) - blocks
        of = np.repeat(np.arange(len(n)), blocks)
        part = np.arange(len(of)) - first[of]
        lo, hi = n[of] * part // blocks[of], n[of] * (part + 1) // blocks[of]
        begin = np.cumsum(n - k + 1) - (n - k + 1)  # of a record's grams
        wide = np.minimum(lo[:, None] + np.arange(BLOCK), (n[of] - k)[:, None])
        row, at = choose(count[begin[of][:, None] + wide], hi - lo, k)
        g = begin[of[row]] + lo[row] + at
        g = g[np.lexsort((place[g], count[g], owner[g]))]
        i = np.arange(len(g)) - np.searchsorted(owner[g], owner[g])
        g = g[i <= n[owner[g]] // 4]
        parts = 1 + (count[g] // GROUP).astype(np.int64)
        salt = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        g = np.repeat(g, parts)
        o = owner[g]
        return pd.DataFrame({"fp": fp[g].view(np.int64), "salt": salt.astype(np.int32), "e": pdf["cls"].to_numpy()[o], "ea": place[g].astype(np.int32), "en": n[o].astype(np.int32), "e1": held[0][o].view(np.int64), "e2": held[1][o].view(np.int64)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, int] = {}
        for whole in batches:
            n = whole["w"].str.count(" ") + 1
            for pdf, k in ((whole[n >= SHORT], K), (whole[(n >= 4) & (n < SHORT)], SHORT_K)):
                for at in range(0, len(pdf), PIECE):
                    yield some(pdf.iloc[at : at + PIECE], k, seen)

    kind = dict(held_out.dtypes)["cls"]
    return spread(held_out).mapInPandas(run, f"fp long, salt int, e {kind}, ea int, en int, e1 long, e2 long")


def part_of(passes: int) -> Column:
    """Which of `passes` parts a gram belongs to."""
    return F.pmod(F.expr("shiftrightunsigned(fp, 40)"), F.lit(passes))


def matching_grams(train: DataFrame, counts: np.ndarray, chosen: DataFrame, size: int, part: int = 0, passes: int = 1) -> DataFrame:
    """fp, salt, t, ta, tn, t1, t2: all grams of the records, of one part of `passes`, that may be among the chosen ones; a bitmap of `size` bits tells."""
    bits = chosen.groupBy(F.expr(f"shiftright(fp & {size - 1}, 6)").cast("int").alias("b")).agg(F.expr("bit_or(shiftleft(1L, int(fp & 63)))").alias("m")).toPandas()
    bitmap = np.zeros(size >> 6, np.uint64)
    bitmap[bits["b"].to_numpy(dtype=int)] = bits["m"].to_numpy(dtype=np.int64).view(np.uint64)
    sent = train.sparkSession.sparkContext.broadcast((bitmap, counts))

    def some(pdf: pd.DataFrame, k: int, seen: dict[str, int]) -> pd.DataFrame:
        owner, place, fp, n, held = grams_of(pdf, k, seen)
        known = sent.value[0][(fp & np.uint64(size - 1)) >> np.uint64(6)] >> (fp & np.uint64(63)) & np.uint64(1)
        g = np.flatnonzero(known.astype(bool) & ((fp >> np.uint64(40)) % np.uint64(passes) == np.uint64(part)))
        o, fp = owner[g], fp[g]
        parts = 1 + (sent.value[1][bucket(fp)] // GROUP).astype(np.uint64)
        cls = pdf["cls"].to_numpy()
        salt = (pd.util.hash_array(cls)[o] % parts).astype(np.int32)
        return pd.DataFrame({"fp": fp.view(np.int64), "salt": salt, "t": cls[o], "ta": place[g].astype(np.int32), "tn": n[o].astype(np.int32), "t1": held[0][o].view(np.int64), "t2": held[1][o].view(np.int64)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, int] = {}
        for whole in batches:
            for pdf, k in by_length(whole):
                for at in range(0, len(pdf), PIECE):
                    yield some(pdf.iloc[at : at + PIECE], k, seen)

    kind = dict(train.dtypes)["cls"]
    return spread(train).mapInPandas(run, f"fp long, salt int, t {kind}, ta int, tn int, t1 long, t2 long")


def near_pairs(classes: DataFrame) -> DataFrame:
    """t, e, words, dist, seeds: all pairs of different classes, t with a record in train and e with one outside, within the distance.

    dist is at most a fifth of the longer word sequence, d. A record of n words outside train chooses n // 4 + 1 grams that share
    no word, the rarest there are: no partner is longer than 5/4 n, so d < n // 4 + 1, an edit spoils one of them at most, and of
    them n // 4 + 1 - d or more stand in the partner whole, at places that the edits before and after them allow; pairs with fewer
    are dropped. Train's grams are all looked up, so no pair is missed, however frequent the gram; pairs with more than d different words on either side (as
    far as 128 bits tell) are dropped before the texts are joined. Records of under 4 words are near to equal ones only.
    The pair's seeds are chained and the chain is extended by alignment on all sides; where that takes too many edits, the exact distance of the whole
    texts decides. dist is the edits of the alignment found, at most a fifth of the words and hardly ever more than the distance.
    """
    train, held_out = classes.filter("train").select("cls", "w"), classes.filter("eval").select("cls", "w")
    counts = gram_counts(train)
    chosen = materialize(chosen_grams(held_out, counts), "chosen")
    most = "greatest(tn, en) div 5"
    near = f"t <> e AND abs(ta - ea) + abs(tn - en - ta + ea) <= {most} AND bit_count(t1 & ~e1) + bit_count(t2 & ~e2) <= {most} AND bit_count(e1 & ~t1) + bit_count(e2 & ~t2) <= {most}"
    passes = PASSES if counts.sum(dtype=np.float64) > AT_ONCE else 1
    size = BITS if chosen.count() <= MANY else 4 * BITS
    need = F.max(F.expr(f"en div 4 + 1 - {most}")).alias("need")  # chosen grams that the edits must leave
    enough = "size(array_distinct(seeds.ea)) >= need"
    # a pair shares at most the n // 4 + 1 grams that its record outside train has chosen, at the few places that edits allow
    found = []
    for part in range(passes):
        some = chosen.filter(part_of(passes) == part) if passes > 1 else chosen
        met = matching_grams(train, counts, some, size, part, passes).join(some, ["fp", "salt"]).filter(near)
        met = met.groupBy("t", "e").agg(F.array_sort(F.collect_set(F.struct("ta", "ea"))).alias("seeds"), need)
        found.append(materialize(met.filter(enough) if passes == 1 else met, "pairs"))
    discard(chosen)
    pairs = found[0]
    if passes > 1:
        pairs = materialize(reduce(DataFrame.unionByName, found).groupBy("t", "e").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("seeds")))).alias("seeds"), F.max("need").alias("need")).filter(enough), "pairs")
        discard(*found)
    texts, narrow = classes.select("cls", "w"), pairs
    pairs = pairs.join(texts.select(F.col("cls").alias("t"), F.col("w").alias("tw")), "t").join(texts.select(F.col("cls").alias("e"), F.col("w").alias("ew")), "e")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for t, e, tw, ew, ta, ea in zip(pdf["t"], pdf["e"], pdf["tw"], pdf["ew"], pdf["ta"], pdf["ea"]):
                x, y = tw.split(" "), ew.split(" ")
                most = max(len(x), len(y)) // 5
                left = set(x)
                if len(y) - sum(map(left.__contains__, y)) > most:
                    continue
                d, n = extended(x, y, list(zip(ta.tolist(), ea.tolist())), K if len(y) >= SHORT else SHORT_K, most)
                if d > most:  # the chain may have missed the best alignment
                    d = distance(x, y, most)
                if d <= most:
                    rows.append((t, e, max(len(x), len(y)), d, n))
            yield pd.DataFrame(rows, columns=["t", "e", "words", "dist", "seeds"])

    kind = dict(classes.dtypes)["cls"]
    near = materialize(pairs.select("t", "e", "tw", "ew", F.col("seeds.ta").alias("ta"), F.col("seeds.ea").alias("ea")).mapInPandas(run, f"t {kind}, e {kind}, words int, dist int, seeds int"), "near")
    discard(narrow)
    return near


def split_overlaps(df: DataFrame, id_col: str = "id", text_col: str = "text", split_col: str = "split_name", train: str = "train") -> tuple[DataFrame, DataFrame]:
    """(links, members): links has t, e, words, dist, seeds for pairs of classes (t = e for equal word sequences), members has cls, id, train, eval.

    A class holds the records of one word sequence (letters and digits, lower case), so copies are compared once. A class
    pair is linked if t has a record in the train split, e one in another split, and their word edit distance is at most
    a fifth of the longer. NULL texts, texts without words, rows with NULL id or split take no part; a row given twice is one
    more member. Groups of equal texts never meet pairwise here; only their fingerprints' classes do.
    """
    classes, members = classes_of(df, id_col, text_col, F.col(split_col) == train, F.col(split_col) != train)
    near = near_pairs(classes)
    same = classes.filter("train AND eval").select(F.col("cls").alias("t"), F.col("cls").alias("e"), F.size(F.split("w", " ")).alias("words"), F.lit(0).alias("dist"), F.lit(0).alias("seeds"))
    links = materialize(near.unionByName(same), "links")
    discard(near, classes)
    return links, members


def found_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """id_a < id_b: every pair of records behind the class links, one in train and the other not."""
    a = members.filter("train").select(F.col("cls").alias("t"), F.col("id").alias("x"))
    b = members.filter("eval").select(F.col("cls").alias("e"), F.col("id").alias("y"))
    pairs = links.select("t", "e").join(a, "t").join(b, "e").filter("x <> y")
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def record_coverage(df: DataFrame, links: DataFrame, members: DataFrame, id_col: str = "id", split_col: str = "split_name", source_col: str = "source") -> DataFrame:
    """id, split_name, source, share: for each row the share of its words that its best link across the splits keeps; NULL without one. Of rows with one id in several classes the best counts."""
    share = (1 - F.col("dist") / F.col("words")).alias("share")
    best = links.select(F.col("t").alias("cls"), F.lit(True).alias("train"), share).unionByName(links.select(F.col("e").alias("cls"), F.lit(False).alias("train"), share))
    best = best.groupBy("cls", "train").agg(F.max("share").alias("share"))
    kept = members.select("cls", "id", "train").distinct().join(best, ["cls", "train"]).groupBy("id").agg(F.max("share").alias("share"))
    return df.select(F.col(id_col).alias("id"), F.col(split_col).alias("split_name"), F.col(source_col).alias("source")).join(kept, "id", "left")


def coverage_report(df: DataFrame, links: DataFrame, members: DataFrame, id_col: str = "id", split_col: str = "split_name", source_col: str = "source") -> DataFrame:
    """split_name, source, records, overlapping, exact, coverage: how much of each split and source occurs across the splits.

    A record overlaps if its class is linked across; coverage is the mean over all records of the share of its words that its
    best link keeps (0 without a link). NULL sources are a group of their own.
    """
    rows = record_coverage(df, links, members, id_col, split_col, source_col)
    return rows.groupBy("split_name", "source").agg(
        F.count("*").alias("records"), F.count("share").alias("overlapping"), F.count(F.when(F.col("share") == 1, 1)).alias("exact"), F.round(F.avg(F.coalesce("share", F.lit(0.0))), 6).alias("coverage")
    )
