"""Problem 8: passages of evaluation items inside training texts (winnowed fingerprints joined, hits extended by alignment)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, spread
from .winnow import hashed_units, unit_characters, winnow

#: Units of a fingerprint at most, of words and of letters.
MOST_WORDS, MOST_LETTERS = 5, 6
#: Item fingerprints up to which an index of them is broadcast (about 40 MB); more of them are joined by shuffle.
BROADCAST_PRINTS = 1_000_000
#: Bits that tell which fingerprints the items hold: 32 for each, in these bounds (8 MB at most).
LEAST_BITS, MOST_BITS = 16, 26
PIECE = 500

_LETTER = regex.compile(r"[\p{L}\p{N}]")
_DENSE = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")


def by_letters(text: str) -> bool:
    """Whether an item is Chinese or Japanese, by the share of its letters."""
    found = _LETTER.findall(text)
    return len(_DENSE.findall(text)) * 3 > len(found)


def runs(same: np.ndarray) -> np.ndarray:
    """For each place of two texts, one place larger than `same` on either side, how many units from there on are equal."""
    out = np.zeros((same.shape[0] + 1, same.shape[1] + 1), np.int32)
    for a in range(same.shape[0] - 1, -1, -1):
        np.multiply(out[a + 1, 1:] + 1, same[a], out=out[a, :-1])
    return out


def reach(run: np.ndarray, i: np.ndarray, j: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(x, y), a row for each place (i, j) and a column for each number of edits up to `most`: the most units of the first text aligned
    from there on, and the units of the second then used. run: as runs gives it."""
    la, lb = run.shape[0] - 1 - i[:, None], run.shape[1] - 1 - j[:, None]
    d = np.arange(-most - 1, most + 2)[None, :]  # units of the first text less those of the second
    low = np.int64(-1 << 20)
    far = np.full((len(i), d.shape[1]), low)
    far[:, most + 1] = 0
    xs, ys = np.zeros((len(i), most + 1), np.int64), np.zeros((len(i), most + 1), np.int64)
    for e in range(most + 1):
        if e:
            side = far.copy()
            side += 1  # replaced
            np.maximum(side[:, 1:], far[:, :-1] + 1, out=side[:, 1:])  # missing in the second text
            np.maximum(side[:, :-1], far[:, 1:], out=side[:, :-1])  # added there
            far = np.minimum(np.minimum(side, la), lb + d)
        ok = (far >= 0) & (far >= d)
        x, y = np.where(ok, far, 0), np.where(ok, far - d, 0)
        far = np.where(ok, far + run[i[:, None] + x, j[:, None] + y], low)
        at = far.argmax(1)
        xs[:, e] = far[np.arange(len(i)), at]
        ys[:, e] = xs[:, e] - d[0, at]
    return xs, ys


def passage(item: np.ndarray, doc: np.ndarray, ip: np.ndarray, dp: np.ndarray, run: int) -> int:
    """The longest stretch of the item (in its units) which the doc holds as one passage with at most an eighth edited, if it is half the
    item; else 0. ip, dp: places of common fingerprints. Those in one run of at least `run` equal units, as any passage has, are extended together."""
    n, most = len(item), len(item) // 8 + 1
    lo, hi = max(0, int(dp.min()) - n - most), int(dp.max()) + n + most + 1
    same = item[:, None] == doc[None, lo:hi]
    ahead, back = runs(same), runs(same[::-1, ::-1])
    j = dp - lo
    w = same.shape[1]
    behind = back[n - ip, w - j]
    _, one = np.unique((ip - j) * (n + 1) + ip - behind, return_index=True)
    one = one[behind[one] + ahead[ip[one], j[one]] >= run]
    if not len(one):
        return 0
    i, j = ip[one], j[one]
    x1, y1 = reach(ahead, i, j, most)
    x2, y2 = reach(back, n - i, w - j, most)
    x, y = x1[:, :, None] + x2[:, None, :], y1[:, :, None] + y2[:, None, :]
    e = np.arange(most + 1)
    best = int(np.where(8 * (e[:, None] + e[None, :]) <= np.maximum(x, y), x, 0).max())
    return best if 2 * best >= n else 0


def cases(n: int) -> Iterator[tuple[int, int, int]]:
    """(units of the item, added units, edits) of the passages that count for an item of n units; beyond 400 units only those of 200."""
    n = min(n, 400)
    for x in range(-(-n // 2), n + 1):
        for added in range(x // 7 + 1):
            if (e := (x + added) // 8) >= added:
                yield x, added, e


def shape(n: int, letters: bool) -> tuple[int, int, int]:
    """(k, window, seeds) for items of n units: every passage of at least half of them, an eighth edited however evenly, keeps `run` units
    in a row, k + window - 1 of which give a common fingerprint; `seeds` is the fewest that all its unchanged runs give together."""
    run = min(-(-(x - e + added) // (e + 1)) for x, added, e in cases(n))
    k = min(run if run < 4 else run - 1, MOST_LETTERS if letters else MOST_WORDS)
    window = run - k + 1
    return k, window, max(1, min(-(-(x - e + added - (k + window - 2) * (e + 1)) // window) for x, added, e in cases(n)))


def prints(units: np.ndarray, sizes: np.ndarray, k: int, window: int, letters: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, place, fingerprint) of winnowed texts; fingerprints of different kinds differ."""
    owner, place, h = winnow(units, sizes, k, window)
    with np.errstate(over="ignore"):
        return owner, place, h * np.uint64(2 * (100 * k + 2 * window + letters) + 1)


def item_prints(items: DataFrame, item_id: str) -> tuple[DataFrame, DataFrame]:
    """(items: no, item, letters, units; prints: fp, no, ip, need, k, window, letters)."""
    kind = dict(items.dtypes)[item_id]
    used = items.sparkSession.sparkContext.broadcast(unit_characters())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shapes: dict[tuple[int, bool], tuple[int, int, int]] = {}
        for pdf in batches:
            rows = []
            for i, text in zip(pdf["i"], pdf["t"]):
                letters = by_letters(text)
                units, sizes = hashed_units([text], letters, used.value)
                if not len(units):
                    continue
                k, window, need = shapes.get((len(units), letters)) or shapes.setdefault((len(units), letters), shape(len(units), letters))
                _, place, fp = prints(units, sizes, k, window, letters)
                rows.append((i, letters, short(units).tobytes(), k, window, need, fp.view(np.int64), place.astype(np.int32)))
            yield pd.DataFrame(rows, columns=["item", "letters", "units", "k", "window", "need", "fp", "ip"])

    rows = items.select(F.col(item_id).alias("i"), F.col("text").alias("t")).filter(r"i IS NOT NULL AND t RLIKE '[\\p{L}\\p{N}]'")
    rows = rows.mapInPandas(run, f"item {kind}, letters boolean, units binary, k int, window int, need int, fp array<long>, ip array<int>")
    rows = materialize(rows.withColumn("no", F.monotonically_increasing_id()), "items")
    flat = rows.select("no", "need", "k", "window", "letters", F.explode(F.arrays_zip("fp", "ip")).alias("p")).select("p.fp", "no", "p.ip", "need", "k", "window", "letters")
    return rows.select("no", "item", "letters", "units"), materialize(flat, "prints")


def short(units: np.ndarray) -> np.ndarray:
    """32 bits of each unit, enough to compare an item with a document."""
    return (units >> np.uint64(32)).astype(np.uint32)


def document_prints(docs: DataFrame, doc_id: str, found: DataFrame) -> DataFrame:
    """r, doc, letters, units, fp, dp: documents with fingerprints that items hold (as a bitmap of bounded size tells), and those fingerprints."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)[doc_id]
    shapes = [tuple(x) for x in found.select("letters", "k", "window").distinct().collect()]  # under twenty
    bits = min(max(LEAST_BITS, (32 * found.count()).bit_length()), MOST_BITS)
    words = found.groupBy(F.expr(f"cast(shiftrightunsigned(fp, {64 - bits + 6}) as int)").alias("b")).agg(F.expr(f"bit_or(shiftleft(1L, cast(shiftrightunsigned(fp, {64 - bits}) & 63 as int)))").alias("m")).toPandas()
    bitmap = np.zeros(1 << (bits - 6), np.uint64)
    bitmap[words["b"].to_numpy(dtype=int)] = words["m"].to_numpy(dtype=np.int64).view(np.uint64)
    sent, used = spark.sparkContext.broadcast(bitmap), spark.sparkContext.broadcast(unit_characters())

    def some(ids: list, texts: list[str], letters: bool) -> pd.DataFrame:
        units, sizes = hashed_units(texts, letters, used.value)
        every = [prints(units, sizes, k, w, letters) for kind, k, w in shapes if kind == letters]
        owner, place, fp = (np.concatenate(x) for x in zip(*every))
        at = fp >> np.uint64(64 - bits)
        known = (sent.value[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        owner, place, fp = owner[known], place[known], fp[known]
        order = np.argsort(owner, kind="stable")
        owner, place, fp = owner[order], place[order].astype(np.int32), fp[order].view(np.int64)
        starts = np.cumsum(sizes) - sizes
        kept, first = np.unique(owner, return_index=True)
        ends = np.append(first[1:], len(owner))
        units = short(units)
        rows = [(ids[t], letters, units[starts[t] : starts[t] + sizes[t]].tobytes(), fp[a:b], place[a:b]) for t, a, b in zip(kept, first, ends)]
        return pd.DataFrame(rows, columns=["doc", "letters", "units", "fp", "dp"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), PIECE):
                pdf = whole.iloc[at : at + PIECE]
                if any(not x[0] for x in shapes):
                    yield some(list(pdf["d"]), list(pdf["t"]), False)
                if any(x[0] for x in shapes):
                    pdf = pdf[[bool(_DENSE.search(t)) for t in pdf["t"]]]
                    if len(pdf):
                        yield some(list(pdf["d"]), list(pdf["t"]), True)

    hits = corpus(docs, doc_id).mapInPandas(run, f"doc {kind}, letters boolean, units binary, fp array<long>, dp array<int>")
    return materialize(hits.withColumn("r", F.monotonically_increasing_id()), "hits")


def pair_bits(units: np.ndarray) -> np.ndarray:
    """11 bits of each pair of neighbouring units."""
    with np.errstate(over="ignore"):
        return (units[:-1] * np.uint32(0x9E3779B1) ^ units[1:] * np.uint32(0x85EBCA77)) >> np.uint32(21)


def span_of(n):
    """Half an item of n units lies in so many units of a text, as an eighth may be added."""
    return -(-n * 9 // 16) + 2


def least_of(n):
    """Pairs of neighbours that half an item of n units has left, as an edit spoils two of them."""
    return np.maximum(1, (0.375 * n).astype(np.int64) - 3)


class Index:
    """Fingerprints and units of a bounded set of items, for searching documents where they are read."""

    def __init__(self, known: pd.DataFrame, found: pd.DataFrame):
        at = {no: i for i, no in enumerate(known["no"])}
        self.ids, self.letters = list(known["item"]), known["letters"].to_numpy(dtype=bool)
        self.units = [np.frombuffer(u, np.uint32) for u in known["units"]]
        self.n = np.array([len(u) for u in self.units], dtype=np.int64)
        fp = found["fp"].to_numpy(dtype=np.int64).view(np.uint64)
        order = np.argsort(fp, kind="stable")
        self.fp, self.item, self.ip = fp[order], found["no"].map(at).to_numpy(dtype=np.int64)[order], found["ip"].to_numpy(dtype=np.int64)[order]
        self.need, self.run = np.ones(len(self.n), np.int64), np.ones(len(self.n), np.int64)
        self.need[self.item] = found["need"].to_numpy(dtype=np.int64)[order]
        self.run[self.item] = (found["k"] + found["window"] - 1).to_numpy(dtype=np.int64)[order]
        # which pairs of neighbours an item has, as far as 2,048 bits tell
        self.bits = np.zeros((len(self.n), 256), np.uint8)
        for i, u in enumerate(self.units):
            h = pair_bits(u)
            np.bitwise_or.at(self.bits[i], h >> np.uint32(3), np.uint8(1) << (h & np.uint32(7)).astype(np.uint8))
        self.span, self.least = span_of(self.n), least_of(self.n)

    def near(self, items: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Those of the items that have enough of their pairs of neighbours in some stretch of the document."""
        if len(doc) < 2:
            return items
        h = pair_bits(doc)
        held = self.bits[items][:, h >> np.uint32(3)] >> (h & np.uint32(7)).astype(np.uint8) & np.uint8(1)
        sums = np.concatenate([np.zeros((len(items), 1), np.int32), np.cumsum(held, axis=1, dtype=np.int32)], axis=1)
        to = np.minimum(np.arange(sums.shape[1]) + self.span[items][:, None], sums.shape[1] - 1)
        return items[((np.take_along_axis(sums, to, 1) - sums).max(1) >= self.least[items]) | (self.n[items] < 3)]  # half of two has no pair

    def search(self, docs: list[np.ndarray], owner: np.ndarray, place: np.ndarray, fp: np.ndarray) -> list[tuple[int, int, int]]:
        """(document, item, units held) from the documents' units and fingerprints."""
        a, b = np.searchsorted(self.fp, fp, "left"), np.searchsorted(self.fp, fp, "right")
        n = b - a
        hit = np.repeat(np.arange(len(fp)), n)
        at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
        pair = owner[hit] * len(self.n) + self.item[at]
        order = np.lexsort((place[hit], self.ip[at], pair))
        pair, hit, at = pair[order], hit[order], at[order]
        first = np.flatnonzero(np.diff(pair, prepend=-1))
        ends = np.append(first[1:], len(pair))
        enough = ends - first >= self.need[pair[first] % len(self.n)]
        first, ends = first[enough], ends[enough]
        doc, item, out = pair[first] // len(self.n), pair[first] % len(self.n), []
        for lo, hi in zip(np.flatnonzero(np.diff(doc, prepend=-1)), np.append(np.flatnonzero(np.diff(doc, prepend=-1))[1:], len(doc))):
            d = docs[doc[lo]]
            for i in self.near(item[lo:hi], d):
                j = lo + int(np.searchsorted(item[lo:hi], i))
                seeds = slice(first[j], ends[j])
                if best := passage(self.units[i], d, self.ip[at[seeds]], place[hit[seeds]], self.run[i]):
                    out.append((int(doc[lo]), int(i), best))
        return out


def searched(docs: DataFrame, doc_id: str, item_id: str, known: DataFrame, found: DataFrame, kinds: tuple[str, str]) -> DataFrame:
    """leaks where the items' fingerprints are few: their index is made once and sent to every executor; documents are searched where they are read."""
    sc = docs.sparkSession.sparkContext
    index = Index(known.orderBy("no").toPandas(), found.toPandas())
    shapes = sorted({tuple(x) for x in found.select("letters", "k", "window").distinct().collect()})
    sent, used = sc.broadcast(vars(index)), sc.broadcast(unit_characters())

    def some(ids: list, texts: list[str], letters: bool) -> list[tuple]:
        ix = Index.__new__(Index)
        vars(ix).update(sent.value)
        units, sizes = hashed_units(texts, letters, used.value)
        owner, place, fp = (np.concatenate(x) for x in zip(*[prints(units, sizes, k, w, letters) for kind, k, w in shapes if kind == letters]))
        docs = np.split(short(units), np.cumsum(sizes)[:-1])
        best: dict[tuple, int] = {}
        for t, i, held in ix.search(docs, owner, place, fp):
            key = (t, ix.ids[i])
            best[key] = max(best.get(key, 0), held / ix.n[i])
        return [(ids[t], i, held) for (t, i), held in best.items()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), PIECE):
                pdf, out = whole.iloc[at : at + PIECE], []
                for letters in sorted({x[0] for x in shapes}):
                    part = pdf[[bool(_DENSE.search(t)) for t in pdf["t"]]] if letters else pdf
                    if len(part):
                        out += some(list(part["d"]), list(part["t"]), letters)
                yield pd.DataFrame(out, columns=[doc_id, item_id, "held"])

    return corpus(docs, doc_id).mapInPandas(run, f"{doc_id} {kinds[0]}, {item_id} {kinds[1]}, held double")


def corpus(docs: DataFrame, doc_id: str) -> DataFrame:
    return spread(docs.select(F.col(doc_id).alias("d"), F.col("text").alias("t")).filter(r"t RLIKE '[\\p{L}\\p{N}]'"))


def joined(docs: DataFrame, doc_id: str, item_id: str, known: DataFrame, found: DataFrame, kinds: tuple[str, str]) -> DataFrame:
    """leaks for any number of items: fingerprints meet in a join, the pairs they make are counted, then texts are fetched for them."""
    hits = document_prints(docs, doc_id, found)
    flat = hits.select("r", F.explode(F.arrays_zip("fp", "dp")).alias("p")).select("r", "p.fp", "p.dp")
    pairs = flat.join(found.select("fp", "no", "ip", "need", (F.col("k") + F.col("window") - 1).alias("run")), "fp").groupBy("r", "no", "need", "run").agg(F.collect_list(F.struct("ip", "dp")).alias("seeds"))
    pairs = pairs.filter(F.size("seeds") >= F.col("need")).select("r", "no", "run", F.array_sort("seeds").alias("seeds"))
    pairs = pairs.join(known.select("no", "item", F.col("units").alias("iu")), "no").join(hits.select("r", "doc", F.col("units").alias("du")), "r")
    pairs = pairs.select("r", "doc", "item", "du", "iu", "run", F.col("seeds.ip").alias("ip"), F.col("seeds.dp").alias("dp"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r, doc, item, du, iu, least, ip, dp in zip(*(pdf[c] for c in ("r", "doc", "item", "du", "iu", "run", "ip", "dp"))):
                a, b = np.frombuffer(iu, np.uint32), np.frombuffer(du, np.uint32)
                held = np.concatenate([[0], np.cumsum(np.isin(pair_bits(b), pair_bits(a)))])
                n, span = np.array(len(a)), int(span_of(len(a)))
                if n > 2 and len(b) > 1 and ((held[span:] - held[:-span]).max() if len(held) > span else held[-1]) < least_of(n):
                    continue
                if best := passage(a, b, ip.astype(np.int64), dp.astype(np.int64), least):
                    rows.append((r, doc, item, best / len(a)))
            yield pd.DataFrame(rows, columns=["r", doc_id, item_id, "held"])

    schema = f"r long, {doc_id} {kinds[0]}, {item_id} {kinds[1]}, held double"
    return pairs.mapInPandas(run, schema).groupBy("r", doc_id, item_id).agg(F.max("held").alias("held")).drop("r")


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """doc_id, item_id, held (greatest share of the item's units held) for each document holding half of an item or more.

    Units are words; letters and digits for Chinese and Japanese items. Letter case, punctuation and white space don't count.
    The passage follows the item's order, with at most one unit in eight replaced, missing or added. Items and documents
    are winnowed with the gram and window that an item's length demands (shape), so that every passage that counts
    has common fingerprints, however short the item. Documents are read once, whatever the number of items. Up to BROADCAST_PRINTS
    fingerprints of items are sent to the executors and met where the documents are read; more of them meet the documents'
    in a join by fingerprint, before which a bitmap of bounded size drops most of the documents' (AQE splits hot fingerprints). Both ways,
    pairs with fewer common fingerprints than any passage leaves are dropped, the rest are extended by alignment at either side of the hits.
    NULL and unit-less texts on either side match nothing; repeated documents give a row each, an item id given twice counts once.
    """
    known, found = item_prints(items, item_id)
    n = found.count()
    kinds = dict(docs.dtypes)[doc_id], dict(items.dtypes)[item_id]
    if not n:
        return docs.sparkSession.createDataFrame([], f"{doc_id} {kinds[0]}, {item_id} {kinds[1]}, held double")
    return (searched if n <= BROADCAST_PRINTS else joined)(docs, doc_id, item_id, known, found, kinds)
