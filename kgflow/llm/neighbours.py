"""Problem 3: the most similar vectors for every vector (NN-descent over a neighbour graph; greedy graph search)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import discard, materialize, spread

#: Vectors a cell holds on average, pivots at most (1.5 MB of 96 floats), and sampled vectors a pivot that shape the cells (at most SAMPLE).
CELL, MOST_PIVOTS, PER_PIVOT, SAMPLE = 200, 4_096, 12, 50_000
#: Cells each vector visits for its first neighbours; cells of more than LARGE vectors are compared in blocks of about as many.
VISITS, LARGE = 3, 20_000
#: Sampled vectors (at most; 50 MB of 96 floats) around which cells of more than LARGE vectors are divided before that.
DIVIDERS = 131_072
#: Graph rows that one task merges, about.
TASK_ROWS = 100_000
#: Bits a vector, and at most (1,048,576 rows to broadcast), of the bitmaps that tell which vectors a round of the descent concerns.
BITS, MOST_BITS = 8, 1 << 26
#: Similarities are kept as whole millionths.
UNIT = 1_000_000


def valid(df: DataFrame, id_col: str, vec_col: str, size: int) -> DataFrame:
    """id, v of the rows that take part: not NULL, of the right size, finite, not zero."""
    v = F.col(vec_col).cast("array<float>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & (F.size("v") == size))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(~bad & F.exists("v", lambda x: x != 0))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1) if len(flat) else np.zeros((0, 1), np.float32)


def units(x: np.ndarray) -> np.ndarray:
    y = x.astype(np.float64)
    return y / np.linalg.norm(y, axis=1, keepdims=True)


def lists(values: np.ndarray) -> pa.Array:
    """A row of a matrix as a list each."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)), pa.array(values.ravel()))


def drawn(rows: DataFrame, count: int, wanted: int) -> np.ndarray:
    """Different unit vectors of about `wanted` rows, chosen by the hash of their ids, in an order of their own."""
    share = min(1.0, 1.1 * wanted / max(1, count))
    got = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * share) + 1).limit(max(SAMPLE, wanted)).toArrow()
    if not got.num_rows:
        return np.zeros((0, 1), np.float32)
    order = np.argsort(got["id"].to_numpy(), kind="stable")
    x = np.unique(units(matrix(got["v"])[order]).astype(np.float32), axis=0)
    return x[np.random.default_rng(3).permutation(len(x))]


def pivots_of(rows: DataFrame, count: int, cell: int | None = None) -> np.ndarray:
    """Unit vectors whose nearest regions are the cells: drawn from a sample of bounded size, more of them where the sample is dense."""
    pivots = int(min(MOST_PIVOTS, max(1, count // (cell or CELL))))
    wanted = min(count, SAMPLE, pivots * PER_PIVOT)
    x = drawn(rows, count, wanted)
    if not len(x):
        return x
    rng = np.random.default_rng(4)
    chosen = x[: max(1, pivots // 2)]
    for _ in range(4):
        if len(chosen) >= min(pivots, len(x)):
            break
        cell = np.concatenate([(x[a : a + 4096] @ chosen.T).argmax(1) for a in range(0, len(x), 4096)])
        load = np.bincount(cell, minlength=len(chosen))
        full = np.flatnonzero(load[cell] > 1.5 * load.mean())
        full = full[rng.permutation(len(full))][: max(1, (pivots - len(chosen) + 1) // 2)]
        if not len(full):
            break
        chosen = np.unique(np.concatenate([chosen, x[full]]), axis=0)
    return chosen


def best(src: np.ndarray, dst: np.ndarray, sim: np.ndarray, cell: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k most similar different dst of each src (of equal ones the smaller), as (srcs, dst, sim, cells) matrices padded with -1."""
    order = np.lexsort((dst, -sim, src))
    src, dst, sim, cell = src[order], dst[order], sim[order], cell[order]
    if len(src):
        keep = np.concatenate([[True], (src[1:] != src[:-1]) | (dst[1:] != dst[:-1]) | (sim[1:] != sim[:-1])])
        src, dst, sim, cell = src[keep], dst[keep], sim[keep], cell[keep]
    starts = np.flatnonzero(np.concatenate([[True], src[1:] != src[:-1]])) if len(src) else np.zeros(0, int)
    rank = np.arange(len(src)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(src)]])))
    row = np.cumsum(np.isin(np.arange(len(src)), starts)) - 1
    use = rank < k
    d, s, c = np.full((len(starts), k), -1, np.int64), np.full((len(starts), k), -1, np.int32), np.full((len(starts), k, cell.shape[1]), -1, np.int32)
    d[row[use], rank[use]], s[row[use], rank[use]], c[row[use], rank[use]] = dst[use], sim[use], cell[use]
    return src[starts], d, s, c.reshape(len(starts), k * cell.shape[1])


_GRAPH = "src long, own array<int>, dst array<long>, sim array<int>, cells array<int>"
_COLUMNS = ["src", "own", "dst", "sim", "cells"]


def _graph_batch(src: np.ndarray, own: np.ndarray, d: np.ndarray, s: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(src), lists(own), lists(d), lists(s), lists(c)], names=_COLUMNS)


def first_graph(rows: DataFrame, pivots: np.ndarray, count: int, k: int, visits: int) -> DataFrame:
    """Each vector's k most similar ones within the cells it visits. Copies of a vector are one, under their least id.

    One row per vector and cell. A cell of more than LARGE vectors (estimated from a sample) is first divided into the regions of sampled
    vectors of its own, DIVIDERS in all. What is still larger, as where many vectors are alike, is cut into parts by hash and every two parts are a block, so that
    all pairs of it are compared, by several tasks.
    """
    visits = min(visits, len(pivots))
    sc = rows.sparkSession.sparkContext
    sent = sc.broadcast(pivots)

    def visited(batches: Iterator[pa.RecordBatch], dividers) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        seen: dict[bytes, int] = {}  # copies of one vector leave a task once, unless a smaller id comes later
        for b in batches:
            x, ids = np.ascontiguousarray(matrix(b["v"]), dtype=np.float32), b["id"].to_numpy()
            new = []
            for n, i in enumerate(ids.tolist()):
                key = x[n].tobytes()
                if seen.get(key, i + 1) > i:
                    seen[key] = i
                    new.append(n)
            if len(seen) > 200_000:
                seen.clear()
            if not new:
                continue
            x, ids = x[new], ids[new]
            u = units(x).astype(np.float32)
            near = []
            for a in range(0, len(u), 2048):
                z = u[a : a + 2048] @ sent.value.T
                near.append(np.argpartition(-z, visits - 1, axis=1)[:, :visits])
            cells = np.concatenate(near).astype(np.int32)
            if dividers.value:  # the two nearest regions of a divided cell
                whole, cells = cells, np.concatenate([cells, np.full_like(cells, -2)], axis=1)
                for c, (first, own) in dividers.value.items():
                    r, at = np.nonzero(whole == c)
                    if len(r):
                        two = np.argpartition(-(u[r] @ own.T), 1, axis=1)[:, :2]
                        cells[r, at], cells[r, visits + at] = first + two[:, 0], first + two[:, 1]
            yield ids, x, cells

    def loads(dividers, cells: int) -> np.ndarray:
        """About how many vectors each cell holds."""

        def only_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, _, cells in visited(batches, dividers):
                yield pa.RecordBatch.from_arrays([pa.array(cells[cells >= 0])], names=["cell"])

        share = min(1.0, SAMPLE / count)
        some = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * share) + 1)
        load = some.mapInArrow(only_cells, "cell int").groupBy("cell").agg(F.count("*").alias("n")).toPandas()
        held = np.zeros(cells)
        held[load["cell"].to_numpy(dtype=int)] = load["n"].to_numpy(dtype=float) / share
        return held

    total = max(1, len(pivots))
    dividers, held = sc.broadcast({}), np.zeros(total)
    if count > LARGE:
        held = loads(dividers, total)
        heavy = np.flatnonzero(held > LARGE)
        if len(heavy) and DIVIDERS:
            x = drawn(rows, count, min(count, DIVIDERS))
            nearest = np.concatenate([(x[a : a + 2048] @ pivots.T).argmax(1) for a in range(0, len(x), 2048)])
            parted = {}
            for c in heavy.tolist():
                own = x[nearest == c][: int(np.ceil(4 * held[c] / LARGE))]
                if len(own) > 1:
                    parted[c] = (total, own)
                    total += len(own)
            dividers = sc.broadcast(parted)
            held = loads(dividers, total)
    split = np.where(held > LARGE, np.ceil(2 * held / LARGE), 1).astype(np.int64)  # parts of each cell, two of which make a block

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x, cells in visited(batches, dividers):
            of, slot = np.nonzero(cells >= 0)
            into = cells[of, slot]
            parts = split[into]
            crc = np.array([crc32(r.tobytes()) for r in x], dtype=np.int64)[of] if parts.max() > 1 else np.zeros(len(of), np.int64)
            # a vector goes to the blocks of its part with every other part
            blocks = np.maximum(parts - 1, 1)
            at = np.repeat(np.arange(len(of)), blocks)
            mine, every = (crc % parts)[at], parts[at]
            other = (mine + 1 + np.arange(len(at)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) % every
            block = np.minimum(mine, other) * every + np.maximum(mine, other)
            # few rows at a time, as a vector of large cells leaves in many blocks
            for a in range(0, len(at), 32_768):
                one = at[a : a + 32_768]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(into[one]), pa.array(block[a : a + 32_768]), pa.array(ids[of[one]]), lists(cells[of[one]]), pa.array([r.tobytes() for r in x[of[one]]], pa.binary())],
                    names=["cell", "block", "id", "own", "v"],
                )

    def compare(t: pa.Table) -> pa.Table:
        ids, own = t["id"].to_numpy(), matrix(t["own"])
        x = np.frombuffer(b"".join(t["v"].to_pylist()), dtype=np.float32).reshape(len(ids), -1)
        order = np.argsort(ids, kind="stable")
        ids, own, x = ids[order], own[order], x[order]
        _, one = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * 4))).ravel(), return_index=True)
        one.sort()
        ids, own, u = ids[one], own[one], units(x[one])
        small, n, take = u.astype(np.float32), len(one), min(k + 2, len(one) - 1)
        parts = []
        for a in range(0, n, 512):
            z = small[a : a + 512] @ small.T
            z[np.arange(len(z)), np.arange(a, a + len(z))] = -2
            if take <= 0:
                continue
            top = np.argpartition(-z, take - 1, axis=1)[:, :take]
            least = np.take_along_axis(z, top, 1).min(1)
            # all that tie with the last one within rounding, so that the smaller id can win
            r, c = np.nonzero(z >= least[:, None] - 2e-6)
            sim = np.rint((u[a + r] * u[c]).sum(1) * UNIT).astype(np.int32)
            parts.append((a + r, c, sim))
        if parts:
            r, c, sim = (np.concatenate(p) for p in zip(*parts))
            src, d, s, cc = best(ids[r], ids[c], sim, own[c], k)
            at = np.searchsorted(ids, src)
            return pa.Table.from_batches([_graph_batch(src, own[at], d, s, cc)])
        none = np.full((n, k), -1)
        return pa.Table.from_batches([_graph_batch(ids, own, none.astype(np.int64), none.astype(np.int32), np.full((n, k * own.shape[1]), -1, np.int32))])

    cells = spread(rows, 1).mapInArrow(visit, "cell int, block long, id long, own array<int>, v binary")
    return cells.groupBy("cell", "block").applyInArrow(compare, _GRAPH)


def parts_for(spark: SparkSession, rows: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // TASK_ROWS)


def merge(rows: DataFrame, k: int, parts: int) -> DataFrame:
    """One row per src from several: its k best. Where rows are marked as `old` or not, also how many neighbours are new (gained), and which came or went (moved)."""
    marked = "old" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        src, own, d, s, c = t["src"].to_numpy(), matrix(t["own"]), matrix(t["dst"]), matrix(t["sim"]), matrix(t["cells"])
        width = d.shape[1]
        keep = (d >= 0).ravel()
        all_src = np.repeat(src, width)
        out = best(all_src[keep], d.ravel()[keep], s.ravel()[keep], c.reshape(len(src) * width, own.shape[1])[keep], k)
        alone = np.setdiff1d(src, out[0])  # without any neighbour
        none = [np.full((len(alone), w.shape[1]), -1, w.dtype) for w in out[1:]]
        out = [np.concatenate([out[0], alone]), *[np.concatenate([a, b]) for a, b in zip(out[1:], none)]]
        known = own[:, 0] >= 0
        ids, at = np.unique(src[known], return_index=True)
        batch = _graph_batch(out[0], own[known][at][np.minimum(np.searchsorted(ids, out[0]), len(ids) - 1)], *out[1:])
        if not marked:
            yield batch
            return
        before, now = keep & np.repeat(t["old"].to_numpy(), width), (out[1] >= 0).ravel()
        edges = np.concatenate([np.stack([np.repeat(out[0], k), out[1].ravel(), out[2].ravel()], 1)[now], np.stack([all_src, d.ravel(), s.ravel()], 1)[before]])
        _, at, times = np.unique(edges, axis=0, return_inverse=True, return_counts=True)
        once = times[at.ravel()] == 1
        order = np.argsort(out[0], kind="stable")
        row = order[np.searchsorted(out[0][order], edges[:, 0])]
        gained = np.bincount(row[: now.sum()][once[: now.sum()]], minlength=len(out[0]))
        ends = np.concatenate([[0], np.cumsum(np.bincount(row[once], minlength=len(out[0])))])
        moved = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(edges[once, 1][np.argsort(row[once], kind="stable")]))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(gained.astype(np.int32)), moved], names=[*_COLUMNS, "gained", "moved"])

    return rows.repartition(parts, "src").mapInArrow(run, _GRAPH + (", gained int, moved array<long>" if marked else ""))


def among(ids: DataFrame, count: int) -> Callable[..., DataFrame]:
    """A filter (table, column, whether): the rows whose id may be among `ids`, as a bitmap of bounded size tells, or those whose id surely isn't."""
    size = min(MOST_BITS, 1 << max(6, (BITS * count).bit_length()))
    word, bit = f"shiftright(xxhash64(%s) & {size - 1}L, 6)", "shiftleft(1L, int(xxhash64(%s) & 63L))"
    words = ids.groupBy(F.expr(word % "id").alias("_b")).agg(F.bit_or(F.expr(bit % "id")).alias("_m"))
    words = materialize(words, "bits")

    def some(df: DataFrame, column: str, held: bool = True) -> DataFrame:
        known = F.coalesce(F.col("_m").bitwiseAND(F.expr(bit % column)) != 0, F.lit(False))
        return df.withColumn("_b", F.expr(word % column)).join(F.broadcast(words), "_b", "left").filter(known if held else ~known).select(*df.columns)

    some.words = words  # to be discarded
    return some


def candidates(graph: DataFrame, follow: int, reverse: int, parts: int, moved: Callable[..., DataFrame] | None = None) -> DataFrame:
    """a < b: pairs of neighbours of one vector that share no cell, so haven't been compared. Only edges of at least `follow` are walked.

    With `moved` only vectors among these count: what another one's neighbours are, and whose neighbour it is, hasn't changed since all its pairs were given.
    """

    def messages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            src, own, d, s, c = b["src"].to_numpy(), matrix(b["own"]), matrix(b["dst"]), matrix(b["sim"]), matrix(b["cells"])
            if not len(src):
                continue
            width = d.shape[1]
            use = ((d >= 0) & (s >= follow)).ravel()
            u, v, sim = np.repeat(src, width)[use], d.ravel()[use], s.ravel()[use]
            uc, vc = np.repeat(own, width, axis=0)[use], c.reshape(len(src) * width, own.shape[1])[use]
            # of what reaches one vector only the `reverse` most similar count, so a batch need send no more: no hub gathers an unbounded group
            mid, nbr, near, cells = best(v, u, sim, uc, reverse)
            ok = (nbr >= 0).ravel()
            back = np.repeat(mid, reverse)[ok], nbr.ravel()[ok], cells.reshape(len(mid) * reverse, own.shape[1])[ok]
            rank = np.concatenate([np.full(len(u), -1, np.int32), near.ravel()[ok]])  # -1: the vector's own neighbour
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([u, back[0]])), pa.array(np.concatenate([v, back[1]])), pa.array(rank), lists(np.concatenate([vc, back[2]]))], names=["mid", "nbr", "sim", "cells"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        mid, nbr, sim, cells = t["mid"].to_numpy(), t["nbr"].to_numpy(), t["sim"].to_numpy(), matrix(t["cells"])
        # the best of those that reach a vector, whatever batches they came in, and its own neighbours
        at, n, s, c = best(mid[sim >= 0], nbr[sim >= 0], sim[sim >= 0], cells[sim >= 0], reverse)
        kept = (n >= 0).ravel()
        mid, nbr = np.concatenate([mid[sim < 0], np.repeat(at, reverse)[kept]]), np.concatenate([nbr[sim < 0], n.ravel()[kept]])
        cells = np.concatenate([cells[sim < 0], c.reshape(len(at) * reverse, cells.shape[1])[kept]])
        at, n, _, c = best(mid, nbr, np.zeros(len(mid), np.int32), cells, width + reverse)
        c = c.reshape(len(at), n.shape[1], cells.shape[1])
        out = []
        for x in range(n.shape[1]):
            for y in range(x + 1, n.shape[1]):
                use = (n[:, x] >= 0) & (n[:, y] >= 0) & ~((c[:, x, :, None] == c[:, y, None, :]) & (c[:, x, :, None] >= 0)).any((1, 2))
                out.append(np.stack([np.minimum(n[use, x], n[use, y]), np.maximum(n[use, x], n[use, y])], 1))
        found = np.unique(np.concatenate(out), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    width = graph.select(F.size("dst").alias("n")).first().n
    sent = graph.select(*_COLUMNS).mapInArrow(messages, "mid long, nbr long, sim int, cells array<int>")
    sent = sent if moved is None else moved(sent, "mid")
    return sent.repartition(parts, "mid").mapInArrow(pairs, "a long, b long").distinct()


def measured(pairs: DataFrame, rows: DataFrame, cells: DataFrame, k: int) -> DataFrame:
    """Graph rows, a edge each way, for pairs (a, b) of vector ids. Vectors are joined to the pairs, never the other way round."""
    left = rows.join(cells, "id")
    x = pairs.join(left.select(F.col("id").alias("a"), F.col("v").alias("x"), F.col("own").alias("ac")), "a")
    xy = x.join(left.select(F.col("id").alias("b"), F.col("v").alias("y"), F.col("own").alias("bc")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            s = np.rint((units(matrix(b["x"])) * units(matrix(b["y"]))).sum(1) * UNIT).astype(np.int32)
            a, bb, ac, bc = b["a"].to_numpy(), b["b"].to_numpy(), matrix(b["ac"]), matrix(b["bc"])
            d = np.full((2 * n, k), -1, np.int64)
            d[:, 0] = np.concatenate([bb, a])
            sim = np.full((2 * n, k), -1, np.int32)
            sim[:, 0] = np.concatenate([s, s])
            c = np.full((2 * n, k, ac.shape[1]), -1, np.int32)
            c[:, 0] = np.concatenate([bc, ac])
            yield _graph_batch(np.concatenate([a, bb]), np.concatenate([ac, bc]), d, sim, c.reshape(2 * n, -1))

    return xy.mapInArrow(run, _GRAPH)


def neighbour_graph(rows: DataFrame, k: int, follow: float, rounds: int = 3, reverse: int = 5, settle: float = 0.002, cell: int | None = None, visits: int | None = None) -> DataFrame:
    """src, own, dst, sim, cells: NN-descent from the cells' neighbours until under `settle` of the edges change in a round."""
    count = rows.count()
    pivots = pivots_of(rows, count, cell)
    empty = rows.sparkSession.createDataFrame([], _GRAPH)
    if not len(pivots):
        return empty
    parts = parts_for(rows.sparkSession, count * (visits or VISITS))
    graph = materialize(merge(first_graph(rows, pivots, count, k, visits or VISITS), k, parts), "graph")
    tried = moved = None
    for _ in range(rounds):
        new = candidates(graph, int(follow * UNIT), reverse, parts, moved)
        new = materialize(new if tried is None else new.join(tried, ["a", "b"], "left_anti"), "pairs")
        if new.isEmpty():
            break
        tried = new if tried is None else tried.unionByName(new)
        # only vectors of new pairs are joined, only their rows of the graph merged; the others stay as they are
        ends = among(new.select(F.explode(F.array("a", "b")).alias("id")), count)
        cells = graph.select(F.col("src").alias("id"), "own")
        found = measured(new, ends(rows, "id"), ends(cells, "id"), k).withColumn("old", F.lit(False))
        after = merge(ends(graph.select(*_COLUMNS), "src").withColumn("old", F.lit(True)).unionByName(found), k, parts)
        rest = ends(graph.select(*_COLUMNS), "src", False).withColumn("gained", F.lit(0)).withColumn("moved", F.array().cast("array<long>"))
        after = materialize(after.unionByName(rest), "graph")
        discard(graph, ends.words, *([moved.words] if moved else []))
        graph = after
        changed, total = graph.agg(F.coalesce(F.sum("gained"), F.lit(0)), F.coalesce(F.sum(F.size(F.filter("dst", lambda x: x >= 0))), F.lit(0))).first()
        if changed < settle * total:
            break
        moved = among(graph.filter("size(moved) > 0").select(F.explode(F.concat("moved", F.array("src"))).alias("id")), count)
    return graph


def most_similar(df: DataFrame, id_col: str = "id", vec_col: str = "embedding", size: int = 96, k: int = 5, follow: float = 0.6, cell: int | None = None, visits: int | None = None) -> DataFrame:
    """id, neighbour, rank (from 1), similarity (rounded to six decimals) for the k most similar other vectors of each.

    Vectors that are NULL, zero, not finite or not of the given size take no part, nor do NULL ids; an id given twice with
    different vectors is two vectors of one name. Of equal similarities the smaller id comes first. Copies of a vector are
    one node of the graph, so however many there are, they never meet pairwise: the k + 1 smallest ids of a set of copies
    stand for it. The graph starts from cells around pivots of a bounded sample (every vector is indexed) and is improved by
    NN-descent, which compares neighbours of neighbours along edges of similarity `follow` or more. Larger cells and more
    visits raise the recall among weak neighbours, which descent along strong edges doesn't reach. Extra columns are ignored.
    """
    rows = valid(df, id_col, vec_col, size)
    graph = neighbour_graph(rows, k + 1, follow, cell=cell, visits=visits)
    same = rows.select("id", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    sets = same.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n")).filter("n > 1").select("h1", "h2", "rep")
    copies = materialize(same.join(sets, ["h1", "h2"]).select("id", "rep"), "copies")
    first = copies.withColumn("at", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).filter(F.col("at") <= k + 1)
    first = first.groupBy("rep").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    edges = graph.select(F.col("src").alias("rep"), F.explode(F.arrays_zip("dst", "sim")).alias("e")).select("rep", F.col("e.dst").alias("to"), F.col("e.sim").alias("sim")).filter("to >= 0")
    edges = edges.unionByName(first.select("rep", F.col("rep").alias("to"), F.lit(UNIT).alias("sim")))
    wide = edges.join(first.select(F.col("rep").alias("to"), "ids"), "to", "left").select("rep", "sim", F.explode(F.coalesce("ids", F.array("to"))).alias("to"))
    near = wide.groupBy("rep").agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("sim")).alias("s"), "to"))), 1, k + 1 + k).alias("near"))
    of = near.join(copies, "rep").select("id", "near").unionByName(near.join(copies.select("rep").distinct(), "rep", "left_anti").select(F.col("rep").alias("id"), "near"))
    kept = of.select("id", F.slice(F.filter("near", lambda x: x["to"] != F.col("id")), 1, k).alias("near"))
    out = kept.select("id", F.posexplode("near").alias("at", "n"))
    return out.select(F.col("id").alias(id_col), F.col("n.to").alias("neighbour"), (F.col("at") + 1).cast("long").alias("rank"), (-F.col("n.s") / UNIT).alias("similarity"))


def graph_search(queries: DataFrame, rows: DataFrame, graph: DataFrame, pivots: np.ndarray, k: int = 5, beam: int = 20, hops: int = 3, probes: int = 16) -> DataFrame:
    """query, id, sim (millionths), rank: greedy search of the graph for each query vector (query, q) among rows (id, v).

    A query enters at the best members of its `probes` nearest cells (each vector lies in one cell here; cells of more than LARGE are met part by
    part) and moves on to the neighbours of its `beam` best until `hops` are over or nothing new is found. All queries walk at once: a cogroup by cell
    to enter, then a join with the graph and one with the vectors a hop. Queries of another size than the vectors must not be given.
    """
    sent = queries.sparkSession.sparkContext.broadcast(pivots)

    def near(vec: str, name: str, probes: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    z = units(matrix(b[vec])).astype(np.float32) @ sent.value.T
                    m = min(probes, z.shape[1])
                    cells = np.argpartition(-z, m - 1, axis=1)[:, :m].astype(np.int32)
                    at = pa.array(np.repeat(np.arange(b.num_rows), m))
                    yield pa.RecordBatch.from_arrays([pa.array(cells.ravel()), b[name].take(at), b[vec].take(at)], names=["cell", name, vec])

        return run, f"cell int, {name} long, {vec} array<float>"

    def enter(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query", "id", "sim"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.int32())], names=names)
        q, v = units(matrix(left["q"])), units(matrix(right["v"]))
        z = q.astype(np.float32) @ v.astype(np.float32).T
        m = min(beam, z.shape[1])
        top = np.argpartition(-z, m - 1, axis=1)[:, :m]
        sim = np.rint((q[:, None] * v[top]).sum(2) * UNIT).astype(np.int32)
        ids = right["id"].to_numpy()[top]
        return pa.table([np.repeat(left["query"].to_numpy(), m), ids.ravel(), sim.ravel()], names=names)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = np.rint((units(matrix(b["q"])) * units(matrix(b["v"]))).sum(1) * UNIT).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b["query"], b["id"], pa.array(s)], names=["query", "id", "sim"])

    by_sim = Window.partitionBy("query").orderBy(F.desc("sim"), "id")
    best_of = lambda df, n: df.distinct().withColumn("at", F.row_number().over(by_sim)).filter(F.col("at") <= n)
    asked, members = queries.mapInArrow(*near("q", "query", probes)), rows.mapInArrow(*near("v", "id", 1))
    sizes = members.groupBy("cell").agg(F.ceil(F.count("*") / LARGE).alias("parts")).filter("parts > 1")  # a row a pivot at most
    parts = F.broadcast(materialize(sizes, "parts"))
    members = members.join(parts, "cell", "left").withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1)))).drop("parts")
    asked = asked.join(parts, "cell", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    found = asked.groupBy("cell", "part").cogroup(members.groupBy("cell", "part")).applyInArrow(enter, "query long, id long, sim int")
    found = materialize(best_of(found, 4 * beam).drop("at"), "search")
    for _ in range(hops):
        front = best_of(found, beam)
        step = front.join(graph.select(F.col("src").alias("id"), F.explode("dst").alias("to")), "id").filter("`to` >= 0").select("query", F.col("to").alias("id")).distinct()
        step = step.join(found, ["query", "id"], "left_anti")
        step = materialize(step.join(rows, "id").join(queries, "query").select("query", "id", "q", "v").mapInArrow(score, "query long, id long, sim int"), "search")
        if step.isEmpty():
            break
        found = materialize(best_of(found.unionByName(step), 4 * beam).drop("at"), "search")
    return found.withColumn("rank", F.row_number().over(by_sim)).filter(F.col("rank") <= k)
