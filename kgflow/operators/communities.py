"""Communities of a graph by modularity: local moves, contraction, division of large communities."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .graph import components
from .ids import numbered

#: A move counts if it gains more than this (modularity times the total weight).
LEAST_GAIN = 1e-9
#: Graphs of at most so many edges are solved in one task each (about a minute and 200 MB); larger ones by moves in rounds over all tasks.
TASK_EDGES = 200_000


def weighted_edges(edges: DataFrame, *group: str) -> DataFrame:
    """group, source < target, weight (summed over parallel and reversed edges); self loops and NULL ends are left out, a NULL weight counts 0."""
    e = edges.filter("source IS NOT NULL AND target IS NOT NULL AND source <> target")
    return e.groupBy(*group, F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).agg(F.sum(F.coalesce(F.col("weight").cast("double"), F.lit(0.0))).alias("weight"))


def local_moves(edges: DataFrame, nodes: DataFrame, most: int = 24) -> DataFrame:
    """n, c: communities after nodes have moved to the neighbouring community of greatest modularity gain until hardly any does.

    edges(s, t, w) hold each edge both ways; nodes(n, k, m2): degree and twice the weight of the part of the graph that n lies in.
    In a pass only a random half of the nodes moves, and of two single nodes the greater joins the smaller, so neighbours
    don't change places. Everything is an aggregation or a join by node or community: hubs combine on the map side.
    """
    state, before = nodes.withColumn("c", F.col("n")), None
    for p in range(most):
        sums = state.groupBy("c").agg(F.sum("k").alias("tot"), F.count("*").alias("size"))
        links = edges.join(state.select(F.col("n").alias("t"), "c"), "t").groupBy("s", "c").agg(F.sum("w").alias("w")).join(sums, "c")
        mine = state.join(sums.withColumnsRenamed({"c": "own", "tot": "own_tot", "size": "own_size"}), F.col("c") == F.col("own")).drop("c")
        x = links.join(mine.withColumnRenamed("n", "s"), "s")
        rest = F.when(F.col("c") == F.col("own"), F.col("tot") - F.col("k")).otherwise(F.col("tot"))
        x = x.withColumn("gain", F.round(F.col("w") - F.col("k") * rest / F.col("m2"), 9))
        free = (F.col("c") == F.col("own")) | (F.col("own_size") > 1) | (F.col("size") > 1) | (F.col("c") < F.col("own"))
        best = x.filter(free).groupBy("s").agg(
            F.max(F.struct("gain", (-F.col("c")).alias("c"))).alias("best"), F.max(F.when(F.col("c") == F.col("own"), F.col("gain"))).alias("stay"), F.first("own").alias("own"),
            F.round(F.first(-F.col("k") * (F.col("own_tot") - F.col("k")) / F.col("m2")), 9).alias("alone"),
        )
        turn = F.pmod(F.xxhash64("s", F.lit(p // 2)), F.lit(2)) == p % 2
        moves = best.filter(turn & (F.col("best.gain") > F.coalesce("stay", "alone") + LEAST_GAIN) & (-F.col("best.c") != F.col("own"))).select(F.col("s").alias("n"), (-F.col("best.c")).alias("to"))
        state = materialize(state.join(moves, "n", "left").select("n", "k", "m2", F.coalesce("to", "c").alias("c"), F.col("to").isNotNull().alias("moved")), "moves")
        count = state.agg(F.count("*").alias("n"), F.count(F.when(F.col("moved"), 1)).alias("moved")).first()
        state = state.drop("moved")
        if before is not None and (before + count.moved) * 1_000 <= count.n:
            break
        before = count.moved
    return state.select("n", "c")


def moved(near: list[dict[int, float]], degree: list[float]) -> list[int]:
    """The community of each node after moves, one node at a time, to the neighbouring community of greatest gain; near: weights by neighbour."""
    total = sum(degree)
    of, sums = list(range(len(near))), list(degree)
    queue = list(range(len(near)))
    waiting = [True] * len(near)
    for n in queue:  # grows while nodes wait again
        waiting[n] = False
        links: dict[int, float] = {}
        for m, w in near[n].items():
            links[of[m]] = links.get(of[m], 0.0) + w
        own, k = of[n], degree[n]
        sums[own] -= k
        gain = lambda c: (round(links.get(c, 0.0) - k * sums[c] / total, 9), -c)  # noqa: B023, E731
        best = max([own, *links], key=gain)
        if gain(best)[0] <= gain(own)[0] + LEAST_GAIN:
            best = own
        sums[best] += k
        if best != own:
            of[n] = best
            for m in near[n]:
                if of[m] != best and not waiting[m]:
                    waiting[m] = True
                    queue.append(m)
    return of


def solved(edges: list[tuple[str, str, float]]) -> dict[str, str]:
    """Community (its least title) of each title: moves and contraction in turn until no community joins another, then connected parts."""
    titles = sorted({t for e in edges for t in e[:2]})
    at = {t: i for i, t in enumerate(titles)}
    near: list[dict[int, float]] = [{} for _ in titles]
    for a, b, w in sorted(edges):
        near[at[a]][at[b]] = near[at[b]][at[a]] = w
    whole, degree, found = near, [sum(x.values()) for x in near], list(range(len(titles)))
    while sum(degree) > 0:
        of = moved(near, degree)
        number = {c: i for i, c in enumerate(sorted(set(of)))}
        if len(number) == len(near):
            break
        found = [number[of[c]] for c in found]
        less: list[dict[int, float]] = [{} for _ in number]
        sums = [0.0] * len(number)
        for n, links in enumerate(near):
            a = number[of[n]]
            sums[a] += degree[n]
            for m, w in links.items():
                if (b := number[of[m]]) != a:
                    less[a][b] = less[a].get(b, 0.0) + w
        near, degree = less, sums
    part: dict[int, int] = {}
    for n in range(len(titles)):  # in order of title, so a part is named after its least one
        if n not in part:
            part[n], todo = n, [n]
            while todo:
                x = todo.pop()
                for m in whole[x]:
                    if m not in part and found[m] == found[n]:
                        part[m] = n
                        todo.append(m)
    return {t: titles[part[i]] for i, t in enumerate(titles)}


def modular(edges: DataFrame, group: list[str] = []) -> DataFrame:
    """group, title, community (its least title) for every end of an edge: communities of high modularity in each group of edges.

    edges(group.., source, target, weight), as weighted_edges gives them. Local moves and contraction of communities to single nodes alternate until
    no community joins another; communities are then divided into their connected parts, so each is connected. Groups of at most
    TASK_EDGES edges are solved in a task each, larger ones (all together) by rounds of moves that every task takes part in.
    """
    e = materialize(edges, "weights")
    sizes = e.groupBy(*group).agg(F.count("*").alias("_n"))
    large = sizes.filter(F.col("_n") > TASK_EDGES)
    many = not large.isEmpty()
    if group:
        small = e.join(large.select(*group), group, "left_anti") if many else e
        rest = e.join(large.select(*group), group, "left_semi") if many else None
    else:
        small, rest = (None, e) if many else (e, None)
    out = None
    if small is not None:
        kinds = dict(e.dtypes)

        def solve(pdf: pd.DataFrame) -> pd.DataFrame:
            found = solved(list(zip(pdf["source"], pdf["target"], pdf["weight"])))
            return pd.DataFrame({**{g: [pdf[g].iloc[0]] * len(found) for g in group}, "title": list(found), "community": list(found.values())})

        schema = ", ".join([*(f"`{g}` {kinds[g]}" for g in group), f"title {kinds['source']}", f"community {kinds['source']}"])
        out = small.groupBy(*group).applyInPandas(solve, schema)
    if rest is not None:
        spread_out = _by_rounds(rest, group)
        out = spread_out if out is None else out.unionByName(spread_out)
    return out


def _by_rounds(e: DataFrame, group: list[str]) -> DataFrame:
    """modular by rounds of moves over the whole table."""
    titles = e.select(*group, F.col("source").alias("title")).union(e.select(*group, "target")).distinct()
    ids = materialize(numbered(titles, [*group, "title"], "n"), "ids")
    both = e.unionByName(e.select(*group, F.col("target").alias("source"), F.col("source").alias("target"), "weight"))
    ends = [ids.select(*group, F.col("title").alias(c), F.col("n").alias(i)) for c, i in (("source", "s"), ("target", "t"))]
    links = materialize(both.join(ends[0], [*group, "source"]).join(ends[1], [*group, "target"]).select(*group, "s", "t", F.col("weight").alias("w")), "links")
    degree = links.groupBy(*group, F.col("s").alias("n")).agg(F.sum("w").alias("k"))
    total = degree.groupBy(*group).agg(F.sum("k").alias("m2"))
    nodes = (degree.join(total, group) if group else degree.crossJoin(F.broadcast(total))).filter("m2 > 0").select("n", "k", "m2")
    nodes, links = materialize(nodes, "nodes"), links.select("s", "t", "w")
    found = ids.select("n", F.col("n").alias("c"))
    count = None
    while True:
        step = local_moves(links, nodes)
        found = materialize(found.withColumnRenamed("c", "x").join(step.withColumnRenamed("n", "x"), "x", "left").select("n", F.coalesce("c", "x").alias("c")), "found")
        left = step.select("c").distinct().count()
        if left == count:
            break
        count = left
        at = [step.select(F.col("n").alias(a), F.col("c").alias(b)) for a, b in (("s", "cs"), ("t", "ct"))]
        links = links.join(at[0], "s").join(at[1], "t").filter("cs <> ct").groupBy(F.col("cs").alias("s"), F.col("ct").alias("t")).agg(F.sum("w").alias("w"))
        links = materialize(links, "links")
        nodes = materialize(step.join(nodes, "n").groupBy("c").agg(F.sum("k").alias("k"), F.first("m2").alias("m2")).withColumnRenamed("c", "n"), "nodes")
        if links.isEmpty():
            break
    named = materialize(ids.join(found, "n"), "named")
    inside = e.join(named.select(*group, F.col("title").alias("source"), F.col("n").alias("a"), F.col("c").alias("x")), [*group, "source"]).join(named.select(*group, F.col("title").alias("target"), F.col("n").alias("b"), F.col("c").alias("y")), [*group, "target"])
    parts = components(inside.filter("x = y").select(F.col("a").alias("source"), F.col("b").alias("target")))
    out = named.join(parts.select(F.col("title").alias("n"), F.col("component").alias("part")), "n", "left").withColumn("part", F.coalesce("part", "n"))
    first = ids.select(F.col("n").alias("part"), F.col("title").alias("community"))  # numbers follow the titles
    return out.join(first, "part").select(*group, "title", "community")


def hierarchical_communities(edges: DataFrame, max_size: int = 10, levels: int = 10) -> DataFrame:
    """level, community, parent, title: communities of edges(source, target, weight), divided again while they have more than max_size members.

    Level 0 covers every end of an edge once; level n + 1 covers the members of those communities of level n that were too large and
    could be divided, each community inside one parent. The graph of a community to divide is its own edges alone. Community numbers are unique, in order of
    level and least title; parents of level 0 are -1. The result depends on the graph alone. Self loops and NULL ends take no part.
    """
    e = materialize(weighted_edges(edges), "edges")
    rows = materialize(modular(e).select(F.lit(0).alias("level"), "community", F.lit(None).cast("string").alias("parent"), "title"), "level")
    out = rows
    for level in range(1, levels):
        big = rows.groupBy("community").agg(F.count("*").alias("size")).filter(F.col("size") > max_size)
        inside = rows.join(big.select("community"), "community", "left_semi").select("title", F.col("community").alias("parent"))
        a, b = inside.withColumnRenamed("title", "source"), inside.withColumnRenamed("title", "target")
        sub = materialize(e.join(a, "source").join(b, ["target", "parent"]).select("parent", "source", "target", "weight"), "inside")
        if sub.isEmpty():
            break
        found = materialize(modular(sub, ["parent"]), "found")
        divided = found.groupBy("parent").agg(F.count_distinct("community").alias("n")).filter("n > 1").select("parent")
        rows = materialize(found.join(divided, "parent", "left_semi").select(F.lit(level).alias("level"), "community", "parent", "title"), "level")
        if rows.isEmpty():
            break
        out = out.unionByName(rows)
    ids = materialize(numbered(out.groupBy("level", "community").agg(F.min("title").alias("_m")), ["level", "_m", "community"], "_id"), "ids")
    out = out.join(ids.select("level", "community", "_id"), ["level", "community"])
    up = ids.select((F.col("level") + 1).alias("level"), F.col("community").alias("parent"), F.col("_id").alias("_up"))
    return out.join(up, ["level", "parent"], "left").select("level", F.col("_id").alias("community"), F.coalesce("_up", F.lit(-1)).alias("parent"), "title")


def modularity(edges: DataFrame, members: DataFrame) -> DataFrame:
    """One row: modularity of members(title, community), one community a title, on edges(source, target, weight); NULL without edges."""
    e = weighted_edges(edges)
    a, b = (members.select(F.col("title").alias(c), F.col("community").alias(f"_{c}")) for c in ("source", "target"))
    e = e.join(a, "source").join(b, "target")
    within = e.filter("_source = _target").groupBy(F.col("_source").alias("community")).agg(F.sum("weight").alias("w"), F.lit(0.0).alias("k"))
    ends = e.select(F.col("_source").alias("community"), "weight").unionAll(e.select("_target", "weight")).groupBy("community").agg(F.lit(0.0).alias("w"), F.sum("weight").alias("k"))
    per = within.unionByName(ends).groupBy("community").agg(F.sum("w").alias("w"), F.sum("k").alias("k")).crossJoin(F.broadcast(e.agg(F.sum("weight").alias("m"))))
    return per.agg(F.sum(F.col("w") / F.col("m") - F.pow(F.col("k") / (2 * F.col("m")), 2)).alias("modularity"))
