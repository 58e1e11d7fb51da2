"""Graphs as vertex and edge tables: degrees, co-occurrence, pruning, components, paths, fixed topologies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, small


def canonical_edges(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """Distinct undirected edges as source <= target; edges with a NULL end are left out."""
    return edges.filter(F.col(source).isNotNull() & F.col(target).isNotNull()).select(F.least(source, target).alias("source"), F.greatest(source, target).alias("target")).distinct()


def degree_undirected(edges: DataFrame) -> DataFrame:
    """title, degree over distinct undirected edges; a self loop counts twice."""
    e = canonical_edges(edges)
    return e.select(F.col("source").alias("title")).unionAll(e.select(F.col("target").alias("title"))).groupBy("title").agg(F.count("*").alias("degree"))


def degree_directed(edges: DataFrame) -> DataFrame:
    """title, degree = in + out over distinct directed edges."""
    e = edges.select("source", "target").filter("source IS NOT NULL AND target IS NOT NULL").distinct()
    return e.select(F.col("source").alias("title")).unionAll(e.select(F.col("target").alias("title"))).groupBy("title").agg(F.count("*").alias("degree"))


def degree_of_update(edges: DataFrame) -> DataFrame:
    """Edges with source_degree (rows with that source), target_degree (rows with that target) and their sum. Aggregated, then joined: hot ends aren't windowed."""
    out = edges.groupBy("source").agg(F.count("target").alias("source_degree"))
    into = edges.groupBy("target").agg(F.count("source").alias("target_degree"))
    return edges.join(out, "source").join(into, "target").withColumn("combined_degree", F.col("source_degree") + F.col("target_degree"))


def combined_degree(edges: DataFrame, degrees: DataFrame) -> DataFrame:
    """Edges with the sum of their ends' degrees; an end without a degree counts 0."""
    d = degrees.select("title", "degree")
    out = edges.join(d.select(F.col("title").alias("source"), F.col("degree").alias("_s")), "source", "left").join(d.select(F.col("title").alias("target"), F.col("degree").alias("_t")), "target", "left")
    return out.withColumn("combined_degree", F.coalesce("_s", F.lit(0)) + F.coalesce("_t", F.lit(0))).drop("_s", "_t")


def noun_nodes(mentions: DataFrame) -> DataFrame:
    """title, frequency, text_unit_ids from mentions(text_unit_id, title), each pair once."""
    m = mentions.select("text_unit_id", "title").filter("title IS NOT NULL").distinct()
    return m.groupBy("title").agg(F.count("*").alias("frequency"), F.array_sort(F.collect_set("text_unit_id")).alias("text_unit_ids"))


def noun_edges(mentions: DataFrame) -> DataFrame:
    """source < target, weight (text units holding both), text_unit_ids (those, sorted), pmi = log2(p_xy / (p_x p_y)) with p over all edge weights and all frequencies.

    Pairs are formed inside text units, whose size bounds them.
    """
    m = mentions.select("text_unit_id", "title").filter("title IS NOT NULL").distinct()
    a, b = m.select("text_unit_id", F.col("title").alias("source")), m.select("text_unit_id", F.col("title").alias("target"))
    edges = a.join(b, "text_unit_id").filter("source < target").groupBy("source", "target").agg(F.count("*").alias("weight"), F.array_sort(F.collect_list("text_unit_id")).alias("text_unit_ids"))
    edges = materialize(edges, "edges")
    nodes = m.groupBy("title").agg(F.count("*").alias("f"))
    totals = edges.agg(F.sum("weight").alias("_w")).crossJoin(nodes.agg(F.sum("f").alias("_f")))
    out = edges.join(nodes.select(F.col("title").alias("source"), F.col("f").alias("_x")), "source").join(nodes.select(F.col("title").alias("target"), F.col("f").alias("_y")), "target")
    out = out.crossJoin(F.broadcast(totals))
    pmi = F.log2((F.col("weight") / F.col("_w")) / ((F.col("_x") / F.col("_f")) * (F.col("_y") / F.col("_f"))))
    return out.select("source", "target", "weight", "text_unit_ids", pmi.alias("pmi"))


def upper_threshold(df: DataFrame, value: str, factor: float):
    """mean + factor x population standard deviation, as a one-row table."""
    return df.agg((F.avg(value) + factor * F.stddev_pop(value)).alias("bound"))


def prune(nodes: DataFrame, edges: DataFrame, min_frequency: int = 1, min_degree: int = 1, frequency_std: float | None = None, degree_std: float | None = None, min_weight_pct: float | None = None, remove_ego: bool = False, largest_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) after dropping the ego (greatest degree), rare and over-frequent nodes, and edges below a weight percentile.

    Degrees are those before any removal; the frequency bound is taken after the degree steps. largest_only: of what is left only the
    largest connected component stays.
    """
    d = nodes.join(degree_undirected(edges), "title", "left").fillna({"degree": 0})
    if remove_ego:
        ego = d.orderBy(F.desc("degree"), "title").limit(1).select("title")
        d = d.join(F.broadcast(ego), "title", "left_anti")
    if degree_std is not None:
        d = d.crossJoin(F.broadcast(upper_threshold(d, "degree", degree_std))).filter("degree <= bound").drop("bound")
    d = d.filter(F.col("degree") >= min_degree)
    if frequency_std is not None:
        d = d.crossJoin(F.broadcast(upper_threshold(d, "frequency", frequency_std))).filter("frequency <= bound").drop("bound")
    d = d.filter(F.col("frequency") >= min_frequency)
    keep = d.select("title")
    e = edges.join(keep.withColumnRenamed("title", "source"), "source", "left_semi").join(keep.withColumnRenamed("title", "target"), "target", "left_semi")
    if min_weight_pct is not None:
        bound = e.agg(F.percentile("weight", min_weight_pct / 100).alias("bound"))
        e = e.crossJoin(F.broadcast(bound)).filter("weight >= bound").drop("bound")
    if largest_only:
        e = materialize(e, "pruned")
        found = materialize(components(e), "components")
        best = found.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
        stay = materialize(found.join(F.broadcast(best), "component", "left_semi").select("title"), "stay")
        d, e = d.join(stay, "title", "left_semi"), e.join(stay.withColumnRenamed("title", "source"), "source", "left_semi")
    return d, e


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """title, component (its least title) for every end of an edge.

    Contracts the graph until no edge is left: each node goes to the least of itself and its neighbours, by title in the first
    round (a star around its least title ends there) and by a hash that changes every round afterwards, so the expected number of nodes falls
    by a constant factor a round whatever the shape. The rounds' tables, ever smaller, are then joined backwards. Every table is
    written, so lineage stays short and a lost executor costs one round. Messages combine on the map side, so hubs need no
    special care. Raises if `rounds` aren't enough.
    """
    e = canonical_edges(edges)
    titles = e.select(F.col("source").alias("title")).union(e.select("target")).distinct()
    left, steps = materialize(e.filter("source < target"), "edges"), []
    while not left.isEmpty():
        if len(steps) == rounds:
            raise RuntimeError(f"components aren't complete after {rounds} rounds")
        order = lambda c: F.struct((F.xxhash64(F.lit(len(steps)), c) if steps else F.col(c)).alias("o"), F.col(c).alias("to"))
        both = left.union(left.select("target", "source"))
        near = both.groupBy(F.col("source").alias("title")).agg(F.min(order("target")).alias("m"))
        steps.append(materialize(near.select("title", F.least("m", order("title"))["to"].alias("component")), "step"))
        ends = [steps[-1].select(F.col("title").alias(c), F.col("component").alias(f"_{c}")) for c in ("source", "target")]
        left = materialize(canonical_edges(left.join(ends[0], "source").join(ends[1], "target"), "_source", "_target").filter("source < target"), "edges")
    found = titles.withColumn("component", F.col("title")).limit(0) if not steps else steps.pop()
    while steps:
        last = found.select(F.col("title").alias("component"), F.col("component").alias("_far"))
        found = materialize(steps.pop().join(last, "component", "left").select("title", F.coalesce("_far", "component").alias("component")), "step")
    found = materialize(titles.join(found, "title", "left").select("title", F.coalesce("component", "title").alias("_c")), "labels")
    return found.join(found.groupBy("_c").agg(F.min("title").alias("component")), "_c").select("title", "component")


def largest_component(edges: DataFrame) -> DataFrame:
    """Titles of the largest component, upper-cased and stripped; of equal ones that with the least title."""
    named = edges.select(F.upper(F.trim("source")).alias("source"), F.upper(F.trim("target")).alias("target"))
    found = materialize(components(named), "components")
    best = found.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return found.join(F.broadcast(best), "component", "left_semi").select("title")


def shortest_paths(edges: DataFrame, sources: DataFrame, most: int = 5, unreachable: int = 510, directed: bool = False) -> DataFrame:
    """source, title, hops, path for each source and title of the graph, up to `most` hops; beyond that hops is `unreachable` and path NULL.

    path lists the titles from source to title; of several shortest paths the least. One join a hop, for new nodes only. The result holds sources x titles rows,
    so sources(title) must be a stated set; it is broadcast if counted small.
    """
    e = edges.filter("source IS NOT NULL AND target IS NOT NULL").select("source", "target")
    both = materialize((e if directed else e.unionAll(e.select(F.col("target").alias("source"), F.col("source").alias("target")))).distinct(), "edges")
    roots = small(sources.select(F.col("title").alias("root")).distinct())
    seen = roots.select("root", F.col("root").alias("title"), F.lit(0).alias("hops"), F.array("root").alias("path"))
    front = seen
    for hop in range(1, most + 1):
        step = front.join(both.select(F.col("source").alias("title"), F.col("target").alias("to")), "title").groupBy("root", F.col("to").alias("title")).agg(F.min("path").alias("path"))
        step = step.join(seen.select("root", "title"), ["root", "title"], "left_anti")
        front = materialize(step.select("root", "title", F.lit(hop).alias("hops"), F.concat("path", F.array("title")).alias("path")), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    every = both.select(F.col("source").alias("title")).union(both.select("target")).distinct().crossJoin(roots)
    return every.join(seen, ["root", "title"], "left").select(F.col("root").alias("source"), "title", F.coalesce("hops", F.lit(unreachable)).alias("hops"), "path")


GRAPH_TYPES = ("root_directed", "root_undirected", "root_fully_connected", "leaf_directed", "leaf_undirected", "leaf_connected_directed", "leaf_connected_undirected")


def fixed_graph(kinds: list[str], roots: int, leaves: int, spark) -> DataFrame:
    """source, target: directed edges of a fixed topology, the union of its kinds (of GRAPH_TYPES). Leaf j of root i is number roots + i x leaves + j.

    Roots form a chain or are all connected, leaves hang on their roots, or neighbouring leaves of one root are connected; undirected edges are given both ways.
    """
    if unknown := set(kinds) - set(GRAPH_TYPES):
        raise ValueError(f"unknown graph types {sorted(unknown)}")
    i = spark.range(roots).select(F.col("id").cast("int").alias("i"))
    leaf = i.select("i", F.explode(F.sequence(F.lit(0), F.lit(leaves - 1))).alias("j")).withColumn("n", F.lit(roots) + F.col("i") * leaves + F.col("j")) if leaves else i.limit(0).select("i", F.lit(0).alias("j"), F.lit(0).alias("n"))
    chain = i.filter(F.col("i") < roots - 1).select(F.col("i").alias("source"), (F.col("i") + 1).alias("target"))
    tufts = leaf.select(F.col("i").alias("source"), F.col("n").alias("target"))
    rows = leaf.filter(F.col("j") < leaves - 1).select(F.col("n").alias("source"), (F.col("n") + 1).alias("target"))
    back = lambda e: e.select(F.col("target").alias("source"), F.col("source").alias("target"))
    full = i.crossJoin(i.select(F.col("i").alias("target"))).filter("i <> target").select(F.col("i").alias("source"), "target")
    out = chain.limit(0)
    for kind in kinds:
        e = full if kind == "root_fully_connected" else {"root": chain, "leaf": tufts}[kind[:4]] if "connected" not in kind else rows
        out = out.unionByName(e)
        if kind.endswith("_undirected"):
            out = out.unionByName(back(e))
    return out.distinct()


def chain_graph(roots: int, leaves: int, spark) -> DataFrame:
    """source, target of the usual fixed topology: roots in a chain, each with its leaves."""
    return fixed_graph(["root_directed", "leaf_directed"], roots, leaves, spark)


def subset_communities(members: DataFrame) -> DataFrame:
    """level, community, sub_community: pairs of adjacent levels whose lower member set lies in the upper one. Joined on members, not all pairs."""
    m = members.select("level", "community", "title").distinct()
    size = m.groupBy("level", "community").agg(F.count("*").alias("n"))
    up = m.select("level", "community", "title")
    down = m.select((F.col("level") - 1).alias("level"), F.col("community").alias("sub_community"), "title")
    shared = up.join(down, ["level", "title"]).groupBy("level", "community", "sub_community").agg(F.count("*").alias("c"))
    sizes = size.select((F.col("level") - 1).alias("level"), F.col("community").alias("sub_community"), "n")
    return shared.join(sizes, ["level", "sub_community"]).filter("c = n").select("level", "community", "sub_community", F.col("n").alias("sub_size"))
