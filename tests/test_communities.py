"""Communities by modularity, solved in one task and by rounds over all tasks."""

import random

import pytest

from kgflow.operators import communities, graph

# The 78 ties of a karate club (Zachary 1977), whose best known modularity is 0.4198.
TIES = {
    0: "1 2 3 4 5 6 7 8 10 11 12 13 17 19 21 31", 1: "2 3 7 13 17 19 21 30", 2: "3 7 8 9 13 27 28 32", 3: "7 12 13", 4: "6 10", 5: "6 10 16", 6: "16", 8: "30 32 33", 9: "33", 13: "33", 14: "32 33", 15: "32 33",
    18: "32 33", 19: "33", 20: "32 33", 22: "32 33", 23: "25 27 29 32 33", 24: "25 27 31", 25: "31", 26: "29 33", 27: "33", 28: "31 33", 29: "32 33", 30: "32 33", 31: "32 33", 32: "33",
}


@pytest.fixture(params=[200_000, 0], ids=["one task", "rounds"])
def way(request, monkeypatch):
    monkeypatch.setattr(communities, "TASK_EDGES", request.param)


def table(spark, edges):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in edges], "source string, target string, weight double")


def found(spark, edges):
    out = {}
    for r in communities.modular(communities.weighted_edges(table(spark, edges))).collect():
        out.setdefault(r.community, set()).add(r.title)
    assert all(min(x) == c for c, x in out.items())
    return sorted(map(sorted, out.values()))


def clique(name, n):
    return [(f"{name}{i}", f"{name}{j}", 1) for i in range(n) for j in range(i)]


def test_pairs_stars_and_cliques_stay_together(spark, way):
    edges = [("pa", "pb", 1), ("hub", "l1", 1), ("l2", "hub", 1), ("hub", "l3", 2), ("z", "y1", 1), ("z", "y2", 1), ("pa", "pa", 9), (None, "pa", 1), ("pb", None, 1)]
    edges += clique("a", 6) + clique("b", 6) + clique("c", 6) + [("a0", "b0", 1), ("b1", "c1", 1), ("c2", "a2", 1)]
    assert found(spark, edges) == sorted([["pa", "pb"], ["hub", "l1", "l2", "l3"], ["y1", "y2", "z"], *[[f"{x}{i}" for i in range(6)] for x in "abc"]])


def test_modularity_is_near_the_best_known(spark, way):
    edges = table(spark, [(f"n{a:02}", f"n{int(b):02}", 1) for a, x in TIES.items() for b in x.split()])
    members = communities.modular(communities.weighted_edges(edges))
    assert communities.modularity(edges, members).first().modularity >= 0.98 * 0.4198


def test_hierarchy_nests_and_divides_large_communities(spark):
    rng = random.Random(3)
    edges = []
    for group in range(3):
        for part in range(3):
            edges += clique(f"g{group}p{part}n", 5)
        edges += [(f"g{group}p{a}n{rng.randrange(5)}", f"g{group}p{b}n{rng.randrange(5)}", 1) for a in range(3) for b in range(a) for _ in range(6)]
    rows = communities.hierarchical_communities(table(spark, edges), max_size=8).collect()
    zero = {r.title: r.community for r in rows if r.level == 0}
    assert len(zero) == 45 == len([r for r in rows if r.level == 0]) and all(r.parent == -1 for r in rows if r.level == 0)
    assert sorted(len([t for t in zero if zero[t] == c]) for c in set(zero.values())) == [15, 15, 15]
    one = {r.title: r for r in rows if r.level == 1}
    assert len(one) == 45 and all(zero[t] == r.parent for t, r in one.items())
    assert {frozenset(t for t in one if one[t].community == c) for c in {r.community for r in one.values()}} == {frozenset(f"g{g}p{p}n{i}" for i in range(5)) for g in range(3) for p in range(3)}
    assert len({(r.level, r.community) for r in rows}) == len({r.community for r in rows})
    assert communities.hierarchical_communities(table(spark, [])).collect() == []


def test_all_graph_types_and_paths(spark):
    e = {k: {tuple(r) for r in graph.fixed_graph([k], 3, 2, spark).collect()} for k in graph.GRAPH_TYPES}
    assert e["root_directed"] == {(0, 1), (1, 2)} and e["root_undirected"] == {(0, 1), (1, 2), (1, 0), (2, 1)} and len(e["root_fully_connected"]) == 6
    assert e["leaf_directed"] == {(0, 3), (0, 4), (1, 5), (1, 6), (2, 7), (2, 8)} and e["leaf_connected_directed"] == {(3, 4), (5, 6), (7, 8)}
    assert len(e["leaf_undirected"]) == 12 and len(e["leaf_connected_undirected"]) == 6
    with pytest.raises(ValueError):
        graph.fixed_graph(["ring"], 3, 2, spark)
    roots = spark.createDataFrame([(0,)], "title int")
    got = {r.title: (r.hops, r.path) for r in graph.shortest_paths(graph.fixed_graph(["root_directed", "leaf_directed"], 3, 2, spark), roots, directed=True).collect()}
    assert got[8] == (3, [0, 1, 2, 8]) and got[0] == (0, [0])
    back = {r.title: (r.hops, r.path) for r in graph.shortest_paths(graph.fixed_graph(["root_directed"], 3, 0, spark), spark.createDataFrame([(2,)], "title int"), directed=True).collect()}
    assert back == {0: (510, None), 1: (510, None), 2: (0, [2])}
