from pathlib import Path

import numpy as np
import pytest

from kgflow import session
from kgflow.llm import neighbours


def brute(rows, k, size):
    ok = [(i, np.array(v, np.float32)) for i, v in rows if i is not None and v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids = np.array([i for i, _ in ok])
    x = np.stack([v for _, v in ok]).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    z = np.round(x @ x.T, 6)
    return {ids[r]: [(int(ids[c]), z[r, c]) for c in sorted(range(len(ids)), key=lambda c: (-z[r, c], ids[c])) if c != r][:k] for r in range(len(ids))}


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(160):
        c = rng.normal(size=16)
        for _ in range(rng.integers(1, 12)):
            rows.append((len(rows), ((c + 0.25 * rng.normal(size=16)) * rng.uniform(0.2, 5)).astype(np.float32).tolist()))
    for i in range(20):
        rows.append((len(rows), rows[i][1]))
    return rows


BAD = [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] * 16), (9003, [1.0] * 15), (9004, [float("inf")] + [1.0] * 15), (None, [1.0] * 16), (9005, [])]


def found(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, embedding array<float>, rep string")
    out = {}
    for r in sorted(neighbours.most_similar(df, size=16, **options).collect(), key=lambda r: (r.id, r.rank)):
        out.setdefault(r.id, []).append((r.neighbour, r.similarity))
    return out


def test_recall_against_brute_force_and_order(spark, vectors, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL", 20)
    got, want = found(spark, vectors + BAD), brute(vectors, 5, 16)
    assert set(got) == set(want)
    close = [(i, n) for i, ns in want.items() for n, s in ns if s >= 0.8]
    hits = sum(n in dict(got[i]) for i, n in close)
    assert hits >= 0.97 * len(close)
    for ns in got.values():
        assert ns == sorted(ns, key=lambda t: (-t[1], t[0])) and len(ns) == len({n for n, _ in ns})
        assert all(abs(round(s, 6) - s) < 1e-9 for _, s in ns)


def test_copies_of_one_vector_take_the_smallest_ids(spark, vectors):
    rows = vectors[:60] + [(10_000 + i, vectors[3][1]) for i in range(400)]
    got, want = found(spark, rows), brute(rows, 5, 16)
    for i in [3, 10_000, 10_002, 10_399]:
        assert [n for n, _ in got[i]] == [n for n, _ in want[i]]


def test_descent_joins_what_the_cells_part(spark, vectors, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL", 8)
    monkeypatch.setattr(neighbours, "VISITS", 2)
    want = brute(vectors, 5, 16)
    close = [(i, n) for i, ns in want.items() for n, s in ns if s >= 0.8]
    share = {}
    for rounds in (0, 3):
        rows = neighbours.valid(spark.createDataFrame(vectors, "id long, embedding array<float>"), "id", "embedding", 16)
        g = {r.src: set(r.dst) for r in neighbours.neighbour_graph(rows, 6, 0.6, rounds=rounds).collect()}
        share[rounds] = sum(n in g.get(i, ()) for i, n in close)
    assert share[3] > share[0]


def test_greedy_search_of_the_graph(spark, vectors, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL", 20)
    rows = neighbours.valid(spark.createDataFrame(vectors, "id long, embedding array<float>"), "id", "embedding", 16)
    graph, pivots = neighbours.neighbour_graph(rows, 6, 0.0), neighbours.pivots_of(rows, len(vectors))
    queries = rows.filter("id % 10 = 0").selectExpr("id as query", "v as q")
    got = {}
    for r in neighbours.graph_search(queries, rows, graph, pivots, k=1).collect():
        got[r.query] = r.sim
    assert len(got) == len([1 for i, _ in vectors if i % 10 == 0])
    assert sum(s >= 999_999 for s in got.values()) >= 0.9 * len(got)


def test_few_or_no_vectors(spark):
    assert found(spark, []) == {} and found(spark, BAD) == {}
    assert found(spark, [(1, [1.0] * 16)]) == {}
    assert found(spark, [(1, [1.0] * 16), (2, [2.0] * 16)]) == {1: [(2, 1.0)], 2: [(1, 1.0)]}


def test_large_cells_are_compared_whole(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 96)).astype(np.float32)
    x[450:] = x[:450] + 0.3 * rng.normal(size=(450, 96)).astype(np.float32)
    x[100:110] = x[100]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>")
    rows = neighbours.valid(df, "id", "embedding", 96)
    pivots = neighbours.pivots_of(rows, 900, 300)

    def edges():
        graph = neighbours.merge(neighbours.first_graph(rows, pivots, 900, 6, 2), 6, 4)
        return {(r.src, d, s) for r in graph.collect() for d, s in zip(r.dst, r.sim) if d >= 0}

    whole = edges()
    for large in (100, 250):
        monkeypatch.setattr(neighbours, "LARGE", large)
        monkeypatch.setattr(neighbours, "DIVIDERS", 0)
        assert edges() == whole
    monkeypatch.setattr(neighbours, "DIVIDERS", 400)
    monkeypatch.setattr(neighbours, "SAMPLE", 400)
    graph = neighbours.merge(neighbours.first_graph(rows, pivots, 900, 6, 2), 6, 4)
    got = {(r.src, d, s) for r in graph.collect() for d, s in zip(r.dst, r.sim) if d >= 0}
    close = {e for e in whole if e[2] >= 800_000}
    assert got != whole and len(got & close) >= 0.9 * len(close)


def test_hot_cells_of_a_search_are_met_in_parts(spark, vectors, monkeypatch):
    monkeypatch.setattr(neighbours, "LARGE", 30)
    monkeypatch.setattr(neighbours, "DIVIDERS", 0)
    test_greedy_search_of_the_graph(spark, vectors, monkeypatch)


def test_the_graph_does_not_depend_on_batches(spark, vectors, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL", 8)
    monkeypatch.setattr(neighbours, "VISITS", 2)
    rows = neighbours.valid(spark.createDataFrame(vectors, "id long, embedding array<float>"), "id", "embedding", 16)
    graphs = []
    for size in ("10000", "37"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        graphs.append(sorted((r.src, tuple(r.dst)) for r in neighbours.neighbour_graph(rows, 6, 0.6, rounds=2).collect()))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert graphs[0] == graphs[1]


def test_rounds_leave_one_graph_and_no_shuffle_files(spark, vectors, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL", 8)
    monkeypatch.setattr(neighbours, "VISITS", 2)
    shared = Path(session.shared_dir(spark).removeprefix("file:"))
    rows = neighbours.valid(spark.createDataFrame(vectors, "id long, embedding array<float>"), "id", "embedding", 16)
    before = set(shared.glob("kgflow-graph-*"))
    graph = neighbours.neighbour_graph(rows, 6, 0.6, rounds=3, settle=0.0)
    assert len(set(shared.glob("kgflow-graph-*")) - before) == 1 and graph.count() > 0
    files = lambda: {p for d in spark.sparkContext._jvm.org.apache.spark.util.Utils.getConfiguredLocalDirs(spark.sparkContext._jsc.sc().conf()) for p in Path(d).glob("**/shuffle_*")}
    kept = files()
    session.materialize(rows.groupBy("id").count().repartition(3, "id"))
    assert files() <= kept


def test_later_rounds_take_up_only_what_moved(spark, vectors, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL", 8)
    monkeypatch.setattr(neighbours, "VISITS", 2)
    rows = neighbours.valid(spark.createDataFrame(vectors, "id long, embedding array<float>"), "id", "embedding", 16)
    met, plain, all_of = [], neighbours.measured, neighbours.candidates

    def measured(pairs, some, cells, k):
        met.append((some.count(), cells.count()))
        return plain(pairs, some, cells, k)

    def edges():
        return sorted((r.src, tuple(r.dst), tuple(r.sim)) for r in neighbours.neighbour_graph(rows, 6, 0.6, rounds=5, settle=0.0).collect())

    monkeypatch.setattr(neighbours, "measured", measured)
    got = edges()
    assert len(met) > 2 and max(met[-1]) < 0.5 * len(vectors), met
    monkeypatch.setattr(neighbours, "candidates", lambda graph, follow, reverse, parts, *_: all_of(graph, follow, reverse, parts))
    assert edges() == got
