import json
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from kgflow import __main__ as cli
from kgflow import external
from kgflow.operators import embed, index, linking, retrieval
from kgflow.plans import workflows
from kgflow.sources import io


def test_storage_and_cache(spark, tmp_path):
    for s in (io.Storage(spark, str(tmp_path / "kv")), io.MemoryStorage()):
        assert s.get("a.txt") is None and not s.has("a.txt")
        s.set("a.txt", "one \u4e2d")
        s.set("b.json", "{")
        assert s.get("a.txt") == "one \u4e2d" and s.keys() == ["a.txt", "b.json"]
        assert s.find(r"(?P<name>\w)\.(?P<kind>\w+)$", {"kind": "^j"}) == [("b.json", {"name": "b", "kind": "json"})]
        s.child("sub").set("c", "x")
        assert s.child("sub").get("c") == "x"
        cache = io.Cache(s)
        assert cache.get("b.json") is None and not cache.has("b.json")
        cache.set("k", {"x": [1]}, prompt="p")
        assert cache.get("k") == {"x": [1]} and json.loads(s.get("k"))["prompt"] == "p"
        s.delete("a.txt")
        assert "a.txt" not in s.keys()
        s.clear()
        assert s.keys() == []
    nothing = io.Cache()
    nothing.set("k", 1)
    assert nothing.get("k") is None and not nothing.child("x").has("k")
    with pytest.raises(ValueError):
        io.Storage(spark, str(tmp_path)).get("../x")


def test_graphml_is_one_valid_file(spark, tmp_path):
    nodes = spark.createDataFrame([("A & <b>", 2, None), ("C", 1, 'q"')], "title string, degree int, note string")
    edges = spark.createDataFrame([("A & <b>", "C", 0.5), (None, "C", 1.0)], "source string, target string, weight double")
    path = str(tmp_path / "g.graphml")
    io.write_graphml(nodes, edges, path, ["degree", "note"], ["weight"])
    ns = "{http://graphml.graphdrawing.org/xmlns}"
    g = ET.parse(path).getroot().find(ns + "graph")
    assert sorted(n.get("id") for n in g.iter(ns + "node")) == ["A & <b>", "C"]
    assert [(e.get("source"), e.get("target"), [d.text for d in e]) for e in g.iter(ns + "edge")] == [("A & <b>", "C", ["0.5"])]


def test_objects_have_the_columns_of_their_kind(spark):
    df = spark.createDataFrame([(1, "t", 3)], "key long, title string, degree long")
    got = io.load_objects(df, "entities", {"id": "key"}).first()
    assert (got.id, got.title, got.degree, got.description) == ("1", "t", 3, None)
    with pytest.raises(ValueError):
        io.load_objects(df, "entities")


def test_rows_are_mapped_within_a_rate_and_may_fail_the_map(spark):
    df = spark.createDataFrame([(i, "bad" if i == 3 else "ok") for i in range(6)], "i int, t string")

    def fn(row):
        if row["t"] == "bad":
            raise KeyError("no")
        return row["t"]

    got = {r.i: (r.response, r.error) for r in external.map_rows(df, fn, ["t"], retries=0, per_minute=6000, tasks=2).collect()}
    assert got[0] == ("ok", None) and got[3][0] is None and "KeyError" in got[3][1]
    with pytest.raises(Exception, match="a row failed"):
        external.map_rows(df, fn, ["t"], retries=0, strict=True).collect()


def test_static_model_extraction_and_index_parts(spark):
    units = spark.createDataFrame([("u1", "x"), ("u2", "y")], "id string, text string")
    said = external.extracted(units, lambda row: f'("entity"<|>{row["text"]}{row["round"]}<|>THING<|>d)', more=2, goes_on=lambda row: row["text"] == "x")
    ents, _ = index.parse_extractions(said.select(F.col("id").alias("text_unit_id"), "response"))
    assert sorted(r.title for r in ents.collect()) == ["X0", "X1", "X2", "Y0"]
    pick = external.static_responses(["a", "b"])
    assert pick({"q": 1}) == pick({"q": 1})
    assert external.embedded_fields("required") == sorted(external.NEEDED_EMBEDDINGS) and external.embedded_fields("none") == []
    assert external.strategy("summarize", "join")(["a", "b"]) == "a\nb"


@pytest.fixture(scope="module")
def built(spark):
    texts = ["Alpha Router links Beta Switch and Gamma Host.", "Beta Switch feeds Delta Node near Gamma Host.", "Epsilon Cache serves Zeta Proxy.", "Zeta Proxy asks Epsilon Cache and Alpha Router."]
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "id string, text string")
    t = workflows.build_index(docs, size=40, overlap=5)
    vectors = t["entities"].select("id", external.hashed_embedding(F.col("title")).alias("embedding")).cache()
    return t, vectors


def test_drift_search_is_bounded_and_keeps_its_state(spark, built):
    t, vectors = built
    asked = []

    def follow(question, contexts):
        asked.append(question)
        return f"answer {question}", 1.0, [(f"{question}/{i}", [float(i)] * 16) for i in (1, 2, 3)] + [("root", [0.5] * 16)]

    state = workflows.drift_search(t, vectors, "root", [0.5] * 16, follow, depth=2, follow_ups=2, k=2)
    assert asked == ["root", "root/1", "root/2"]
    nodes, edges = state.tables(spark)
    assert nodes.filter("done").count() == 3 and nodes.count() == 1 + 3 + 6 and {(0, 1), (1, 0)} <= {tuple(e) for e in edges.collect()}

    def primer(folds):
        return folds.groupBy("fold").agg(F.lit("part").alias("answer"), F.array(F.struct(F.lit("next").alias("question"), F.array(*[F.lit(0.1)] * 16).alias("vector"))).alias("follow_ups"), F.lit(2.0).alias("score"))

    reports = t["community_reports"].select("community", external.hashed_embedding(F.col("full_content")).alias("embedding"))
    state = workflows.drift_search(t, vectors, "root", [0.5] * 16, follow, primer, reports, depth=1, k=2, folds=2)
    assert state.actions[0]["answer"].startswith("part") and "next" in asked


def test_contexts_of_many_queries_and_of_several_indexes(spark, built):
    t, vectors = built
    queries = spark.createDataFrame([(1, [0.5] * 16), (2, [-0.5] * 16), (3, None), (4, [0.0] * 16)], "qid int, q array<double>")
    ents, rels = workflows.batch_contexts(t, vectors.select("id", F.col("embedding").alias("v")), queries, k=3, max_tokens=200)
    assert {r.qid for r in ents.collect()} == {1, 2} and all(r.state <= 3 for r in rels.collect())
    both = workflows.multi_index_tables({"a": t, "b": t})
    assert both["entities"].count() == 2 * t["entities"].count() and both["members"].select("community").distinct().count() == 2 * t["members"].select("community").distinct().count()
    v = vectors.select(F.concat("id", F.lit("-a")).alias("id"), "embedding").unionByName(vectors.select(F.concat("id", F.lit("-b")).alias("id"), "embedding"))
    found = workflows.local_search(both, [0.5] * 16, v, 4, 4, 400)
    assert {r.title[-2:] for r in found["entities"].collect()} == {"-a", "-b"} and found["reports"].count() > 0


def test_growth_stops_at_the_state_before_the_one_that_does_not_fit(spark):
    found = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c")], "qid int, ord int, title string")
    edges = spark.createDataFrame([("a", "b", 5), ("b", "c", 4), ("a", "x", 3), ("c", "y", 2)], "source string, target string, combined_degree int")
    grow = lambda most: {(r.state, r.source, r.target, r.kind) for r in retrieval.grown_contexts(found, edges, F.lit(1), F.lit(2), most, 5)[1].collect()}
    assert grow(100) == {(3, "a", "b", "in"), (3, "b", "c", "in"), (3, "a", "x", "out"), (3, "c", "y", "out")}
    assert grow(9) == {(2, "a", "b", "in"), (2, "b", "c", "out"), (2, "a", "x", "out")}  # 3 + 8 > 9 with the third
    assert grow(6) == set()  # 3 + 4 > 6 with the first already
    assert retrieval.grown_contexts(found.limit(0), edges, F.lit(1), F.lit(2), 9, 5)[1].collect() == []


def test_batches_take_blocks_of_queries(spark):
    docs = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(50)] + [(90, None), (91, [0.0, 0.0, 0.0]), (92, [1.0, 2.0])], "id long, v array<double>")
    queries = docs.filter("id < 9").selectExpr("id AS qid", "v AS q")
    one = sorted(map(tuple, retrieval.batch_vector_search(queries, docs, 3).collect()))
    assert one == sorted(map(tuple, retrieval.batch_vector_search(queries, docs, 3, block=2).collect())) and len(one) == 27


def test_children_are_linked_back(spark):
    t = spark.createDataFrame([(0, "x1"), (1, "x2")], "human_readable_id int, id string")
    got = linking.linked_context(spark.createDataFrame([(1, "b"), (7, "z")], "id int, text string"), t, ["id"]).orderBy("id").collect()
    assert [(r.id, r.index_id) for r in got] == [(1, "x2"), (7, None)]


def test_walks_and_vectors_of_nodes(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "a"), (None, "c")], "source string, target string")
    walks = embed.random_walks(edges, 3, 6).collect()
    assert len(walks) == 9 and all(len(w.path) == 6 and w.path[0] == w.title for w in walks)
    assert all({x, y} in ({"a", "b"}, {"b", "c"}) for w in walks for x, y in zip(w.path, w.path[1:]))
    got = {r.title: len(r.vector) for r in embed.node_vectors(edges, 8, walks=2, length=5).collect()}
    assert got == {"a": 8, "b": 8, "c": 8}


def test_command_line(spark, tmp_path, capsys):
    docs = spark.createDataFrame([("1", "Alpha Router links Beta Switch."), ("2", "Beta Switch feeds Gamma Host.")], "id string, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    cli.main(["index", str(tmp_path / "docs"), str(tmp_path / "index"), "--size", "20", "--overlap", "2"])
    spark.createDataFrame([("3", "Gamma Host asks Delta Node.")], "id string, text string").write.parquet(str(tmp_path / "more"))
    cli.main(["update", str(tmp_path / "more"), str(tmp_path / "index"), "--to", str(tmp_path / "next"), "--size", "20", "--overlap", "2"])
    assert spark.read.parquet(str(tmp_path / "next" / "entities.parquet")).filter("title = 'DELTA NODE'").count() == 1
    cli.main(["search", str(tmp_path / "next"), "BETA SWITCH", "-k", "2"])
    assert "BETA SWITCH" in capsys.readouterr().out
