import math
import random

import pytest
from pyspark.sql import functions as F

from kgflow.functions import arrays as A
from kgflow.functions import text as T
from kgflow.operators import evaluate, graph, ids, index, retrieval, triples, update
from kgflow.plans import workflows


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    ("fn", "value", "want"),
    [
        (T.normalize_entity, " \tBit_Torrent–x ", "bit torrent-x"),
        (T.normalize_entity, None, None),
        (T.clean_str, " a &amp; b\x00 ", "a & b"),
        (T.after_think, "<think>no</think> yes </think>", "yes </think>"),
        (T.last_bracket, "p [no] q [ Yes ] r", "yes"),
        (T.last_bracket, "nothing", ""),
        (T.boxed_choice, r"\boxed{C}", 2),
        (T.boxed_choice, "", 4),
        (T.last_json_object, 'x {"a": 1} y {"b": "2"}', '{"b":"2"}'),
        (T.last_json_object, "{bad", ""),
        (T.dehyphenate, "net-\n work  is", "network is"),
        (T.strip_lead, "Background: we show", "we show"),
        (T.relation_name, " a  b ", "a__b"),
        (T.line_verdicts, "1: yes\nx\n2: weak no", ["yes", "weak"]),
        (T.ngram_set, "ab", []),
        (T.ngram_set, "abab", ["aba", "bab"]),
        (lambda c: T.answer_relation(c, ["uses", "is_a"]), "Answer: is_a", "is_a"),
        (lambda c: T.answer_relation(c, ["uses", "is_a"]), "it uses x", "uses"),
        (lambda c: T.last_json_lists(c, 2), "[['a'],['b','c'],['d']]", [["a"], ["b", "c"]]),
        (lambda c: T.last_json_lists(c, 2), "none", [[], []]),
        (T.head_variants, "Fiber‐Home (FTTH)", ["fiber‐home (ftth)", "fiber-home (ftth)", "fiber - home (ftth)", "fiber-home", "fiber - home", "fiber-home (ftth)s"]),
    ],
)
def test_scalars(spark, fn, value, want):
    assert one(spark, value, fn) == want


def test_arrays(spark):
    df = spark.createDataFrame([([1, 2, 3, 2, 3], [2, 3], [], '{"a":[{"relation":"a | r | b","score":0.5,"tail_cui":"c"}],"z":[]}', "{bad")], "a array<int>, b array<int>, e array<int>, j string, x string")
    r = df.select(A.find_subarray(F.col("a"), F.col("b")).alias("f"), A.find_subarray(F.col("b"), F.col("a")).alias("g"), A.find_subarray(F.col("a"), F.col("e")).alias("h"), A.windows(F.col("a"), 3, 1).alias("w"), A.windows(F.col("e"), 3).alias("w0"), A.zipped(F.col("a"), F.col("b"), ("p", "q")).alias("z")).first()
    assert (r.f, r.g, r.h) == (1, -1, -1) and [(w.start, w["items"]) for w in r.w] == [(0, [1, 2, 3]), (2, [3, 2, 3]), (4, [3])] and r.w0 == []
    assert [(z.p, z.q) for z in r.z] == [(1, 2), (2, 3)]
    m = df.withColumn("m", A.json_map(F.col("j"), A.RELATIONS_SCHEMA))
    assert sorted((x.head, x.score) for x in A.exploded_pairs(m, "m").collect() if x.score) == [("a", 0.5)] and A.exploded_pairs(m, "m").count() == 2
    assert df.select(A.json_map(F.col("x"), "map<string,int>").alias("m")).first().m == {}
    s = spark.createDataFrame([([1.0, 1.0],)], "v array<double>").select(A.softmax(F.col("v")).alias("s"), A.cosine(F.col("v"), F.array(F.lit(0.0), F.lit(0.0))).alias("c")).first()
    assert s.s == [0.5, 0.5] and s.c is None
    with pytest.raises(ValueError):
        A.windows(F.col("a"), 2, 2)


def test_nan_and_null_scores_do_not_pass_a_threshold(spark):
    df = spark.createDataFrame([(1, 0.9), (2, 0.5), (3, float("nan")), (4, None)], "id int, score double")
    assert [r.id for r in triples.above(df, "score", 0.5).collect()] == [1]


def test_cleaning_cascade_counts_every_row_once(spark):
    rows = [(1, "TCP", "is_a", "protocol"), (2, "tcp ", "is_a", "Protocol"), (3, "host a", "uses", "x"), (4, "Alice", "uses", "x"), (5, "a", "measures", "x"), (6, "youtube", "uses", "x"), (7, "a", "uses", "b"), (8, None, "uses", "b"), (9, "tcp", "uses", "weak"), (10, "tcp", "uses", "strong"), (11, "w", "uses", "z")]
    rules = triples.CleaningRules(wrong=[("w", "uses", "z")], superseded=[("tcp", "uses", "weak", "strong")])
    got = {r.row_id: r.reason for r in triples.cleaning_reasons(spark.createDataFrame(rows, "row_id int, head string, relation_type string, tail string"), ["row_id"], rules=rules).collect()}
    assert got == {1: "trivial_isa", 2: "exact_duplicate", 3: "instance_specific", 4: "alice_bob", 5: "dropped_relation", 6: "commercial", 7: None, 8: None, 9: "near_dupe", 10: None, 11: "factually_wrong"}


def test_blacklist_keeps_null_relations(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "relation_type string")
    assert {r[0] for r in triples.without_relations(df, ["a"]).collect()} == {"b", None}


def test_linking_keeps_ties(spark):
    got = triples.link_by_ngrams(spark.createDataFrame([("abcd",)], "head string"), spark.createDataFrame([("abcde",), ("xabcd",), ("zzzz",)], "name string"), 0.1, 0.1).collect()
    assert {r.name for r in got} == {"abcde", "xabcd"}


def test_graph_shapes(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "a"), ("c", None), ("d", "e")], "source string, target string")
    assert {r.title: r.degree for r in graph.degree_undirected(e).collect()} == {"a": 3, "b": 1, "d": 1, "e": 1}
    assert {r.title: r.degree for r in graph.degree_directed(e).collect()} == {"a": 4, "b": 2, "d": 1, "e": 1}
    assert {r.title: r.component for r in graph.components(e).collect()} == {"a": "a", "b": "a", "d": "d", "e": "d"}
    assert graph.components(e.limit(0)).collect() == []
    chain = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)], "source string, target string")
    assert {r.component for r in graph.components(chain).collect()} == {"n000"}


def test_components_of_long_paths_with_shuffled_names(spark):
    names = [f"n{i:04d}" for i in range(1200)]
    random.Random(4).shuffle(names)
    e = spark.createDataFrame([(a, b) for i, (a, b) in enumerate(zip(names, names[1:])) if i != 999] + [("z", "z")], "source string, target string")
    got = {r.title: r.component for r in graph.components(e).collect()}
    assert got == {t: min(names[:1000]) for t in names[:1000]} | {t: min(names[1000:]) for t in names[1000:]} | {"z": "z"}
    assert {r.title for r in graph.largest_component(e).collect()} == {t.upper() for t in names[:1000]}
    with pytest.raises(RuntimeError):
        graph.components(e, rounds=2)


def test_numbers_are_consecutive_and_split_is_ordered(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(7)
    assert [r.n for r in ids.numbered(df, ["k"], "n", 1).orderBy("k").collect()] == list(range(1, 1001))
    got = ids.head_tail_split(df, ["k"], 15).filter("split = 'validation'").agg(F.max("k").alias("m"), F.count("*").alias("n")).first()
    assert (got.m, got.n) == (149, 150)


def test_budget_is_a_prefix(spark):
    df = spark.createDataFrame([(1, 5), (2, 4), (3, 2), (4, 1)], "o int, n int")
    assert [r.o for r in retrieval.budget_prefix(df, ["o"], F.col("n"), 10).orderBy("o").collect()] == [1, 2]


def test_report_batches_fold(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([4, 4, 4, 9, 1, 12])], "i int, n int")
    assert [r.batch for r in retrieval.report_batches(df, ["i"], "n", 10).orderBy("i").collect()] == [0, 0, 1, 2, 2, 3]
    assert [r.i for r in retrieval.report_batches(df, ["i"], "n", 10, single=True).orderBy("i").collect()] == [0, 1]


def test_community_context_stops_at_the_budget(spark):
    rows = [(0, 1, i, f"n{i}", f"n{i + 1}", 10 - i, 2, 1, 1) for i in range(5)]
    got = retrieval.community_context(spark.createDataFrame(rows, "level int, community long, id int, source string, target string, combined_degree int, size int, s_size int, t_size int"), 10).first()
    assert (got.edges, got.nodes, got.used) == (3, 4, 10)


def test_merging_the_same_delta_twice_adds_no_key(spark):
    schema = "id string, title string, type string, descriptions array<string>, text_unit_ids array<string>"
    old = spark.createDataFrame([("1", "A", "T", ["x"], ["u1"])], schema)
    delta = spark.createDataFrame([("9", "A", "S", ["y"], ["u2"]), ("8", "B", "S", ["z"], ["u2"])], schema)
    once, mapping = update.upsert_entities(old, delta)
    twice, _ = update.upsert_entities(once.select("id", "title", "type", "descriptions", "text_unit_ids"), delta)
    first = {r.title: r for r in once.collect()}
    assert (first["A"].id, first["A"].type, first["A"].descriptions, first["A"].text_unit_ids) == ("1", "T", ["x", "y"], ["u1", "u2"])
    assert [tuple(r) for r in mapping.collect()] == [("9", "1")]
    assert {r.title: r.text_unit_ids for r in twice.collect()} == {t: r.text_unit_ids for t, r in first.items()}
    units = spark.createDataFrame([("u2", ["8", "9"]), ("u3", [])], "id string, entity_ids array<string>")
    assert {r.id: r.entity_ids for r in update.remap_ids(units, "entity_ids", mapping).collect()} == {"u2": ["8", "1"], "u3": []}


def test_missing_answers_are_wrong(spark):
    truth = spark.createDataFrame([(1, "x", "yes"), (2, "x", "no"), (3, "y", "no")], "i int, level string, answer string")
    said = spark.createDataFrame([(1, "s", "yes"), (3, "s", "no")], "i int, seed string, said string")
    got = {r.level: r.accuracy for r in evaluate.accuracy(truth, said, ["i"], "level").collect()}
    assert got["x"] == 0.5 and got["y"] == 1.0 and math.isclose(got[None], 2 / 3)


def test_majority_ties_take_the_least(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, None)], "g int, v string")
    assert [tuple(r) for r in evaluate.majority(df, ["g"], "v").collect()] == [(1, "a", 1)]


def test_results_do_not_depend_on_partitions(spark):
    rows = [(i, f"h{i % 9}", f"r{i % 4}", f"t{i % 13}", (i * 37 % 101) / 101) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, head string, relation_type string, tail string, score double")
    run = lambda d: sorted(map(tuple, triples.select_seed_triples(d, 0.2, 5, "head", ["i"]).collect()))
    assert run(df.repartition(1)) == run(df.repartition(8))


def test_index_is_built_searched_and_updated(spark):
    text = "The Alpha Router sends frames to the Beta Switch. The Beta Switch and the Gamma Host share a Delta Link. "
    docs = spark.createDataFrame([(f"d{i}", text + f"Node{i % 3} Hub waits for Alpha Router.") for i in range(6)] + [("d9", "")], "id string, text string")
    t = workflows.build_index(docs, size=40, overlap=10, max_size=3)
    assert t["final_documents"].filter("id = 'd9' AND size(text_unit_ids) = 0").count() == 1
    ends = {r.title for r in t["entities"].collect()}
    assert {"ALPHA ROUTER", "BETA SWITCH"} <= {e for e in ends} or any("ALPHA" in e for e in ends)
    vectors = t["entities"].select("id", F.array(F.length("title").cast("double"), F.lit(1.0)).alias("embedding"))
    found = workflows.local_search(t, [1.0, 2.0], vectors, k=3)
    assert found["entities"].count() >= 1 and all(df.count() >= 0 for df in found.values())
    points = workflows.global_search(t, lambda text: F.to_json(F.struct(F.array(F.struct(text.alias("description"), F.lit(1.0).alias("score"))).alias("points"))), budget=10_000)
    assert points.count() >= 1
    new = workflows.update_index(t, docs.unionByName(spark.createDataFrame([("d10", "Omega Core calls Alpha Router.")], "id string, text string")), size=40, overlap=10, max_size=3)
    assert new["documents"].count() == 8 and new["entities"].filter("title LIKE '%OMEGA%'").count() == 1
    assert index.summarize_descriptions is not None


def test_an_updated_index_is_whole_and_can_be_searched(spark):
    text = "The Alpha Router sends frames to the Beta Switch. The Beta Switch and the Gamma Host share a Delta Link. "
    first = spark.createDataFrame([(f"d{i}", text + f"Node{i % 3} Hub waits for Alpha Router.") for i in range(4)], "id string, text string")
    docs = first.unionByName(spark.createDataFrame([("d10", "Omega Core calls Alpha Router. The Beta Switch and the Gamma Host share a Delta Link.")], "id string, text string"))
    options = {"size": 40, "overlap": 10, "max_size": 3}
    old, whole = workflows.build_index(first, **options), workflows.build_index(docs, **options)
    old["entities"] = old["entities"].withColumn("description", F.concat(F.lit("about "), "title"))
    new = workflows.update_index(old, docs, **options)
    assert set(whole) <= set(new)
    rows = lambda t, name, *c: sorted(tuple(tuple(sorted(x)) if isinstance(x, list) else round(x, 9) if isinstance(x, float) else x for x in r) for r in t[name].select(*c).collect())
    for name, columns in (("entities", ("title", "id", "type", "text_unit_ids", "frequency", "degree")), ("relationships", ("source", "target", "id", "text_unit_ids", "combined_degree", "pmi")), ("text_units", ("id", "n_tokens")), ("final_documents", ("id", "text_unit_ids")), ("final_text_units", ("id", "entity_ids", "relationship_ids"))):
        assert rows(new, name, *columns) == rows(whole, name, *columns), name
        if name != "text_units":
            numbers = sorted(r[0] for r in new[name].select("human_readable_id").collect())
            assert numbers == list(range(numbers[0], numbers[0] + len(numbers)))
    assert new["entities"].filter("title LIKE '%ALPHA%' AND NOT array_contains(descriptions, concat('about ', title))").count() == 0
    for name in ("communities", "community_reports"):
        assert new[name].select("community").distinct().count() == new[name].select("id").distinct().count() == new[name].count() > old[name].count()
    assert new["members"].join(new["communities"], ["level", "community", "parent"]).count() == new["members"].count()
    vectors = new["entities"].select("id", F.when(F.col("title").contains("OMEGA"), F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))).alias("embedding"))
    found = workflows.local_search(new, [1.0, 0.0], vectors, k=1)
    assert all(df.count() for df in found.values())
    points = workflows.global_search(new, lambda text: F.to_json(F.struct(F.array(F.struct(text.alias("description"), F.lit(1.0).alias("score"))).alias("points"))), budget=10_000)
    assert any("OMEGA" in str(r) for r in points.collect())
    again = workflows.update_index(new, docs.unionByName(spark.createDataFrame([("d11", "Omega Core calls Zeta Node.")], "id string, text string")), **options)
    assert again["final_documents"].count() == 6 and again["entities"].filter("title LIKE '%ALPHA%' AND size(descriptions) = 0").count() == 0


def test_expansion_is_whole_however_its_tokens_are_met(spark, monkeypatch):
    rows = [("h", "r", t, 0.5 / (i + 1)) for i, t in enumerate("a b c d".split())] + [("g", "r", "a", 0.3), (None, "r", "b", 0.2), ("g", "r", "##a", 0.9), ("g", "r", "zz", 0.9)]
    p = spark.createDataFrame(rows, "head string, relation string, token string, prob double")
    entities = ["a b", "c", "b c d", "x a", "y", "d d", None, " ", "c"]
    want, words = {}, {e: set(e.split()) for e in entities if e}
    fan = {t: sum(t in w for w in words.values()) for _, _, t, _ in rows}
    for h, r, t, prob in rows:
        for e, w in words.items():
            if t in w:
                want.setdefault((h, r, e), []).append((t, math.log(prob + 1e-12) / fan[t]))
    want = {k: (round(sum(x for _, x in v), 9), len(v), sorted(t for t, _ in v)) for k, v in want.items()}
    for carried, pairs in ((256, 1_000_000), (2, 1_000_000), (256, 1), (1, 2)):
        monkeypatch.setattr(triples, "CARRIED", carried)
        monkeypatch.setattr(triples, "PAIRS", pairs)
        df = triples.expansion_scores(p, spark.createDataFrame([(e,) for e in entities], "entity string"))
        got = df.collect()
        assert {(r.head, r.relation, r.tail): (round(r.score, 9), r.n_evidence, r.tokens) for r in got} == want and len(got) == len(want)
    known = df.filter("tail = 'c'").select("head", "relation", "tail")
    ways = [sorted(map(tuple, triples.expansion_candidates(df, k).collect()), key=str) for k in (known, F.col("tail") == "c")]
    assert ways[0] == ways[1] and ways[0]


def test_expansion_pairs_are_not_shuffled(spark):
    """What the join of tokens gives is many times its input: no exchange may lie above it."""
    p = spark.createDataFrame([("h", "r", "a", 0.5)], "head string, relation string, token string, prob double")
    df = triples.expansion_scores(p, spark.createDataFrame([("a b",)], "entity string"))
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    main = plan[: plan.index("array_intersect")]
    assert "Exchange" not in main


def test_injection_is_whole_in_lists_and_repeats_itself_in_a_file(spark, monkeypatch, tmp_path):
    mentions = [(i, ("hot", " Hot ", "HOT")[i % 3 if i < 9 else 0]) for i in range(1_500)] + [(None, "hot"), (1, "hot"), (1, "hot"), (7, "cold"), (8, None), (9, "none")]
    facts = [("hot", f"r{i % 3}", f"tail {i}") for i in range(200)] + [("hot", None, None), ("hot", "r0", "tail 0"), ("cold", "r", "t"), (None, "r", "t"), ("", "r", "t")]
    want = sorted((str(i), e, str(r), str(t)) for i, e in mentions if e for h, r, t in facts if h == e.strip().lower())
    m, f = spark.createDataFrame(mentions, "id long, entity string"), spark.createDataFrame(facts, "head string, relation_type string, tail string")
    for ids, some, rows in ((1_008, 1_008, 5_000_000), (100, 7, 1_000), (1, 1, 10_000)):
        monkeypatch.setattr(triples, "IDS", ids)
        monkeypatch.setattr(triples, "FACTS", some)
        monkeypatch.setattr(triples, "INJECTED", rows)
        got = triples.inject(m if ids > 1 else m.filter("id < 20 OR id IS NULL"), f)
        assert got.columns == ["id", "head", "relation_type", "tail"]
        few = [w for w in want if ids > 1 or w[0] == "None" or int(w[0]) < 20]
        assert sorted((str(r.id), r.head, str(r.relation_type), str(r.tail)) for r in got.collect()) == few
    monkeypatch.undo()
    m = spark.range(200_000).selectExpr("xxhash64(id) AS id", "if(id < 400, 'hot', concat('other ', id)) AS entity")
    f = spark.range(5_001).selectExpr("'hot' AS head", "'r' AS relation_type", "concat('tail ', id) AS tail")
    triples.inject(m, f).write.parquet(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 400 * 5_001
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 0.5 * 400 * 5_001
