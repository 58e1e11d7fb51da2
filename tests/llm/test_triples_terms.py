from collections import Counter, defaultdict

from pyspark.sql import functions as F

from kgflow.llm import copies, terms

TRIPLES = "row_id long, head string, relation_type string, tail string, _id string, kept int"


def triples(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], TRIPLES)  # two columns clash with internal names


def found(spark, rows, labels=("is_a", "carries")):
    known = spark.createDataFrame([(x, i) for i, x in enumerate(labels)], "relation_type string, relation_id int")
    return {r.row_id: (r.kept, r.n_copies) for r in copies.triple_copies(triples(spark, rows), known).collect()}


def test_copies_ignore_case_punctuation_and_place_of_the_label(spark):
    rows = [
        (5, "Link Layer", "is_a", "layer"), (2, "link-layer", "IS A", " Layer."), (9, "is_a", "LINK LAYER", "layer"), (7, "link layer", "layer", "is-a"),
        (8, "layer", "is_a", "link layer"), (1, "link layer", "isnota", "layer"), (3, None, "is_a", "x"), (4, "--", "is_a", "x"), (6, "réseau", "carries", "x"), (10, "reseau", "carries", "x"),
    ]
    got = found(spark, rows)
    assert got[2] == got[5] == got[7] == got[9] == (2, 4)
    assert {i for i, (k, _) in got.items() if i == k} == {1, 2, 6, 8, 10}
    assert 3 not in got and 4 not in got


def test_label_in_two_columns_and_repeated_rows(spark):
    got = found(spark, [(1, "carries", "is_a", "x"), (1, "carries", "is_a", "x"), (2, "carries", "is_a", "X!"), (3, "is_a", "carries", "x")])
    assert got[1] == (1, 3) and got[2] == (1, 3) and got[3] == (3, 1)


def test_hot_group_and_empty_table(spark):
    rows = [(i, "a", "is_a", "b" if i % 3 == 0 else f"b{i}") for i in range(18_000)]
    got = found(spark, rows)
    assert len(got) == 18_000 and got[17_997] == (0, 6_000) and got[1] == (1, 1)
    assert found(spark, []) == {}


def test_multiset_hash_is_commutative_and_keeps_fields_apart(spark):
    df = spark.createDataFrame([("u", "v")], "a string, b string")
    h = lambda *p: df.select(copies.multiset_hash(list(p), "s").alias("h")).first().h
    assert h(("x", F.col("a")), ("y", F.col("b"))) == h(("y", F.col("b")), ("x", F.col("a"))) != h(("x", F.col("b")), ("y", F.col("a")))


def test_term_frequencies_equal_counting(spark):
    rows = [(i % 700, f"T-{i % 37}" if i % 5 else "Hot ") for i in range(5_000)] + [(1, None), (2, " "), (None, "hot"), (3, "seldom"), (3, "Seldom"), (3, "once!")]
    df = spark.createDataFrame([(*r, "q") for r in rows], "id long, v string, term string")
    got = {r.term: (r.occurrences, r.records, r.mark) for r in terms.term_frequencies(df, "id", "v").collect()}
    occurrences, records = Counter(), defaultdict(set)
    for i, v in rows:
        t = "".join(c for c in (v or "").lower() if c.isalnum())
        if t and i is not None:
            occurrences[t] += 1
            records[t].add(i)
    want = {t: (n, len(records[t]), "rare" if len(records[t]) < 3 else "common" if len(records[t]) > 0.02 * 700 else None) for t, n in occurrences.items()}
    assert got == want and got["seldom"][2] == "rare"


def test_bitmaps_of_parts_merge_by_union(spark):
    df = spark.createDataFrame([(i % 90, "a" if i % 2 else "b") for i in range(400)], "id long, t string")
    parts = terms.record_bitmaps(df.filter("id < 50"), "id", "t").unionByName(terms.record_bitmaps(df.filter("id >= 40"), "id", "t"))
    merged = parts.groupBy("term", "word").agg(F.bit_or("bits").alias("bits")).groupBy("term").agg(F.sum(F.bit_count("bits").cast("long")).alias("n"))
    assert {r.term: r.n for r in merged.collect()} == {"a": 45, "b": 45}


def test_terms_of_an_empty_table_and_negative_ids(spark):
    assert terms.term_frequencies(spark.createDataFrame([], "id long, v string"), "id", "v").collect() == []
    got = terms.term_frequencies(spark.createDataFrame([(-1, "a"), (-64, "a"), (-65, "a"), (63, "a")], "id long, v string"), "id", "v").collect()
    assert [(r.occurrences, r.records) for r in got] == [(4, 4)]


def test_colliding_fingerprints_merge_nothing(spark, monkeypatch):
    rows = [(1, "a", "is_a", "b"), (2, "A", "is a", "b!"), (3, "c", "is_a", "d"), (4, "c", "is_a", "D"), (4, "x", "is_a", "y"), (5, "x", "is_a", "y"), (6, "lone", "is_a", "y")]
    df, known = triples(spark, rows), spark.createDataFrame([("is_a", 1)], "relation_type string, relation_id int")
    want = sorted(tuple(r) for r in copies.triple_copies(df, known).collect())
    assert (4, 4, 2) in want and (5, 4, 2) in want and (4, 3, 2) in want
    monkeypatch.setattr(copies, "multiset_hash", lambda pairs, salt: F.lit(7).cast("long"))
    assert sorted(tuple(r) for r in copies.triple_copies(df, known).collect()) == want
    monkeypatch.setattr(copies, "HOT_ROWS", 2)
    assert sorted(tuple(r) for r in copies.triple_copies(df, known).collect()) == want


def test_record_ids_must_be_numbers(spark):
    import pytest

    with pytest.raises(ValueError):
        terms.term_frequencies(spark.createDataFrame([("r1", "x")], "id string, term string"), "id", "term")
