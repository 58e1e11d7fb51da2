from datetime import datetime, timedelta

from pyspark.sql import functions as F

from kgflow import external
from kgflow.sources import io
from kgflow.streaming import incremental


def test_files_with_named_groups(spark, tmp_path):
    for name, text in (("a_2024.txt", "one\ntwo"), ("b_2023.txt", "three"), ("skip.md", "no")):
        (tmp_path / name).write_text(text)
    got = {r.title: (r.source, r.year, r.text) for r in io.text_documents(spark, str(tmp_path), r"(?P<source>\w)_(?P<year>\d+)\.txt$", {"year": "^2024$"}).collect()}
    assert got == {"a_2024.txt": ("a", "2024", "one\ntwo")}


def test_csv_with_quotes_and_hash_ids(spark, tmp_path):
    (tmp_path / "x.csv").write_text('head,relation_type,tail\n"a, b",is_a,"c ""d"""\ne,f,\n')
    rows = io.csv_documents(spark, str(tmp_path), io.TRIPLE, text="head").orderBy("head").collect()
    assert [(r.head, r.tail) for r in rows] == [("a, b", 'c "d"'), ("e", None)] and len({r.id for r in rows}) == 2


def test_tables_resume_thresholds_and_union(spark, tmp_path):
    df = spark.range(10).select(F.col("id"), (F.col("id") % 3).alias("part"), (F.col("id") / 10).alias("score"))
    io.write_table(df, str(tmp_path), "t")
    assert io.exists(spark, f"{tmp_path}/t.parquet") and io.load_table(spark, str(tmp_path), "t").count() == 10
    out = str(tmp_path / "chunks")
    assert io.unfinished(df, "part", out).count() == 10
    io.write_resumable(df.filter("part = 1"), "part", out)
    assert {r.part for r in io.unfinished(df, "part", out).collect()} == {0, 2}
    io.write_thresholds(df, "score", [0.5, 0.8], str(tmp_path / "s"))
    assert spark.read.option("header", True).csv(f"{tmp_path}/s_0.8").count() == 2
    assert io.unite([df, df], 20).count() == 20 and io.delete(spark, f"{tmp_path}/t.parquet") and not io.exists(spark, f"{tmp_path}/t.parquet")
    assert [x.count() for x in io.routed(df.select((F.col("id") * 100 + 100).alias("code")), "code").values()] == [1, 0, 9]


def test_external_rows_keep_their_errors(spark):
    def shout(row):
        if row["t"] == "bad":
            raise RuntimeError("no")
        return row["t"].upper()

    got = {r.t: (r.response, r.error) for r in external.map_rows(spark.createDataFrame([("a",), ("bad",)], "t string"), shout, ["t"]).collect()}
    assert got == {"a": ("A", None), "bad": (None, "RuntimeError: no")}
    v = spark.range(1).select(external.hashed_embedding(F.lit("x"), 4).alias("v")).first().v
    assert len(v) == 4 and all(-1 <= x < 1 for x in v)


def test_stream_merges_batches_once(spark, tmp_path):
    src, table = tmp_path / "in", str(tmp_path / "table")
    for n in range(2):
        spark.createDataFrame([(i, n) for i in range(n * 2, n * 2 + 4)], "id long, n int").coalesce(1).write.mode("append").parquet(str(src))
    merge = lambda old, new: old.unionByName(new.join(old, "id", "left_anti"))
    for _ in range(2):  # a second run finds nothing new
        q = incremental.merge_stream(incremental.read_stream(spark, str(src), "id long, n int", files=1), table, merge, str(tmp_path / "ck"))
        q.awaitTermination(120)
    last = spark.read.parquet(f"{table}/v=1")
    assert sorted(r.id for r in last.collect()) == [0, 1, 2, 3, 4, 5]


def test_windows_sessions_and_late_rows(spark, tmp_path):
    at = datetime(2024, 1, 1)
    rows = [(i, at + timedelta(minutes=20 * i), i % 2, "click", 1.0) for i in range(12)]
    e = spark.createDataFrame(rows, "event_id int, ts timestamp, user_id int, event_type string, value double")
    assert incremental.window_counts(e, "1 hour").count() == 4
    assert {(r.user_id, r.n) for r in incremental.sessions(e, "50 minutes").collect()} == {(0, 6), (1, 6)}
    e.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = incremental.window_counts(incremental.read_stream(spark, str(tmp_path / "e"), e._jdf.schema().toDDL()), "1 hour", late="10 minutes")
    q = stream.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("w").agg(F.sum("n")).first()[0] == 12
