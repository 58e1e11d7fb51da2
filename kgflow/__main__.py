"""Command line: build an index of documents, update it, and search it."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import external
from .plans import workflows
from .session import build_session
from .sources import io


def save(t: workflows.Tables, out: str) -> None:
    for name, df in t.items():
        df.write.mode("overwrite").parquet(f"{out}/{name}.parquet")


def load(spark: SparkSession, path: str) -> workflows.Tables:
    return {n.removesuffix(".parquet"): spark.read.parquet(f"{path}/{n}") for n in io.keys(spark, path) if n.endswith(".parquet")}


def documents(spark: SparkSession, path: str, kind: str, id_col: str, text_col: str) -> DataFrame:
    df = io.text_documents(spark, path) if kind == "txt" else io.read_any(spark, path, kind)
    return df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser("kgflow", description=__doc__)
    p.add_argument("--master", default=None)
    p.add_argument("--shared", default=None, help="folder that all executors share")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("index", "update"):
        c = sub.add_parser(name)
        c.add_argument("docs")
        c.add_argument("out", help="the index; an update reads it and writes to --to")
        c.add_argument("--to")
        c.add_argument("--kind", default="parquet", choices=["parquet", "csv", "json", "orc", "txt"])
        c.add_argument("--id", default="id")
        c.add_argument("--text", default="text")
        c.add_argument("--size", type=int, default=300)
        c.add_argument("--overlap", type=int, default=50)
    c = sub.add_parser("search")
    c.add_argument("index")
    c.add_argument("query")
    c.add_argument("--how", default="local", choices=["local", "basic"])
    c.add_argument("-k", type=int, default=5)
    a = p.parse_args(argv)
    spark = build_session("kgflow", a.master, **({"spark.checkpoint.dir": a.shared} if a.shared else {}))
    if a.command == "index":
        save(workflows.build_index(documents(spark, a.docs, a.kind, a.id, a.text), size=a.size, overlap=a.overlap), a.out)
    elif a.command == "update":
        if not a.to or a.to.rstrip("/") == a.out.rstrip("/"):
            p.error("an update needs --to, a folder other than the index")
        save(workflows.update_index(load(spark, a.out), documents(spark, a.docs, a.kind, a.id, a.text), size=a.size, overlap=a.overlap), a.to)
    else:
        t = load(spark, a.index)
        asked = list(spark.range(1).select(external.hashed_embedding(F.lit(a.query))).first()[0])
        if a.how == "basic":
            units = t["text_units"]
            workflows.basic_search(units, units.select("id", external.hashed_embedding(F.col("text")).alias("embedding")), asked, a.k).select("id", "score", "text").show(truncate=100)
        else:
            vectors = t["entities"].select("id", external.hashed_embedding(F.col("title")).alias("embedding"))
            for name, df in workflows.local_search(t, asked, vectors, a.k).items():
                print(name)
                df.show(truncate=60)


if __name__ == "__main__":
    main()
