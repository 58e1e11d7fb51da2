"""Vectors of graph nodes from random walks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .ids import numbered


def random_walks(edges: DataFrame, walks: int = 10, length: int = 40, seed: int = 86) -> DataFrame:
    """title, walk, path: `walks` walks of `length` titles from every end of an undirected edge, each step to a neighbour drawn by a hash of seed, walk and step.

    Neighbours are numbered through the whole table, so a step is two joins on single keys: a hub's neighbours are never gathered or multiplied.
    Self loops and NULL ends are left out.
    """
    e = edges.filter("source IS NOT NULL AND target IS NOT NULL AND source <> target").select("source", "target")
    both = e.unionAll(e.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()
    to = materialize(numbered(both, ["source", "target"], "nr"), "neighbours")
    nodes = materialize(to.groupBy(F.col("source").alias("at")).agg(F.min("nr").alias("first"), F.count("*").alias("degree")), "nodes")
    out = nodes.select(F.col("at").alias("title"), F.explode(F.sequence(F.lit(0), F.lit(walks - 1))).alias("walk"), "at", F.array("at").alias("path"))
    for step in range(1, length):
        drawn = F.pmod(F.xxhash64(F.lit(seed), "title", "walk", F.lit(step)), F.col("degree"))
        out = out.join(nodes, "at").withColumn("nr", F.col("first") + drawn).drop("at", "first", "degree").join(to.select("nr", F.col("target").alias("at")), "nr")
        out = out.select("title", "walk", "at", F.concat("path", F.array("at")).alias("path"))
        if step % 4 == 0:
            out = materialize(out, "walks")
    return out.select("title", "walk", "path")


def node_vectors(edges: DataFrame, size: int = 64, window: int = 2, rounds: int = 3, walks: int = 10, length: int = 40, seed: int = 86) -> DataFrame:
    """title, vector: skip-gram vectors of the nodes of a graph, trained on its random walks by Spark's own Word2Vec.

    The model (nodes x size floats) is held by the driver while it is trained, which bounds the number of nodes to some tens of millions.
    """
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    paths = random_walks(edges, walks, length, seed)
    model = Word2Vec(vectorSize=size, windowSize=window, maxIter=rounds, minCount=0, seed=seed, inputCol="path", outputCol="vector").fit(paths)
    return model.getVectors().select(F.col("word").alias("title"), vector_to_array("vector").alias("vector"))
