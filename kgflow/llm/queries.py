"""The registered queries of this folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, table
from . import consensus, copies, languages, leakage, neighbours, overlap, packing, sentences, terms


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.found_pairs(*overlap.split_overlaps(table(spark, d, "text_chunks")))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "text_chunks")
    return overlap.coverage_report(chunks, *overlap.split_overlaps(chunks))


def p1_records(spark: SparkSession, d: str) -> DataFrame:
    """How much of every record occurs in the other splits."""
    chunks = table(spark, d, "text_chunks")
    return overlap.record_coverage(chunks, *overlap.split_overlaps(chunks)).filter("share IS NOT NULL").withColumn("share", F.round("share", 6))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    items, _ = consensus.competence_mixture(consensus.votes_of(table(spark, d, "validated_ch3"), table(spark, d, "verdict_votes")))
    return items.filter("n_annotators >= 3").select(F.col("item").alias("triple_id"), F.col("label").alias("verdict"))


def p2_items(spark: SparkSession, d: str) -> DataFrame:
    items, _ = consensus.competence_mixture(consensus.votes_of(table(spark, d, "validated_ch3"), table(spark, d, "verdict_votes")))
    return items.withColumnRenamed("item", "triple_id")


def p2_annotators(spark: SparkSession, d: str) -> DataFrame:
    _, who = consensus.competence_mixture(consensus.votes_of(table(spark, d, "validated_ch3"), table(spark, d, "verdict_votes")))
    return who


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    near = neighbours.most_similar(table(spark, d, "relation_embeddings")).filter("similarity >= 0.8")
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.most_similar(table(spark, d, "relation_embeddings"), cell=800, visits=6)


def p3_search(spark: SparkSession, d: str) -> DataFrame:
    """Every vector whose id is divisible by 50 as a query, by greedy search of the graph of all vectors."""
    rows = neighbours.valid(table(spark, d, "relation_embeddings"), "id", "embedding", 96)
    graph = neighbours.neighbour_graph(rows, 6, 0.6)
    queries = rows.filter("id % 50 = 0").select(F.col("id").alias("query"), F.col("v").alias("q"))
    return neighbours.graph_search(queries, rows, graph, pivots=neighbours.pivots_of(rows, rows.count())).select("query", "id", "rank", (F.col("sim") / neighbours.UNIT).alias("similarity"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    found = copies.triple_copies(table(spark, d, "seed_kg_ch2"), table(spark, d, "relation_map"))
    return found.filter("row_id <> kept").select(F.col("kept").alias("kept_row_id"), "row_id")


def p4_records(spark: SparkSession, d: str) -> DataFrame:
    found = copies.triple_copies(table(spark, d, "seed_kg_ch2"), table(spark, d, "relation_map"))
    return found.filter("row_id = kept").select("row_id", "n_copies")


def _prose(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("doc_kind IS NULL OR doc_kind <> 'dump'")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    docs = languages.document_languages(_prose(spark, d)).filter("is_case")
    return docs.select("doc_id", F.explode("languages").alias("lang")).filter(F.col("lang") != languages.OTHER)


def p5_documents(spark: SparkSession, d: str) -> DataFrame:
    return languages.document_languages(_prose(spark, d))


def p5_stretches(spark: SparkSession, d: str) -> DataFrame:
    return languages.language_stretches(_prose(spark, d))


def _terms(spark: SparkSession, d: str) -> DataFrame:
    seed = terms.term_frequencies(table(spark, d, "seed_kg_ch2"), "row_id", "relation_type")
    tails = terms.term_frequencies(table(spark, d, "injections_ch5"), "id", "tail")
    named = [x.withColumn("field_name", F.lit(n)) for x, n in ((seed, "seed_kg_ch2.relation_type"), (tails, "injections_ch5.tail"))]
    return named[0].unionByName(named[1])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).filter("mark IS NOT NULL").select("field_name", "term", "mark")


def p6_terms(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).select("field_name", "term", "occurrences", "records", "mark")


def p7_sequences(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(packing.token_counts(table(spark, d, "documents")), 2048)


def p7_validity(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of p7_sequences: no sequence over full, no document lost, changed or divided without need, hardly more sequences than needed."""
    sizes = materialize(packing.token_counts(table(spark, d, "documents")), "sizes")
    return packing.packing_checks(packing.pack(sizes, 2048), sizes, 2048)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("item_id", "doc_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(_prose(spark, d)).select("doc_id", "start_at")


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Which test items leaked, into how many documents, and the greatest share held."""
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.round(F.max("held"), 6).alias("held"))


def p9_sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(_prose(spark, d))


QUERIES = {name: f for name, f in sorted(globals().items()) if name[0] == "p" and name[1:2].isdigit()}
