"""Whole flows: building an index, updating it, and the four kinds of search."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph, index, retrieval, update
from ..operators.communities import hierarchical_communities
from ..operators.ids import numbered
from ..session import materialize

Tables = dict[str, DataFrame]


def text_units(t: Tables, size: int = 300, overlap: int = 50, **_) -> None:
    t["text_units"] = materialize(index.base_text_units(t["documents"], size, overlap), "units")


def documents(t: Tables, **_) -> None:
    t["final_documents"] = index.final_documents(t["documents"], t["text_units"])


def noun_graph(t: Tables, **_) -> None:
    """Entities and relationships from noun phrases and their co-occurrence in text units."""
    m = t["text_units"].select(F.col("id").alias("text_unit_id"), F.explode(T.noun_phrases(F.col("text"))).alias("title"))
    m = materialize(m.distinct(), "mentions")
    t["entities"] = materialize(graph.noun_nodes(m).select("title", F.lit("NOUN PHRASE").alias("type"), "text_unit_ids", "frequency"), "entities")
    t["relationships"] = materialize(graph.noun_edges(m), "relationships")


def finalize(t: Tables, **_) -> None:
    t["entities"] = materialize(index.finalize_entities(t["entities"], t["relationships"]), "entities")
    t["relationships"] = materialize(index.finalize_relationships(t["relationships"], t["entities"].select("title", "degree")), "relationships")


def communities(t: Tables, max_size: int = 10, period: str = "1970-01-01", **_) -> None:
    t["members"] = materialize(hierarchical_communities(t["relationships"], max_size), "members")
    t["communities"] = index.community_tables(t["members"], t["entities"], t["relationships"], period)


def reports(t: Tables, **_) -> None:
    t["community_reports"] = index.community_reports(t["communities"], t["entities"])


def final_units(t: Tables, **_) -> None:
    t["final_text_units"] = index.final_text_units(t["text_units"], t["entities"], t["relationships"])


WORKFLOWS: dict[str, Callable] = {f.__name__: f for f in (text_units, documents, noun_graph, finalize, communities, final_units, reports)}
FAST = ["text_units", "documents", "noun_graph", "finalize", "communities", "final_units", "reports"]
STANDARD = ["text_units", "documents", "noun_graph"]


def build_index(docs: DataFrame, steps: list[str] | None = None, **options) -> Tables:
    """The index tables of documents(id, text); steps defaults to all of FAST."""
    t: Tables = {"documents": docs}
    for s in steps or FAST:
        WORKFLOWS[s](t, **options)
    return t


def _shape(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns, and descriptions as a list whether df has a list, one description or none."""
    said = F.col("descriptions") if "descriptions" in df.columns else F.array("description") if "description" in df.columns else F.array()
    return df.select(*columns, F.coalesce(said.cast("array<string>"), F.array().cast("array<string>")).alias("descriptions"))


def _numbered_on(merged: DataFrame, old: DataFrame, key: list[str]) -> DataFrame:
    """merged with the old human_readable_id of every old key, and numbers past the greatest for new keys."""
    known = merged.join(old.select(*key, "human_readable_id"), key)
    return update.append_renumbered(known, numbered(merged.join(old.select(*key), key, "left_anti"), key, "human_readable_id"))


def _merged_entities(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    cols = ("id", "title", "type", "text_unit_ids")
    merged, mapping = update.upsert_entities(_shape(old, *cols), _shape(new, *cols))
    place = old.select("title", "x", "y").unionByName(new.select("title", "x", "y").join(old.select("title"), "title", "left_anti"))
    merged = merged.join(place, "title").withColumn("frequency", F.size("text_unit_ids").cast("long"))
    return materialize(_numbered_on(merged, old, ["title"]), "entities"), materialize(mapping, "mapping")


def _merged_relationships(old: DataFrame, new: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(relationships, mapping of their ids, entities with degrees), degrees and pmi over the merged graph."""
    cols = ("id", "source", "target", F.col("weight").cast("double").alias("weight"))
    key = ["source", "target"]
    merged = update.upsert_relationships(_shape(old, *cols), _shape(new, *cols))
    rows = old.select(*key, "text_unit_ids").unionByName(new.select(*key, "text_unit_ids"))
    of = rows.groupBy(*key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("text_unit_ids")))).alias("text_unit_ids"))
    merged = materialize(_numbered_on(merged.join(of, key), old, key), "relationships")
    entities = materialize(entities.join(graph.degree_undirected(merged), "title", "left").fillna({"degree": 0}), "entities")
    both = F.size("text_unit_ids")
    totals = merged.agg(F.sum(both).alias("_w")).crossJoin(entities.agg(F.sum("frequency").alias("_f")))
    ends = [entities.select(F.col("title").alias(c), F.col("frequency").alias(f"_{c}")) for c in key]
    out = graph.combined_degree(merged.drop("combined_degree"), entities).join(ends[0], "source", "left").join(ends[1], "target", "left").crossJoin(F.broadcast(totals))
    out = out.withColumn("pmi", F.log2((both / F.col("_w")) / ((F.col("_source") / F.col("_f")) * (F.col("_target") / F.col("_f"))))).drop("_source", "_target", "_w", "_f")
    mapping = new.select(*key, F.col("id").alias("delta_id")).join(old.select(*key, F.col("id").alias("old_id")), key).select("delta_id", "old_id")
    return materialize(out, "relationships"), materialize(mapping, "mapping"), entities


def update_index(old: Tables, docs: DataFrame, **options) -> Tables:
    """Indexes only documents whose id is new and merges every table of the result into the old ones, so that they can be searched and updated again.

    Entities and relationships of one key merge under the old id and number, with the descriptions and text units of both; degrees,
    frequencies and pmi are those of the merged graph (weights are means, as in upsert_relationships). Text units, documents,
    communities, their members and reports are appended, numbered on, with ids of merged rows replaced by the old ones.
    """
    new, _ = update.delta_documents(docs, old["documents"], "id")
    new = materialize(new, "documents")
    d = build_index(new, **options)
    entities, mapping = _merged_entities(old["entities"], d["entities"])
    relationships, rel_mapping, entities = _merged_relationships(old["relationships"], d["relationships"], entities)
    remapped = lambda df: update.remap_ids(update.remap_ids(df, "entity_ids", mapping), "relationship_ids", rel_mapping)
    from_0 = lambda df: df.withColumn("human_readable_id", F.col("human_readable_id") - 1)

    def appended(name: str, delta: DataFrame) -> DataFrame:
        """Communities numbered on; titles and ids follow the numbers."""
        moved = update.moved_communities(old["communities"], delta)
        if "id" in moved.columns:
            moved = moved.withColumns({"title": F.concat(F.lit("Community "), F.col("community").cast("string")), "id": T.hash_id(F.lit("community"), F.col("level"), F.col("community"))})
        return materialize(old[name].unionByName(moved.select(*old[name].columns)), name)

    return {
        "documents": old["documents"].unionByName(new), "final_documents": materialize(update.append_renumbered(old["final_documents"], from_0(d["final_documents"])), "documents"),
        "entities": entities, "relationships": relationships, "mapping": mapping,
        "text_units": old["text_units"].unionByName(d["text_units"]),
        "final_text_units": materialize(update.append_renumbered(old["final_text_units"], from_0(remapped(d["final_text_units"]))), "units"),
        "members": appended("members", d["members"]), "communities": appended("communities", remapped(d["communities"])), "community_reports": appended("community_reports", d["community_reports"]),
    }


def local_search(t: Tables, query: list[float], vectors: DataFrame, k: int = 10, top_k_relationships: int = 10, max_tokens: int = 1000, community_share: float = 0.25, unit_share: float = 0.5) -> Tables:
    """Contexts of a local search: mapped entities, ranked relationships, text units and reports, each within its share of the tokens.

    vectors(id, embedding) holds entity vectors. The answer itself is a model's work.
    """
    if community_share + unit_share > 1:
        raise ValueError("the shares of communities and text units exceed 1")
    found = retrieval.vector_search(vectors, query, k)
    ents = materialize(t["entities"].join(found, "id").withColumn("ord", -F.col("score")), "found")
    rels = retrieval.ranked_relationships(t["relationships"], ents, top_k_relationships)
    local = int(max_tokens * (1 - community_share - unit_share))
    size = lambda *c: F.greatest(F.size(T.tokens(T.delimited(list(c), " "))), F.lit(1))
    units = retrieval.text_unit_ranking(ents.select("ord", "title", "text_unit_ids"), t["relationships"]).join(t["text_units"].select(F.col("id").alias("text_unit_id"), "text", "n_tokens"), "text_unit_id")
    near = t["members"].join(ents.select("title"), "title").groupBy("community").agg(F.count("*").alias("matches"))
    comm = t["community_reports"].join(near, "community")
    return {
        "entities": retrieval.budget_prefix(ents.select("title", "type", "degree", "ord"), ["ord", "title"], size("title", "type"), local),
        "relationships": retrieval.budget_prefix(rels, ["kind", F.desc("links"), F.desc("combined_degree"), "source", "target"], size("source", "target"), local),
        "text_units": retrieval.budget_prefix(units, ["entity_order", F.desc("relations"), "text_unit_id"], F.greatest("n_tokens", F.lit(1)), int(max_tokens * unit_share)),
        "reports": retrieval.budget_prefix(comm, [F.desc("matches"), F.desc("rank"), "community"], size("full_content"), int(max_tokens * community_share)),
    }


def basic_search(units: DataFrame, vectors: DataFrame, query: list[float], k: int = 5) -> DataFrame:
    return units.join(retrieval.vector_search(vectors, query, k), "id").orderBy(F.desc("score"), "id")


def global_search(t: Tables, answer: Callable[[F.Column], F.Column], budget: int = 500, batch: int = 1000, level: int | None = None) -> DataFrame:
    """Reports in batches -> `answer` (a Column function giving JSON points) -> positive points, best first, within the budget."""
    reports = t["community_reports"] if level is None else t["community_reports"].filter(F.col("level") <= level)
    sized = reports.select("community", "full_content", "rank", F.size(T.tokens(F.col("full_content"))).alias("n"))
    b = retrieval.report_batches(sized, ["community"], "n", batch)
    texts = b.groupBy("batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("community", "full_content"))), lambda x: x["full_content"]), "\n").alias("text"))
    return retrieval.key_points(texts.select(F.col("batch").alias("analyst"), answer(F.col("text")).alias("response")), budget)


def batch_contexts(t: Tables, vectors: DataFrame, queries: DataFrame, k: int = 10, top_k_relationships: int = 10, max_tokens: int = 8000) -> tuple[DataFrame, DataFrame]:
    """(entities, relationships) of the local contexts of a whole table of queries(qid, q), in one job: the k nearest entities of each by vectors(id, v), grown while they fit."""
    near = retrieval.batch_vector_search(queries, vectors, k).join(t["entities"].select("id", "title"), "id").withColumn("ord", F.col("rank"))
    size = lambda *c: F.greatest(F.size(T.tokens(T.delimited(list(c), " "))), F.lit(1))
    return retrieval.grown_contexts(near, t["relationships"], size("title"), size("source", "target"), max_tokens, top_k_relationships)


def multi_index_tables(indexes: dict[str, Tables]) -> Tables:
    """Several indexes as one to search: titles, ids and communities carry the index's name or are numbered on, so nothing of different indexes meets."""
    out: dict[str, list[DataFrame]] = {}
    start = 0
    for name in sorted(indexes):
        t, end = indexes[name], f"-{name}"
        mark = lambda c: F.concat(F.col(c).cast("string"), F.lit(end))  # noqa: B023, E731
        marks = lambda c: F.transform(F.col(c), lambda x: F.concat(x, F.lit(end)))  # noqa: B023, E731
        move = lambda c: F.when(F.col(c) == -1, -1).otherwise(F.col(c) + start).alias(c)  # noqa: B023, E731
        parts = {
            "entities": t["entities"].select(mark("id").alias("id"), mark("title").alias("title"), "type", "degree", marks("text_unit_ids").alias("text_unit_ids")),
            "relationships": t["relationships"].select(mark("id").alias("id"), mark("source").alias("source"), mark("target").alias("target"), "combined_degree", marks("text_unit_ids").alias("text_unit_ids")),
            "text_units": t["text_units"].select(mark("id").alias("id"), "text", "n_tokens"),
            "members": t["members"].select("level", move("community"), move("parent"), mark("title").alias("title")),
            "community_reports": t["community_reports"].select(move("community"), "level", move("parent"), "full_content", "rank"),
        }
        for n, df in parts.items():
            out.setdefault(n, []).append(df.withColumn("index_name", F.lit(name)))
        start += (t["members"].agg(F.max("community")).first()[0] or 0) + 1
    return {n: functools.reduce(lambda a, b: a.unionByName(b), dfs) for n, dfs in out.items()}


def report_levels(members: DataFrame) -> list[int]:
    """Levels in the order in which reports are made: the deepest first."""
    return [r.level for r in members.select("level").distinct().orderBy(F.desc("level")).collect()]


class QueryState:
    """The actions of a drift search as a graph: questions with answers, scores and follow-ups; driver state of a few dozen rows."""

    def __init__(self):
        self.actions: list[dict] = []
        self.at: dict[str, int] = {}

    def add(self, question: str, vector: list[float] | None = None, parent: str | None = None, **more) -> bool:
        """False if the question is known already; it is then only linked."""
        new = question not in self.at
        if new:
            self.at[question] = len(self.actions)
            self.actions.append({"id": len(self.actions), "question": question, "vector": vector, "answer": None, "score": None, "parents": []} | more)
        if parent is not None and self.at[parent] not in self.actions[self.at[question]]["parents"]:
            self.actions[self.at[question]]["parents"].append(self.at[parent])
        return new

    def answer(self, question: str, answer, score: float | None) -> None:
        self.actions[self.at[question]] |= {"answer": answer, "score": score}

    def incomplete(self) -> list[dict]:
        """Open actions, those of the greatest scores first, others in order of their arrival."""
        open_ = [a for a in self.actions if a["answer"] is None]
        return sorted(open_, key=lambda a: (-(a["score"] if a["score"] is not None else float("-inf")), a["id"]))

    def tables(self, spark) -> tuple[DataFrame, DataFrame]:
        """(nodes: id, question, score, done; edges: source, target) of the state."""
        nodes = [(a["id"], a["question"], a["score"], a["answer"] is not None) for a in self.actions]
        edges = [(p, a["id"]) for a in self.actions for p in a["parents"]]
        return spark.createDataFrame(nodes, "id int, question string, score double, done boolean"), spark.createDataFrame(edges, "source int, target int")


Follow = Callable[[str, Tables], tuple[object, float | None, list[tuple[str, list[float]]]]]


def drift_search(t: Tables, vectors: DataFrame, question: str, query: list[float], follow: Follow, primer: Callable[[DataFrame], DataFrame] | None = None, report_vectors: DataFrame | None = None, depth: int = 3, follow_ups: int = 5, k: int = 5, folds: int = 5, **options) -> QueryState:
    """A question is answered by local searches for it and for its follow-ups: at most `follow_ups` open actions, the best scored first, are searched in each of `depth` rounds.

    follow(question, contexts) gives an answer, its score and new questions with their vectors; a question asked before isn't searched again, so the
    work is bounded by depth x follow_ups searches. With primer and report_vectors(community, embedding), the nearest reports are divided into folds and
    primer(folds) gives a row a fold (fold, answer, follow_ups array<struct<question,vector>>, score), whose merged follow-ups open the search.
    """
    state = QueryState()
    state.add(question, query)
    if primer is not None and report_vectors is not None:
        first = retrieval.merged_primer(primer(retrieval.primer_folds(t["community_reports"], report_vectors, query, k * folds, folds))).first()
        state.answer(question, first.answer, first.score)
        for f in first.follow_ups:
            state.add(f.question, list(f.vector), question)
    for _ in range(depth):
        todo = state.incomplete()[:follow_ups]
        if not todo:
            break
        for a in todo:
            answer, score, more = follow(a["question"], local_search(t, a["vector"], vectors, k, **options))
            state.answer(a["question"], answer, score)
            for q, v in more:
                state.add(q, v, a["question"])
    return state
