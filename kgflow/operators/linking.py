"""Entity linking against a concept vocabulary, and lookups by membership."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import small


def vocabulary_relations(relations: DataFrame, concepts: DataFrame, sources: list[str]) -> DataFrame:
    """relations(CUI1, AUI1, CUI2, AUI2, RELA, SAB) from given sources, not from a concept to itself, whose CUI2 is among concepts(CUI)."""
    kept = relations.filter((F.col("CUI1") != F.col("CUI2")) & F.col("SAB").isin(*sources))
    return kept.join(concepts.select(F.col("CUI").alias("CUI2")).distinct(), "CUI2", "left_semi")


def named_relations(relations: DataFrame, names: DataFrame) -> DataFrame:
    """relations with name1, name2: the atom's name if known, else the concept's (its least); rows without either are dropped.

    text is 'name2 | rela | name1'. names: CUI, AUI, NAME.
    """
    atoms = names.filter("AUI IS NOT NULL").groupBy("AUI").agg(F.min("NAME").alias("_a"))
    cuis = names.filter("CUI IS NOT NULL").groupBy("CUI").agg(F.min("NAME").alias("_c"))
    out = relations
    for n in ("1", "2"):
        out = out.join(atoms.withColumnRenamed("AUI", f"AUI{n}"), f"AUI{n}", "left").join(cuis.withColumnRenamed("CUI", f"CUI{n}"), f"CUI{n}", "left")
        out = out.withColumn(f"name{n}", F.coalesce("_a", "_c")).drop("_a", "_c")
    out = out.filter("name1 IS NOT NULL AND name2 IS NOT NULL")
    return out.withColumn("text", T.format_relation(F.col("name2"), F.col("RELA"), F.col("name1")))


def candidate_relations(heads: DataFrame, mapping: DataFrame, relations: DataFrame) -> DataFrame:
    """head and its candidate relations, each once: heads(head) -> mapping(head, cui) -> relations(CUI2 = cui)."""
    return heads.select("head").distinct().join(mapping, "head").join(relations, F.col("cui") == F.col("CUI2")).dropDuplicates(["head", "CUI1", "RELA", "CUI2"]).drop("cui")


def passing_matches(df: DataFrame, similarity: float = 0.85, jaccard: float = 0.5, cosine: float = 0.7) -> DataFrame:
    """Matches strictly above all three thresholds."""
    return df.filter((F.col("similarity") > similarity) & (F.col("jaccard") > jaccard) & (F.col("cosine") > cosine))


def with_relation_ids(df: DataFrame, ids: DataFrame, relation: str = "relation_type") -> DataFrame:
    """Rows with the id of their relation; rows with unknown relations are dropped. The map is broadcast if it is small."""
    return df.join(small(ids.select(F.col("relation_type").alias(relation), "relation_id")), relation)


def entity_by_id(entities: DataFrame, wanted: str) -> DataFrame:
    """Entities whose id equals the wanted one, dashes ignored on either side."""
    bare = lambda c: F.regexp_replace(c, "-", "")
    return entities.filter(bare(F.col("id")) == bare(F.lit(wanted)))


def entities_where(entities: DataFrame, column: str, values: list) -> DataFrame:
    return entities.filter(F.col(column).isin(*values))


def neighbours_by_rank(entities: DataFrame, edges: DataFrame, title: str, k: int, exclude: list[str] = []) -> DataFrame:
    """The k neighbours of an entity with the greatest rank (ties by title), the entity and excluded ones aside."""
    n = edges.filter(F.col("source") == title).select(F.col("target").alias("title")).unionByName(edges.filter(F.col("target") == title).select(F.col("source").alias("title")))
    n = n.filter((F.col("title") != title) & ~F.col("title").isin(*exclude) if exclude else F.col("title") != title).distinct()
    return entities.join(n, "title", "left_semi").orderBy(F.desc("rank"), "title").limit(k)


def members_of(candidates: DataFrame, selected: DataFrame, key: str) -> DataFrame:
    """Candidates with in_context: whether their key is among the selected."""
    s = selected.select(key).distinct().withColumn("_s", F.lit(True))
    return candidates.join(s, key, "left").withColumn("in_context", F.col("_s").isNotNull()).drop("_s")


def resolved(claims: DataFrame, names: DataFrame) -> DataFrame:
    """Claims with subject and object ids replaced where names(name, entity) knows them."""
    for c in ("subject_id", "object_id"):
        claims = claims.join(names.select(F.col("name").alias(c), F.col("entity").alias("_e")), c, "left").withColumn(c, F.coalesce("_e", c)).drop("_e")
    return claims


def positional(left: DataFrame, right: DataFrame, number: str, check: str) -> DataFrame:
    """Rows of two tables with the same persisted number, with `same`: whether the checked column is equal (NULL equals NULL)."""
    r = right.select(number, F.col(check).alias("_c"), *[F.col(c).alias(f"right_{c}") for c in right.columns if c not in (number, check)])
    return left.join(r, number).withColumn("same", F.col(check).eqNullSafe(F.col("_c"))).drop("_c")


def relations_of_head(triples: DataFrame, order: str) -> DataFrame:
    """head -> relations in order of first appearance, each once."""
    first = triples.groupBy("head", "relation_type").agg(F.min(order).alias("_o"))
    return first.groupBy("head").agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "relation_type"))), lambda x: x["relation_type"]).alias("relations"))


def pair_relations(triples: DataFrame) -> DataFrame:
    """head, tail -> their distinct relations, sorted and joined by commas."""
    return triples.groupBy("head", "tail").agg(F.array_join(F.array_sort(F.collect_set("relation_type")), ", ").alias("description"))


def last_writer(parts: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """One value per key, the one written last."""
    return parts.groupBy(key).agg(F.max_by(value, order).alias(value))


def scenario(seed: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """Triples of a scenario: seed, new (found but not in seed) or combined (both, each once)."""
    key = ["head", "relation_type", "tail"]
    a, b = seed.select(*key).distinct(), found.select(*key).distinct()
    return {"seed": a, "new": b.join(a, key, "left_anti"), "combined": a.unionByName(b).distinct()}[how]


def override_relationships(found: DataFrame, manual: DataFrame, manual_titles: DataFrame) -> DataFrame:
    """Relationships with those lying wholly inside the manual titles replaced by the manual ones."""
    t = manual_titles.select("title").distinct().withColumn("_y", F.lit(True))
    e = found.join(t.select(F.col("title").alias("source"), F.col("_y").alias("_s")), "source", "left").join(t.select(F.col("title").alias("target"), F.col("_y").alias("_t")), "target", "left")
    return e.filter("_s IS NULL OR _t IS NULL").drop("_s", "_t").select(*found.columns).unionByName(manual.select(*found.columns))


def ranking_overlap(a: DataFrame, b: DataFrame, key: str, order_a: list, order_b: list, k: int) -> DataFrame:
    """How many of the first k of one ranking aren't among the first k of the other."""
    x, y = a.orderBy(*order_a).limit(k).select(key), b.orderBy(*order_b).limit(k).select(key)
    return x.join(y, key, "left_anti").agg(F.count("*").alias("only_first"))


def first_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with first_edge: their first edge (by id) as source, else as target."""
    s = edges.groupBy(F.col("source").alias("title")).agg(F.min("id").alias("_s"))
    t = edges.groupBy(F.col("target").alias("title")).agg(F.min("id").alias("_t"))
    return nodes.join(s, "title", "left").join(t, "title", "left").withColumn("first_edge", F.coalesce("_s", "_t")).drop("_s", "_t")


def unit_context(units: DataFrame, members: DataFrame, entities: DataFrame, budget: int) -> DataFrame:
    """community, text_unit_id, degree, used: a community's text units by the summed degree of its entities in them, within a token budget."""
    e = members.select("community", "title").distinct().join(entities.select("title", "degree", F.explode("text_unit_ids").alias("text_unit_id")), "title")
    d = e.groupBy("community", "text_unit_id").agg(F.sum("degree").alias("degree")).join(units.select(F.col("id").alias("text_unit_id"), "n_tokens"), "text_unit_id")
    w = Window.partitionBy("community").orderBy(F.desc("degree"), "text_unit_id").rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("used", F.sum("n_tokens").over(w)).filter(F.col("used") <= budget).select("community", "text_unit_id", "degree", "used")


def mixed_context(children: DataFrame, budget: int) -> DataFrame:
    """community, child, use ('report' or 'context'): the largest children give way to their reports until the parent's context fits.

    children: community, child, context_size, report_size. Children are taken by falling context_size (ties by child); a child is
    replaced as long as what is left of contexts and the reports so far exceed the budget.
    """
    order = Window.partitionBy("community").orderBy(F.desc("context_size"), "child")
    before = F.coalesce(F.sum(F.col("context_size") - F.col("report_size")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    every = Window.partitionBy("community")
    left = F.sum("context_size").over(every) - before
    return children.withColumn("use", F.when(left > budget, "report").otherwise("context")).select("community", "child", "use")


def assigned_communities(entities: DataFrame, members: DataFrame, level: int) -> DataFrame:
    """Entities with their communities up to a level (a sorted array); an entity in none keeps an empty one; community -1 counts as none."""
    m = members.filter((F.col("level") <= level) & (F.col("community") != -1)).groupBy("title").agg(F.array_sort(F.collect_set("community")).alias("communities"))
    return entities.join(m, "title", "left").withColumn("communities", F.coalesce("communities", F.array().cast("array<bigint>")))


def ranked_reports(reports: DataFrame, level: int, min_rank: float = 0.0) -> DataFrame:
    """Reports of communities up to a level with at least a rank; a NULL rank doesn't pass."""
    return reports.filter((F.col("level") <= level) & F.col("rank").isNotNull() & (F.col("rank") >= min_rank))


def offset_indexes(parts: dict[str, DataFrame], column: str) -> DataFrame:
    """Union of several indexes with `column` renumbered past the ones before (in the order of their names), -1 kept, and the origin as index_name, original."""
    out, start = None, None
    for name in sorted(parts):
        df = parts[name].withColumn("index_name", F.lit(name)).withColumn("original", F.col(column))
        df = df.crossJoin(F.broadcast(start)).withColumn(column, F.when(F.col(column) == -1, -1).otherwise(F.col(column) + F.col("_o"))).drop("_o") if start is not None else df
        out = df if out is None else out.unionByName(df)
        start = out.agg((F.max(column) + 1).alias("_o"))
    return out


def composed(left: DataFrame, right: DataFrame, key: list[str], attributes: list[str]) -> DataFrame:
    """Union of two node or edge tables by key; where both hold a key, the right side's attributes win, also as NULL."""
    r = right.select(*key, *[F.col(a).alias(f"_{a}") for a in attributes], F.lit(True).alias("_there"))
    return left.select(*key, *attributes).join(r, key, "full").select(*key, *[F.when(F.col("_there"), F.col(f"_{a}")).otherwise(F.col(a)).alias(a) for a in attributes])


def rolled_up(reports: DataFrame, members: DataFrame, level: int) -> DataFrame:
    """Reports of the deepest community, up to a level, that each title lies in: the reports that together cover all titles once."""
    deepest = members.filter(F.col("level") <= level).groupBy("title").agg(F.max(F.struct("level", "community")).alias("m")).select("m.community").distinct()
    return reports.join(deepest, "community", "left_semi")


def community_children(communities: DataFrame) -> DataFrame:
    """community, children (sorted; empty for a leaf) of communities(community, parent)."""
    kids = communities.filter("parent <> -1").groupBy(F.col("parent").alias("community")).agg(F.array_sort(F.collect_set("community")).alias("children"))
    return communities.select("community").distinct().join(kids, "community", "left").withColumn("children", F.coalesce("children", F.array().cast("array<bigint>")))


def candidate_rows(selected: DataFrame, relationships: DataFrame, covariates: DataFrame, units: DataFrame, members: DataFrame) -> dict[str, DataFrame]:
    """Everything that touches selected(title, text_unit_ids): relationships of either end, covariates by subject, text units, communities."""
    s = selected.select("title").distinct()
    ends = [relationships.join(s.withColumnRenamed("title", c), c, "left_semi") for c in ("source", "target")]
    ids = selected.select(F.explode("text_unit_ids").alias("id")).distinct()
    return {
        "relationships": ends[0].unionByName(ends[1].join(s.withColumnRenamed("title", "source"), "source", "left_anti").select(*ends[0].columns)),
        "covariates": covariates.join(s.withColumnRenamed("title", "subject_id"), "subject_id", "left_semi"),
        "text_units": units.join(ids, "id", "left_semi"),
        "communities": members.join(s, "title", "left_semi").select("level", "community").distinct(),
    }


def linked_context(context: DataFrame, table: DataFrame, keep: list[str]) -> DataFrame:
    """Context rows (short ids of a prompt) with the ids of the index rows they stand for: context(id, ..) over table(human_readable_id, ..)."""
    link = table.select(F.col("human_readable_id").alias("id"), *[F.col(c).alias(f"index_{c}") for c in keep])
    return context.join(link, "id", "left")
