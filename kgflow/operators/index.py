"""Index tables: documents, text units, entities, relationships, covariates, communities, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as T
from .graph import combined_degree, degree_undirected
from .ids import numbered


def token_chunks(docs: DataFrame, size: int, overlap: int, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """document_id, chunk_no, start, text, n_tokens: windows of white-space tokens; starts lie size - overlap apart, so the last may be overlap only."""
    w = docs.select(F.col(id_col).alias("document_id"), F.posexplode(A.windows(T.tokens(F.col(text_col)), size, overlap)).alias("chunk_no", "w"))
    return w.select("document_id", "chunk_no", F.col("w.start").alias("start"), F.array_join("w.items", " ").alias("text"), F.size("w.items").alias("n_tokens"))


def word_windows(docs: DataFrame, size: int = 500, overlap: int = 50, least: int = 20, id_col: str = "id", text_col: str = "text") -> DataFrame:
    return token_chunks(docs, size, overlap, id_col, text_col).filter(F.col("n_tokens") >= least)


def packed_chunks(docs: DataFrame, size: int, order: list[str], text_col: str = "text", cls: str = "[CLS]", sep: str = "[SEP]") -> DataFrame:
    """chunk_no, tokens: all texts in order, concatenated and cut to size - 2 tokens between cls and sep; a rest is dropped unless it's all there is.

    Offsets come from numbered rows and counts per partition; chunks are grouped by number, so no task sees more than its chunks.
    """
    inner = size - 2
    rows = numbered(docs.select(*order, T.tokens(F.col(text_col)).alias("_t")).filter(F.size("_t") > 0), order, "_nr")
    block = rows.withColumn("_b", F.floor(F.col("_nr") / 1000))
    sums = block.groupBy("_b").agg(F.sum(F.size("_t")).alias("_s")).withColumn("_before", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = F.coalesce(F.sum(F.size("_t")).over(Window.partitionBy("_b").orderBy("_nr").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tok = block.withColumn("_at", at).join(sums.select("_b", "_before"), "_b").select((F.col("_before") + F.col("_at")).alias("_o"), F.posexplode("_t").alias("_i", "token"))
    tok = tok.select((F.col("_o") + F.col("_i")).alias("pos"), "token")
    total = tok.count()
    out = tok.groupBy(F.floor(F.col("pos") / inner).alias("chunk_no")).agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("x"))
    out = out.select("chunk_no", F.concat(F.array(F.lit(cls)), F.transform("x", lambda v: v["token"]), F.array(F.lit(sep))).alias("tokens"))
    return out if total < inner else out.filter(F.size("tokens") == size)


def base_text_units(docs: DataFrame, size: int, overlap: int, id_col: str = "id", text_col: str = "text") -> DataFrame:
    c = token_chunks(docs, size, overlap, id_col, text_col)
    return c.select(T.hash_id(F.col("document_id"), F.col("chunk_no"), F.col("text")).alias("id"), "text", F.array("document_id").alias("document_ids"), "n_tokens")


def final_documents(docs: DataFrame, units: DataFrame) -> DataFrame:
    """Documents with their text unit ids; documents without units stay, with an empty list. human_readable_id counts from 1."""
    of = units.select(F.explode("document_ids").alias("id"), F.col("id").alias("unit")).groupBy("id").agg(F.array_sort(F.collect_set("unit")).alias("text_unit_ids"))
    out = docs.join(of, "id", "left").withColumn("text_unit_ids", F.coalesce("text_unit_ids", F.array().cast("array<string>")))
    return numbered(out, ["id"], "human_readable_id", 1)


def ids_per_unit(df: DataFrame, name: str) -> DataFrame:
    """id (a text unit) with the distinct ids of the rows whose text_unit_ids hold it, sorted."""
    rows = df.select(F.col("id").alias("_x"), F.explode("text_unit_ids").alias("_u"))
    return rows.groupBy(F.col("_u").alias("id")).agg(F.array_sort(F.collect_set("_x")).alias(name))


def final_text_units(units: DataFrame, entities: DataFrame, relationships: DataFrame, covariates: DataFrame | None = None) -> DataFrame:
    out = units.join(ids_per_unit(entities, "entity_ids"), "id", "left").join(ids_per_unit(relationships, "relationship_ids"), "id", "left")
    if covariates is not None:
        of = covariates.groupBy("text_unit_id").agg(F.array_sort(F.collect_set("id")).alias("covariate_ids")).withColumnRenamed("text_unit_id", "id")
        out = out.join(of, "id", "left")
    return numbered(out, ["id"], "human_readable_id", 1)


def merge_entities(rows: DataFrame) -> DataFrame:
    """title, type -> descriptions (in order of ord) and text_unit_ids; NULL keys are dropped."""
    return rows.filter("title IS NOT NULL AND type IS NOT NULL").groupBy("title", "type").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "description"))), lambda x: x["description"]).alias("descriptions"),
        F.array_sort(F.collect_set("text_unit_id")).alias("text_unit_ids"),
    )


def merge_relationships(rows: DataFrame) -> DataFrame:
    """source, target -> descriptions, text_unit_ids, sum of weights; directed pairs."""
    return rows.filter("source IS NOT NULL AND target IS NOT NULL").groupBy("source", "target").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "description"))), lambda x: x["description"]).alias("descriptions"),
        F.array_sort(F.collect_set("text_unit_id")).alias("text_unit_ids"),
        F.sum("weight").alias("weight"),
    )


def parse_extractions(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entity rows, relationship rows) from responses(text_unit_id, response): records ("entity", name, type, description) and ("relationship", source, target, description, weight)."""
    r = responses.select("text_unit_id", F.posexplode(T.records(F.col("response"))).alias("no", "f"))
    kind = F.regexp_replace(F.try_element_at("f", F.lit(1)), '"', "")
    at = lambda i: F.regexp_replace(F.try_element_at("f", F.lit(i)), '^"|"$', "")
    ord_ = F.struct("text_unit_id", "no").alias("ord")
    ents = r.filter((kind == "entity") & (F.size("f") >= 4)).select("text_unit_id", ord_, F.upper(at(2)).alias("title"), F.upper(at(3)).alias("type"), at(4).alias("description"))
    weight = F.coalesce(F.expr("try_cast(element_at(f, -1) as double)"), F.lit(1.0))
    rels = r.filter((kind == "relationship") & (F.size("f") >= 5)).select("text_unit_id", ord_, F.upper(at(2)).alias("source"), F.upper(at(3)).alias("target"), at(4).alias("description"), weight.alias("weight"))
    return ents, rels


def parse_claims(responses: DataFrame) -> DataFrame:
    """Claims of eight fields each; missing ones are NULL."""
    names = ("subject_id", "object_id", "type", "status", "start_date", "end_date", "description", "source_text")
    r = responses.select("text_unit_id", F.posexplode(T.records(F.col("response"))).alias("no", "f"))
    return r.select("text_unit_id", "no", *[F.try_element_at("f", F.lit(i + 1)).alias(n) for i, n in enumerate(names)])


def clean_entities(df: DataFrame, types: list[str]) -> DataFrame:
    return df.filter(F.col("type").isin(*types) & (F.length("description") > 0) & (F.col("title") != ""))


def clean_relationships(df: DataFrame, relations: list[str]) -> DataFrame:
    """Descriptions cut to known relations (comma list, sorted); rows with none, or from a node to itself, are dropped."""
    parts = F.transform(F.split(F.array_join("descriptions", ","), ","), T.strip)
    kept = F.array_sort(F.array_distinct(F.array_intersect(parts, F.array(*[F.lit(x) for x in relations]))))
    return df.withColumn("description", F.array_join(kept, ", ")).filter("description <> '' AND source <> target").drop("descriptions")


def summarize_descriptions(c: str = "descriptions", limit: int = 4000):
    """The stand-in for a summary: nothing -> '', one -> itself, several -> sorted distinct ones joined by newlines, cut to limit characters."""
    d = F.array_sort(F.array_distinct(F.filter(c, lambda x: x.isNotNull() & (x != ""))))
    return F.when(F.size(d) == 0, "").otherwise(F.substring(F.array_join(d, "\n"), 1, limit))


def finalize_entities(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """Entities, one per title, with degree, zero layout, id and human_readable_id from 0."""
    d = degree_undirected(relationships)
    one = entities.withColumn("_n", F.row_number().over(Window.partitionBy("title").orderBy("type"))).filter("_n = 1").drop("_n")
    out = one.join(d, "title", "left").withColumns({"degree": F.coalesce("degree", F.lit(0)), "x": F.lit(0.0), "y": F.lit(0.0), "id": T.hash_id(F.lit("entity"), F.col("title"))})
    return numbered(out, ["title"], "human_readable_id")


def finalize_relationships(relationships: DataFrame, degrees: DataFrame) -> DataFrame:
    one = relationships.withColumn("_n", F.row_number().over(Window.partitionBy("source", "target").orderBy(F.desc("weight")))).filter("_n = 1").drop("_n")
    out = combined_degree(one, degrees).withColumn("id", T.hash_id(F.lit("relationship"), F.col("source"), F.col("target")))
    return numbered(out, ["source", "target"], "human_readable_id")


def community_tables(members: DataFrame, entities: DataFrame, relationships: DataFrame, period: str) -> DataFrame:
    """One row per community of members(level, community, parent, title): entity_ids, relationship_ids (both ends inside), text_unit_ids, size, period."""
    ents = members.join(entities.select("title", F.col("id").alias("entity_id")), "title").groupBy("level", "community", "parent").agg(F.array_sort(F.collect_set("entity_id")).alias("entity_ids"))
    a = members.select("level", "community", F.col("title").alias("source"))
    b = members.select("level", "community", F.col("title").alias("target"))
    inside = relationships.select("source", "target", F.col("id").alias("rid"), "text_unit_ids").join(a, "source").join(b, ["level", "community", "target"])
    rels = inside.groupBy("level", "community").agg(F.array_sort(F.collect_set("rid")).alias("relationship_ids"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("text_unit_ids")))).alias("text_unit_ids"))
    none = F.array().cast("array<string>")
    out = ents.join(rels, ["level", "community"], "left").withColumns({"relationship_ids": F.coalesce("relationship_ids", none), "text_unit_ids": F.coalesce("text_unit_ids", none)})
    return out.withColumns({"title": F.concat(F.lit("Community "), F.col("community").cast("string")), "size": F.size("entity_ids"), "period": F.lit(period), "id": T.hash_id(F.lit("community"), F.col("level"), F.col("community"))})


def community_reports(communities: DataFrame, entities: DataFrame, report=None) -> DataFrame:
    """Reports joined with their community's attributes. `report` maps a struct of titles to text; the stand-in lists the titles."""
    titles = communities.select("level", "community", F.explode("entity_ids").alias("id")).join(entities.select("id", F.col("title").alias("name")), "id")
    body = titles.groupBy("level", "community").agg(F.array_sort(F.collect_set("name")).alias("names"))
    text = report(F.col("names")) if report else F.array_join("names", ", ")
    out = communities.join(body, ["level", "community"])
    return out.select("id", "community", "level", "parent", "title", text.alias("full_content"), F.element_at("names", 1).alias("summary"), F.col("size").cast("double").alias("rank"), "period", "size")


def override(found: DataFrame, manual: DataFrame) -> DataFrame:
    """Entities with type and description replaced where the manual table has the title, and the manual titles that are new."""
    m = manual.select("title", F.col("type").alias("_t"), F.col("description").alias("_d"))
    return found.select("title", "type", "description").join(m, "title", "full").select("title", F.coalesce("_t", "type").alias("type"), F.coalesce("_d", "description").alias("description"))


def merge_graph_nodes(rows: DataFrame) -> DataFrame:
    """title -> type (the last that isn't empty, by ord), descriptions (distinct, sorted), text_unit_ids: the merge of one extraction's nodes."""
    return rows.filter("title IS NOT NULL").groupBy("title").agg(
        F.max_by("type", F.when(F.coalesce("type", F.lit("")) != "", F.col("ord"))).alias("type"),
        F.array_sort(F.collect_set(F.when(F.col("description") != "", F.col("description")))).alias("descriptions"), F.array_sort(F.collect_set("text_unit_id")).alias("text_unit_ids"),
    )


def merge_titles(parts: DataFrame, arrays: list[str], order: str) -> DataFrame:
    """title -> the given array columns of all its rows put together, in order, repeats kept; the first type."""
    joined = [F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(c).alias("x")))), lambda r: r["x"])).alias(c) for c in arrays]
    return parts.filter("title IS NOT NULL").groupBy("title").agg(F.min_by("type", order).alias("type"), *joined)


def grouped_chunks(docs: DataFrame, group: list[str], order: str, size: int, overlap: int, text_col: str = "text") -> DataFrame:
    """group, chunk_no, start, text, n_tokens: the texts of a group (a document of many rows, bounded) in order, joined by newlines, then chunked."""
    whole = docs.filter(F.col(text_col).isNotNull()).groupBy(*group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text_col).alias("x")))), lambda r: r["x"]), "\n").alias("_text"))
    key = F.struct(*group)
    out = token_chunks(whole.select(key.alias("id"), F.col("_text").alias("text")), size, overlap)
    return out.select(*[F.col(f"document_id.{g}").alias(g) for g in group], "chunk_no", "start", "text", "n_tokens")


def context_lists(edges: DataFrame, members: DataFrame, budget: int) -> DataFrame:
    """level, community, context: the rows (source, target, combined_degree) of a community's own edges by falling degree, at most `budget` of them."""
    a, b = (members.select("level", "community", F.col("title").alias(c)) for c in ("source", "target"))
    inside = edges.join(a, "source").join(b, ["level", "community", "target"])
    order = Window.partitionBy("level", "community").orderBy(F.desc("combined_degree"), "source", "target")
    kept = inside.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= budget)
    rows = F.transform(F.array_sort(F.collect_list(F.struct("_n", "source", "target", "combined_degree"))), lambda r: F.concat_ws("|", r["source"], r["target"], r["combined_degree"].cast("string")))
    return kept.groupBy("level", "community").agg(rows.alias("context"))


def summary_packs(c: Column, budget: int) -> Column:
    """Descriptions (sorted, distinct) packed in order into lists of at most `budget` tokens, for a summary that folds pack after pack: an array of arrays."""
    size = lambda x: F.size(T.tokens(x))
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("now"), F.lit(0).alias("used"))

    def put(s: Column, x: Column) -> Column:
        over = (s["used"] + size(x) > budget) & (F.size(s["now"]) > 0)
        return F.struct(
            F.when(over, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]).alias("done"), F.when(over, F.array(x)).otherwise(F.concat(s["now"], F.array(x))).alias("now"),
            F.when(over, size(x)).otherwise(s["used"] + size(x)).alias("used"),
        )

    said = F.array_sort(F.array_distinct(F.filter(c, lambda x: x.isNotNull() & (x != ""))))
    return F.aggregate(said, start, put, lambda s: F.when(F.size(s["now"]) > 0, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]))
