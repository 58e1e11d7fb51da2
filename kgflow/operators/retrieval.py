"""Vector search, ranking, budgets and contexts: the query side."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as T
from ..session import materialize, small


def vector_search(docs: DataFrame, query: list[float], k: int, id_col: str = "id", vec_col: str = "embedding", metric: str = "cosine", ids: DataFrame | None = None) -> DataFrame:
    """The k rows nearest to a query vector: id, score = 1 - |distance|. ids: only rows with these ids are scored (a semi-join before scoring).

    Rows with a NULL or zero vector are left out. Scoring stays in the JVM and the limit keeps k rows a task, so nothing is sorted whole.
    """
    df = docs.join(ids, id_col, "left_semi") if ids is not None else docs
    q = F.array(*[F.lit(float(x)) for x in query])
    c = A.cosine(F.col(vec_col), q)
    distance = {"cosine": 1 - c, "l2": F.sqrt(A.dot(F.zip_with(vec_col, q, lambda a, b: a - b), F.zip_with(vec_col, q, lambda a, b: a - b)))}[metric]
    return df.select(id_col, F.round(1 - F.abs(distance), 6).alias("score")).filter("score IS NOT NULL").orderBy(F.desc("score"), id_col).limit(k)


def batch_vector_search(queries: DataFrame, docs: DataFrame, k: int, block: int = 2_000) -> DataFrame:
    """qid, id, score, rank for many query vectors (qid, q) against docs (id, v): cosine rounded to six decimals, top k per query (of equal ones the smaller id).

    Queries are a stated set, taken in blocks of `block` vectors that are sent to the tasks; a block reads docs once and each Arrow batch
    gives its k best a query. NULL, zero and not finite vectors, and vectors of another size than the query's, take no part.
    """
    spark, kinds = docs.sparkSession, (dict(queries.dtypes)["qid"], dict(docs.dtypes)["id"])
    usable = lambda c: F.col(c).isNotNull() & F.exists(c, lambda x: x != 0) & ~F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    qs = queries.select("qid", F.col("q").cast("array<double>").alias("q")).filter(usable("q")).withColumn("_b", F.pmod(F.xxhash64("qid"), F.lit(max(1, -(-queries.count() // block)))).cast("int"))
    qs = materialize(qs, "queries")
    rows = docs.select("id", F.col("v").cast("array<double>").alias("v")).filter(usable("v"))
    out = spark.createDataFrame([], f"qid {kinds[0]}, id {kinds[1]}, score double")
    for b in sorted(r[0] for r in qs.select("_b").distinct().collect()):
        some = qs.filter(F.col("_b") == b).collect()
        sets = [([r.qid for r in some if len(r.q) == n], np.array([r.q for r in some if len(r.q) == n])) for n in sorted({len(r.q) for r in some})]
        sent = spark.sparkContext.broadcast([(ids, q / np.linalg.norm(q, axis=1, keepdims=True)) for ids, q in sets])

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                size = pdf["v"].map(len).to_numpy() if len(pdf) else np.zeros(0)
                for qids, q in sent.value:
                    part = pdf[size == q.shape[1]].sort_values("id", kind="stable")
                    if len(part):
                        v = np.stack(list(part["v"]))
                        score = np.round(q @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T, 6)
                        best = np.argsort(-score, axis=1, kind="stable")[:, :k]
                        yield pd.DataFrame({"qid": np.repeat(np.array(qids, dtype=object), best.shape[1]), "id": part["id"].to_numpy()[best.ravel()], "score": np.take_along_axis(score, best, 1).ravel()})

        out = out.unionByName(rows.mapInPandas(run, out.schema))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def ranked_candidates(candidates: DataFrame, left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """head, id, score, rank: the k best of each head's own candidates(head, id) by cosine of left(head, v) and right(id, v)."""
    pairs = candidates.select("head", "id").distinct().join(left.select("head", F.col("v").alias("_x")), "head").join(right.select("id", F.col("v").alias("_y")), "id")
    scored = pairs.select("head", "id", F.round(A.cosine(F.col("_x"), F.col("_y")), 6).alias("score")).filter("score IS NOT NULL")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("head").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)


def grown_contexts(found: DataFrame, edges: DataFrame, entity_size: Column, edge_size: Column, max_tokens: int, top_k: int) -> tuple[DataFrame, DataFrame]:
    """(entities, relationships) of the contexts of many queries at once, grown entity by entity; the last state that fits is kept.

    found(qid, ord, title, ..): a query's entities in order; edges(source, target, combined_degree, ..). A query's entities enter while their sizes fit
    max_tokens. With the first i entities come the relationships that lie among them and the best top_k x i with one end outside (by links of
    that end to the i, then combined degree), as many as fit; a state whose entities and relationships together exceed max_tokens ends
    the growth and the one before it stands. entities: qid, ord, title; relationships: qid, state (the i that stands), source, target, kind, nr.
    All queries and states are one plan; found is a stated, small table (queries x entities of each).
    """
    f = found.withColumn("_size", entity_size).select("qid", "ord", "title", "_size")
    used = F.sum("_size").over(Window.partitionBy("qid").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    f = materialize(f.withColumn("_used", used).withColumn("_i", F.row_number().over(Window.partitionBy("qid").orderBy("ord"))), "found")
    entities = f.filter(F.col("_used") <= max_tokens).select("qid", "ord", "title")
    head = f.groupBy("qid").agg(F.coalesce(F.max(F.when(F.col("_used") <= max_tokens, F.col("_used"))), F.lit(0)).alias("_e"), F.max("_i").alias("_k"))
    e = edges.withColumn("_size", edge_size).select("source", "target", "combined_degree", "_size")
    picked = small(f.select("qid", "title", "_i"))
    touch = e.join(picked.select("qid", F.col("title").alias("source"), F.col("_i").alias("_s")), "source").withColumn("_t", F.lit(None).cast("int"))
    touch = touch.unionByName(e.join(picked.select("qid", F.col("title").alias("target"), F.col("_i").alias("_t")), "target").withColumn("_s", F.lit(None).cast("int")))
    ends = touch.groupBy("qid", "source", "target", "combined_degree", "_size").agg(F.min("_s").alias("_s"), F.min("_t").alias("_t")).join(small(head), "qid")
    states = ends.withColumn("state", F.explode(F.sequence(F.least("_s", "_t"), F.col("_k"))))
    has = [F.coalesce(F.col(c) <= F.col("state"), F.lit(False)) for c in ("_s", "_t")]
    states = states.withColumn("kind", F.when(has[0] & has[1], "in").otherwise("out")).withColumn("_far", F.when(has[0] & has[1], None).when(has[0], F.col("target")).otherwise(F.col("source"))).withColumn("_near", F.when(has[0], F.col("source")).otherwise(F.col("target")))
    links = states.filter("kind = 'out'").groupBy("qid", "state", "_far").agg(F.count_distinct("_near").alias("links"))
    states = states.join(links, ["qid", "state", "_far"], "left").withColumn("links", F.coalesce("links", F.lit(0)))
    best = Window.partitionBy("qid", "state").orderBy("kind", F.desc("links"), F.desc("combined_degree"), "source", "target")
    states = states.withColumn("nr", F.row_number().over(best)).withColumn("_in", F.sum(F.when(F.col("kind") == "in", 1).otherwise(0)).over(Window.partitionBy("qid", "state")))
    states = states.filter((F.col("kind") == "in") | (F.col("nr") - F.col("_in") <= top_k * F.col("state")))
    states = states.withColumn("_used", F.sum("_size").over(best.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("_used") <= max_tokens)
    states = materialize(states.select("qid", "state", "source", "target", "kind", "nr", "_used", "_e", "_k"), "states")
    sums = states.groupBy("qid", "state", "_e").agg(F.max("_used").alias("_used"))
    over = sums.filter(F.col("_e") + F.col("_used") > max_tokens).groupBy("qid").agg(F.min("state").alias("_over"))
    last = head.join(over, "qid", "left").select("qid", F.coalesce(F.col("_over") - 1, F.col("_k")).alias("state"))
    return entities, states.join(last, ["qid", "state"]).select("qid", "state", "source", "target", "kind", "nr")


def conversation_context(turns: DataFrame, max_turns: int, budget: int, recent_first: bool = True) -> DataFrame:
    """conv_id, nr, qa_turn, used: of qa_turns' pairs (conv_id, qa_turn, question, answers) the last max_turns, most recent first if asked, as many as fit the budget of tokens."""
    recent = Window.partitionBy("conv_id").orderBy(F.desc("qa_turn"))
    kept = turns.withColumn("_r", F.row_number().over(recent)).filter(F.col("_r") <= max_turns)
    order = Window.partitionBy("conv_id").orderBy(F.desc("qa_turn") if recent_first else F.asc("qa_turn"))
    size = F.size(T.tokens(F.coalesce("question", F.lit("")))) + F.size(T.tokens(F.array_join("answers", " ")))
    out = kept.withColumn("nr", F.row_number().over(order)).withColumn("used", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return out.filter(F.col("used") <= budget).select("conv_id", "nr", "qa_turn", "used")


def weighted_reports(reports: DataFrame, weights: DataFrame) -> DataFrame:
    """Reports in the order of a global context: by weight(community, normalized), then rank, both falling; a missing weight is 0. nr counts from 1 inside a batch."""
    out = reports.join(weights.select("community", F.col("normalized").alias("weight")), "community", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    return out.withColumn("nr", F.row_number().over(Window.partitionBy("batch").orderBy(F.desc("weight"), F.desc("rank"), "community")))


def primer_folds(reports: DataFrame, vectors: DataFrame, query: list[float], k: int, folds: int) -> DataFrame:
    """community, score, fold: the k reports nearest to the query, divided in order into `folds` runs, the first ones a row longer where k isn't divisible."""
    near = vector_search(vectors, query, k, "community", "embedding").join(reports.select("community"), "community", "left_semi")
    nr = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "community"))  # at most k rows
    ranked = near.withColumn("nr", nr)
    return ranked.crossJoin(ranked.agg(F.count("*").alias("_n"))).withColumn("fold", F.ntile(folds).over(Window.partitionBy("_n").orderBy("nr")) - 1).select("community", "score", "fold")


def merged_primer(folds: DataFrame) -> DataFrame:
    """One row: answer (of all folds in order, blank lines between), follow_ups (of all), score (mean over all folds, a missing one as minus infinity)."""
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("fold", F.col(c).alias("x")))), lambda r: r["x"])
    return folds.agg(
        F.array_join(F.filter(ordered("answer"), lambda x: x != ""), "\n\n").alias("answer"), F.flatten(F.filter(ordered("follow_ups"), lambda x: x.isNotNull())).alias("follow_ups"),
        F.avg(F.coalesce("score", F.lit(float("-inf")))).alias("score"),
    )


def multi_index_search(parts: dict[str, DataFrame], query: list[float], k: int) -> DataFrame:
    """k per index, ids suffixed with the index name (kept as a column of its own too), then the best k of all."""
    found = [vector_search(df, query, k).select(F.concat(F.col("id").cast("string"), F.lit(f"-{n}")).alias("id"), F.lit(n).alias("index_name"), "score") for n, df in sorted(parts.items())]
    return reduce(lambda a, b: a.unionByName(b), found).orderBy(F.desc("score"), "id").limit(k)


def mapped_entities(docs: DataFrame, query: list[float] | None, k: int, oversample: int = 2, include: list = [], exclude: list = []) -> DataFrame:
    """Entities for a query: k x oversample nearest, excluded ones removed, included ones added first; without a query the k greatest by rank."""
    found = vector_search(docs, query, k * oversample).withColumn("first", F.lit(1)) if query is not None else docs.select("id", F.col("rank").cast("double").alias("score")).orderBy(F.desc("score"), "id").limit(k).withColumn("first", F.lit(1))
    found = found.filter(~F.col("id").isin(*exclude)) if exclude else found
    if include:
        asked = docs.filter(F.col("id").isin(*include)).select("id", F.lit(1.0).alias("score"), F.lit(0).alias("first"))
        found = asked.unionByName(found.filter(~F.col("id").isin(*include)))
    return found


def centroid_nearest(docs: DataFrame, k: int) -> DataFrame:
    """The k vectors nearest (Euclidean) to the mean vector of all."""
    dims = docs.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    center = dims.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda v: v["m"]).alias("c"))
    d = F.zip_with("embedding", "c", lambda a, b: a.cast("double") - b)
    return docs.crossJoin(F.broadcast(center)).select("id", F.round(F.sqrt(A.dot(d, d)), 6).alias("distance")).orderBy("distance", "id").limit(k)


def sampled_units(units: DataFrame, how: str, k: int, seed: int = 86) -> DataFrame:
    """k text units to show a model: all, top (the first by id), random (by a hash of seed and id) or auto (nearest to the mean vector; needs id, embedding)."""
    if how == "auto":
        return centroid_nearest(units, k).select("id")
    order = {"all": None, "top": [F.col("id")], "random": [F.xxhash64(F.lit(seed), "id"), F.col("id")]}[how]
    return units.select("id") if order is None else units.orderBy(*order).limit(k).select("id")


def mean_vectors(df: DataFrame, key: str, vec: str) -> DataFrame:
    """Mean of a key's vectors, of unit length."""
    dims = df.select(key, F.posexplode(vec).alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    out = dims.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda v: v["m"]).alias(vec))
    return out.withColumn(vec, A.normalized(F.col(vec)))


def network_relationships(edges: DataFrame, selected: DataFrame) -> DataFrame:
    """edges with kind: 'in' if both ends are among selected(title), 'out' if one is; others are left out."""
    s = selected.select("title").distinct().withColumn("_y", F.lit(True))
    e = edges.join(s.select(F.col("title").alias("source"), F.col("_y").alias("_s")), "source", "left").join(s.select(F.col("title").alias("target"), F.col("_y").alias("_t")), "target", "left")
    both = F.coalesce("_s", F.lit(False)), F.coalesce("_t", F.lit(False))
    return e.withColumn("kind", F.when(both[0] & both[1], "in").when(both[0] | both[1], "out")).filter("kind IS NOT NULL").drop("_s", "_t")


def ranked_relationships(edges: DataFrame, selected: DataFrame, top_k: int) -> DataFrame:
    """All in-network edges, and the best top_k x selected out-network ones: by links of the outside end to the selection, then combined degree."""
    rows = network_relationships(edges, selected)
    s = selected.select(F.col("title").alias("source")).distinct().withColumn("_s", F.lit(True))
    out = rows.filter("kind = 'out'").join(s, "source", "left").withColumn("outside", F.when(F.col("_s"), F.col("target")).otherwise(F.col("source"))).withColumn("inside", F.when(F.col("_s"), F.col("source")).otherwise(F.col("target"))).drop("_s")
    links = out.groupBy("outside").agg(F.countDistinct("inside").alias("links"))
    budget = top_k * selected.select("title").distinct().count()
    best = out.join(links, "outside").orderBy(F.desc("links"), F.desc("combined_degree"), "source", "target").limit(budget)
    cols = ["source", "target", "combined_degree", "kind", "links"]
    return rows.filter("kind = 'in'").withColumn("links", F.lit(0).cast("long")).select(*cols).unionByName(best.select(*cols))


def within_budget(df: DataFrame, group: list[str], order: list[Column | str], size: Column, budget: int) -> DataFrame:
    """The prefix of each group, in a total order, whose sizes add up to at most the budget (sizes are >= 0, so the first overflow ends it)."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("used", F.sum(size).over(w)).filter(F.col("used") <= budget)


def budget_prefix(df: DataFrame, order: list[Column | str], size: Column, budget: int) -> DataFrame:
    """within_budget over the whole table: sizes of at least 1 mean that no more than `budget` rows can fit, so only so many are ordered."""
    first = df.filter(size >= 0).orderBy(*order).limit(budget + 1)
    return within_budget(first.withColumn("_g", F.lit(0)), ["_g"], order, size, budget).drop("_g")


def text_unit_ranking(entities: DataFrame, edges: DataFrame, per_entity: bool = False) -> DataFrame:
    """text_unit_id, entity_order, relations: units of selected entities(ord, title, text_unit_ids); the first entity claims a unit; units by entity, then by the number of the entity's relations in it."""
    u = entities.select("ord", "title", F.explode("text_unit_ids").alias("text_unit_id"))
    ends = edges.select(F.col("source").alias("title"), "text_unit_ids").unionByName(edges.filter("source <> target").select(F.col("target").alias("title"), "text_unit_ids"))
    rel = ends.select("title", F.explode("text_unit_ids").alias("text_unit_id")).groupBy("title", "text_unit_id").agg(F.count("*").alias("relations"))
    first = u.groupBy("text_unit_id").agg(F.min(F.struct("ord", "title")).alias("f")).select("text_unit_id", F.col("f.ord").alias("entity_order"), F.col("f.title").alias("title"))
    return first.join(rel, ["title", "text_unit_id"], "left").select("text_unit_id", "entity_order", F.coalesce("relations", F.lit(0)).alias("relations"))


def community_weights(members: DataFrame, entities: DataFrame) -> DataFrame:
    """community, weight (distinct text units of its entities), normalised by the greatest."""
    u = members.join(entities.select("title", F.explode("text_unit_ids").alias("u")), "title").groupBy("community").agg(F.countDistinct("u").alias("weight"))
    top = u.agg(F.max("weight").alias("_m"))
    return u.crossJoin(F.broadcast(top)).select("community", "weight", F.when(F.col("_m") > 0, F.col("weight") / F.col("_m")).otherwise(0.0).alias("normalized"))


def report_batches(reports: DataFrame, order: list[str], size_col: str, budget: int, header: int = 0, single: bool = False, groups: int | None = None, seed: int | None = None) -> DataFrame:
    """Reports with batch: a sequential fold that opens a new batch when the next report would overflow the budget (with single, stops there).

    A fold over one order can't be split, so reports are dealt to independent folds: `groups` of them, or one for each 5,000 reports. With a
    seed they come in a shuffled order that depends on it alone, else in that of `order`.
    """
    groups = groups or max(1, reports.count() // 5_000)
    columns = [*reports.columns, "group", "batch"]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_o", *order], kind="stable")
        batch, used, out = 0, header, []
        for n in pdf[size_col]:
            if used + n > budget and used > header:
                batch, used = batch + 1, header
            used += n
            out.append(batch)
        pdf = pdf.assign(batch=out)
        return (pdf[pdf["batch"] == 0] if single else pdf)[columns]

    schema = ", ".join(f"`{n}` {t}" for n, t in reports.dtypes) + ", group int, batch int"
    dealt = reports.withColumn("group", F.pmod(F.xxhash64(*order), F.lit(groups)).cast("int")).withColumn("_o", F.xxhash64(F.lit(seed), *order) if seed is not None else F.lit(0))
    return dealt.groupBy("group").applyInPandas(fold, schema)


def community_context(rows: DataFrame, budget: int) -> DataFrame:
    """Per community, edges by combined degree (ties by id), both ends' nodes counted before an edge, up to the budget: level, community, context.

    rows: level, community, id, source, target, combined_degree, size (tokens of the edge), s_size, t_size (of its ends).
    """
    schema = "level int, community long, edges int, nodes int, used long"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["combined_degree", "id"], ascending=[False, True], kind="stable")
        nodes, used, edges = set(), 0, 0
        for r in pdf.itertuples():
            more = r.size + (r.s_size if r.source not in nodes else 0) + (r.t_size if r.target not in nodes else 0)
            if used + more > budget:
                break
            nodes |= {r.source, r.target}
            used, edges = used + more, edges + 1
        return pd.DataFrame([(pdf["level"].iloc[0], pdf["community"].iloc[0], edges, len(nodes), used)], columns=["level", "community", "edges", "nodes", "used"])

    # at most `budget` edges of a community can fit if each has a token: cut before gathering, so no hot community fills a task
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("level", "community").orderBy(F.desc("combined_degree"), "id"))).filter(F.col("_n") <= budget).drop("_n")
    return first.groupBy("level", "community").applyInPandas(fold, schema)


def key_points(responses: DataFrame, budget: int) -> DataFrame:
    """analyst, answer, score: points of JSON answers {points:[{description,score}]} with score > 0, best first, within the token budget."""
    p = responses.select("analyst", F.explode(F.from_json("response", "struct<points:array<struct<description:string,score:double>>>")["points"]).alias("p"))
    p = p.select("analyst", F.col("p.description").alias("answer"), F.col("p.score").alias("score")).filter("score > 0")
    return budget_prefix(p, [F.desc("score"), F.asc("analyst"), F.asc("answer")], F.greatest(F.size(T.tokens(F.col("answer"))), F.lit(1)), budget)


def select_communities(communities: DataFrame, ratings: DataFrame, threshold: int = 1, keep_parent: bool = False, levels: int = 6) -> DataFrame:
    """Communities relevant to a query, found top-down: rated ones at or over the threshold open their children; parents of relevant children go.

    If nothing of a level is relevant, the next level is rated. communities: community, level, parent; ratings: community, rating.
    """
    rated = communities.join(ratings, "community", "left").fillna({"rating": 0})
    level = rated.filter("level = 0")
    chosen = rated.limit(0)
    for n in range(levels):
        good = level.filter(F.col("rating") >= threshold)
        if good.isEmpty():
            level = rated.filter(F.col("level") == n + 1)
            if chosen.isEmpty() and not level.isEmpty():
                continue
            break
        if not keep_parent:
            chosen = chosen.join(good.select(F.col("parent").alias("community")).distinct(), "community", "left_anti").select(*rated.columns)
        chosen = chosen.unionByName(good)
        level = rated.join(good.select(F.col("community").alias("parent")), "parent", "left_semi").select(*rated.columns)
    return chosen


def qa_turns(conversation: DataFrame, last: int | None = None) -> DataFrame:
    """conv_id, qa_turn, question, answers: a user turn opens a pair, the following others attach; leading others are dropped. last: the newest so many."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = conversation.withColumn("qa_turn", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w)).filter("qa_turn > 0")
    out = t.groupBy("conv_id", "qa_turn").agg(
        F.max(F.when(F.col("role") == "user", F.col("text"))).alias("question"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("role") != "user", F.struct("turn", "text")))), lambda x: x["text"]).alias("answers"),
    )
    if last:
        out = out.withColumn("_r", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("qa_turn")))).filter(F.col("_r") <= last).drop("_r")
    return out
