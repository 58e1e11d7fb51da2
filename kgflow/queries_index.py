"""More registered queries: functions, index tables, graphs, search contexts and lookups, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import external
from .functions import arrays as A
from .functions import text as T
from .operators import embed, evaluate, graph, ids, index, linking, retrieval, triples, update
from .plans import workflows
from .queries import _COLLAPSE, _PAIRS, _UNDIRECTED, _mentions, _pairs, _plain, query
from .session import materialize, table
from .sources import io

# --- functions -------------------------------------------------------------------------------------------------------------

_DASHES = f"translate(lower(head), '{T.TEXT_DASHES}', '{'-' * len(T.TEXT_DASHES)}')"


@query(rf"""SELECT row_id, {_COLLAPSE.format(c=_DASHES)} AS dashes, head || ':' || coalesce(tail, '') AS titled, coalesce(head, '') || '|' || coalesce(relation_type, '') || '|' || row_id AS delimited,
CASE WHEN tail IS NOT NULL THEN {_COLLAPSE.format(c="replace(replace(lower(head || ' links ' || tail || ' fast'), lower(head), ''), lower(tail), '')")} END AS context, (relation_type IS NULL OR relation_type NOT IN ('is_a', 'carries')) AS kept FROM seed_kg_ch2 WHERE head <> '' AND (tail IS NULL OR tail <> '')""")
def text_forms(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "seed_kg_ch2").filter("head <> '' AND (tail IS NULL OR tail <> '')")
    kept = triples.without_relations(t, ["is_a", "carries"]).select("row_id", F.lit(True).alias("kept"))
    said = F.concat("head", F.lit(" links "), "tail", F.lit(" fast"))
    rows = t.select("row_id", T.normalize_dashes(F.col("head")).alias("dashes"), T.titled(F.col("head"), F.col("tail")).alias("titled"), T.delimited(["head", "relation_type", "row_id"]).alias("delimited"), T.context_relation(said, F.col("head"), F.col("tail")).alias("context"))
    return rows.join(kept, "row_id", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


@query(r"""SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS joined, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS tokens FROM documents WHERE text IS NOT NULL""")
def document_cleaning(s: SparkSession, d: str) -> DataFrame:
    """A heading put before every text and a word broken in it are taken away again."""
    t = table(s, d, "documents").filter("text IS NOT NULL")
    text = T.strip_lead(F.concat(F.lit("  Abstract: net-\n work "), "text"))
    return t.select("doc_id", T.dehyphenate(text).alias("j"), F.size(T.tokens(F.col("text"))).alias("tokens")).select("doc_id", F.trim(F.substr("j", F.lit(8))).alias("joined"), "tokens")


_RELS = ["is_a", "carries", "measures", "protects"]


@query("""SELECT row_id, CASE row_id % 4 WHEN 0 THEN CASE WHEN lower(relation_type) IN ('is_a', 'carries', 'measures', 'protects') THEN lower(relation_type) END WHEN 1 THEN 'carries' WHEN 2 THEN 'is_a' END AS relation,
CASE row_id % 4 WHEN 0 THEN ['yes', 'weak'] WHEN 1 THEN ['no'] ELSE [] END AS verdicts, CASE row_id % 4 WHEN 0 THEN [['a', relation_type], ['b'], []] ELSE [[], [], []] END AS lists FROM seed_kg_ch2 WHERE relation_type IS NOT NULL AND regexp_full_match(relation_type, '[a-z_]+')""")
def answer_forms(s: SparkSession, d: str) -> DataFrame:
    t, n = table(s, d, "seed_kg_ch2").filter("relation_type RLIKE '^[a-z_]+$'"), F.col("row_id") % 4
    relation = F.when(n == 0, F.concat(F.lit("Answer: "), "relation_type")).when(n == 1, "it carries what it measures, answer: unclear".replace("measures", "hears")).when(n == 2, "this is_a thing that carries on").otherwise("nothing")
    verdicts = F.when(n == 0, "1. Yes, not no\nnone\n3. weak").when(n == 1, "No.\n yesterday").otherwise("")
    lists = F.when(n == 0, F.concat(F.lit("so: ```json\n[[\"a\", \""), "relation_type", F.lit("\"], ['b']]\n```"))).otherwise("[oh")
    return t.select("row_id", T.answer_relation(relation, _RELS).alias("relation"), T.line_verdicts(verdicts).alias("verdicts"), T.last_json_lists(lists, 3).alias("lists"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{"a":{"b":' || (props->>'$.k') || '},"c":"' || event_type || '"}' WHEN 1 THEN '' ELSE '{"k":' || (props->>'$.k') || '}' END AS object,
CASE event_id % 3 WHEN 0 THEN '{"a":[1,2],"t":"' || event_type || '"}' WHEN 1 THEN NULL ELSE '{"x":1}' END AS repaired, event_id % 3 = 2 AS typed FROM events""")
def json_repair(s: SparkSession, d: str) -> DataFrame:
    e, n = table(s, d, "events"), F.col("event_id") % 3
    k = F.get_json_object("props", "$.k")
    said = F.when(n == 0, F.concat(F.lit('so {x} is {"c": "'), "event_type", F.lit('", "a": {"b": '), k, F.lit("}} done"))).when(n == 1, "no } object {").otherwise(F.concat(F.lit('{"k": '), k, F.lit("}")))
    broken = F.when(n == 0, F.concat(F.lit("```json\n{'t': '"), "event_type", F.lit("', 'a': [1, 2,],}\n```"))).when(n == 1, "{broken").otherwise('{"x": 1}')
    return e.select("event_id", T.last_json_object(said).alias("object"), T.repaired_json(broken).alias("repaired"), A.has_types(F.when(n == 2, '{"x": 1, "y": "t"}').when(n == 1, '{"x": "1", "y": "t"}').otherwise("[]"), {"x": "BIGINT", "y": "STRING"}).alias("typed"))


@query(r"""WITH t AS (SELECT id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM text_chunks WHERE text IS NOT NULL)
SELECT id, CASE WHEN len(w) >= 3 THEN coalesce(list_position([w[i : i + 1] = w[2 : 3] FOR i IN range(1, len(w))], true) - 1, -1) ELSE -1 END AS at, CASE WHEN len(w) >= 3 THEN coalesce(list_position([w[i : i + 1] = w[2 : 3] FOR i IN range(1, len(w))], true) - 1, -1) ELSE -1 END AS head_at,
least(len(w), 2) AS pairs, [array_to_string(w[1 : 2], '/'), array_to_string(w[3 : 3], '/')] AS rebuilt, [CASE WHEN i IN (0, 2) THEN 1 ELSE 0 END FOR i IN range(4)] AS mask FROM t""")
def array_forms(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "text_chunks").filter("text IS NOT NULL").select("id", T.tokens(F.col("text")).alias("w"))
    two = F.when(F.size("w") >= 3, F.slice("w", 2, 2)).otherwise(F.array().cast("array<string>"))
    flat = F.slice("w", 1, 3)
    return t.select(
        "id", A.find_subarray(F.col("w"), two).alias("at"), A.head_position(F.col("w"), F.array(F.array(F.lit("\0")), two)).alias("head_at"), F.size(A.zipped(F.col("w"), F.array(F.lit("a"), F.lit("b")), ("x", "y"))).cast("long").alias("pairs"),
        F.transform(A.rebuilt(flat, F.array(F.lit(2), F.lit(1))), lambda x: F.array_join(x, "/")).alias("rebuilt"), A.start_mask(4, F.array(F.lit(0), F.lit(2))).alias("mask"),
    )


@query("""WITH x AS (SELECT event_id, [value, 1.0, (props->>'$.k')::double / 50] AS v FROM events), e AS (SELECT event_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS token, list_max(v) AS m FROM x),
p AS (SELECT event_id, token, exp(x - m) / sum(exp(x - m)) OVER (PARTITION BY event_id) AS prob FROM e) SELECT event_id, token, round(prob, 6) AS prob FROM p QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY prob DESC, token) <= 2""")
def softmax_top_tokens(s: SparkSession, d: str) -> DataFrame:
    v = F.array("value", F.lit(1.0), F.get_json_object("props", "$.k").cast("double") / 50)
    e = table(s, d, "events").select("event_id", F.explode(A.top_tokens(v, 2)).alias("t"))
    return e.select("event_id", F.col("t.token").alias("token"), F.round("t.prob", 6).alias("prob"))


@query("""WITH g AS (SELECT chunk_id, head, relation_type, tail FROM seed_kg_ch2 WHERE chunk_id IS NOT NULL AND head IS NOT NULL), h AS (SELECT chunk_id, head, list_sort(list(DISTINCT relation_type) FILTER (relation_type IN ('is_a', 'carries', 'measures'))) AS r FROM g GROUP BY ALL)
SELECT chunk_id, head, relation FROM (SELECT chunk_id, head, unnest(r) AS relation FROM h WHERE len(r) > 0) UNION ALL SELECT chunk_id, head, NULL FROM h WHERE len(r) = 0 OR r IS NULL""")
def relation_maps(s: SparkSession, d: str) -> DataFrame:
    """Maps head -> relations as JSON, parsed, validated, and exploded again; heads without a relation keep a row."""
    g = table(s, d, "seed_kg_ch2").filter("chunk_id IS NOT NULL AND head IS NOT NULL")
    heads = g.groupBy("chunk_id", "head").agg(F.array_sort(F.collect_set("relation_type")).alias("r"))
    maps = heads.groupBy("chunk_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("head", "r")))).alias("m"))
    parsed = maps.select("chunk_id", A.json_map(F.col("m"), "map<string,array<string>>").alias("m"))
    valid = parsed.select("chunk_id", F.map_keys("m").alias("heads"), A.valid_relations(F.col("m"), ["is_a", "carries", "measures"]).alias("v"))
    full = valid.select("chunk_id", F.map_from_entries(F.transform("heads", lambda h: F.struct(h, F.transform(F.coalesce(F.try_element_at("v", h), F.array().cast("array<string>")), lambda r: F.struct(r.alias("relation"), F.lit(1.0).alias("score")))))).alias("m"))
    return A.exploded_pairs(full, "m", "chunk_id").select("chunk_id", "head", "relation")


@query("""SELECT event_id, [1, 2, event_id % 5, 0, CASE WHEN event_id % 2 = 0 THEN 9 ELSE 0 END] AS nodes, [1, 1, CASE WHEN event_id % 5 = 0 THEN 0 ELSE 1 END, 0, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END] AS mask, 300000 + event_id AS moved,
CASE WHEN event_id % 2 = 0 THEN event_type || ', u2' ELSE '' END AS units FROM events""")
def graph_inputs(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    nodes = A.input_nodes(F.array(F.lit(1).cast("long"), F.lit(2).cast("long")), F.array(F.array(F.col("event_id") % 5, F.lit(None).cast("long")), F.array(F.when(F.col("event_id") % 2 == 0, F.lit(9).cast("long")))))
    sources = F.when(F.col("event_id") % 2 == 0, " 0, 2,x , 77").otherwise("")
    return e.select("event_id", nodes.alias("nodes"), A.attention_mask(nodes).alias("mask"), A.namespaced(F.col("event_id"), F.lit(4)).alias("moved"), T.unit_ids_of(sources, F.array("event_type", F.lit("u1"), F.lit("u2"))).alias("units"))


@query("""SELECT event_id, [upper(event_type) || ' ' || upper(event_type), 'GOOD LINK-' || (props->>'$.k')] AS phrases, event_type || ' ' || event_type AS proper, event_type <> 'click' AS entity FROM events""")
def noun_phrase_merge(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    w = lambda x, pos: F.struct((F.lit(x) if isinstance(x, str) else x).alias("text"), F.lit(pos).alias("pos"))
    link = F.concat(F.lit("link-"), F.get_json_object("props", "$.k"))
    tagged = F.array(w("The", "DET"), w(F.col("event_type"), "PROPN"), w("-", "PUNCT"), w(F.col("event_type"), "PROPN"), w("sees", "VERB"), w("a", "DET"), w("good", "ADJ"), w(link, "NOUN"), w("now", "ADV"), w("node", "NOUN"))
    found = T.merged_tags(tagged)
    label = F.when(F.col("event_type") == "click", "CARDINAL").otherwise("ORG")
    upper = F.array_sort(T.tagged_phrases(tagged), lambda a, b: F.when(F.contains(a, F.lit("LINK-")) & ~F.contains(b, F.lit("LINK-")), 1).when(F.contains(b, F.lit("LINK-")) & ~F.contains(a, F.lit("LINK-")), -1).otherwise(0))
    return e.select("event_id", upper.alias("phrases"), F.element_at(found, 1)["text"].alias("proper"), T.is_entity(label, F.array("event_type")).alias("entity"))


@query("""WITH h AS (SELECT row_id, md5('7' || chr(1) || row_id) AS h FROM seed_kg_ch2) SELECT row_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-' || substr('89ab', (('0x' || substr(h, 17, 1))::int % 4) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM h""")
def seeded_uuids(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "seed_kg_ch2").select("row_id", T.seeded_uuid(7, F.col("row_id")).alias("id"))


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 1000")
def prefix_subset(s: SparkSession, d: str) -> DataFrame:
    return ids.prefix_subset(table(s, d, "documents").select("doc_id", "lang"), ["doc_id"], 1000)


@query("""WITH h AS (SELECT DISTINCT chunk_id, head FROM seed_kg_ch2 WHERE chunk_id IS NOT NULL AND head IS NOT NULL) SELECT chunk_id, head AS key, row_number() OVER (ORDER BY chunk_id, head) - 1 AS occurrence FROM h""")
def head_occurrences(s: SparkSession, d: str) -> DataFrame:
    h = table(s, d, "seed_kg_ch2").filter("chunk_id IS NOT NULL AND head IS NOT NULL").groupBy("chunk_id").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_set("head")), lambda x: F.struct(x, F.lit(1)))).alias("m"))
    return ids.occurrence_ids(h, "m", ["chunk_id"])


# --- index tables ----------------------------------------------------------------------------------------------------------

_NODES = "SELECT row_id, upper(head) AS title, relation_type AS type, tail AS description, chunk_id FROM seed_kg_ch2 WHERE head IS NOT NULL"


def _nodes(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "seed_kg_ch2").filter("head IS NOT NULL").select(F.col("row_id").alias("ord"), F.upper("head").alias("title"), F.col("relation_type").alias("type"), F.col("tail").alias("description"), F.col("chunk_id").alias("text_unit_id"))


@query(f"""WITH n AS ({_NODES}) SELECT title, arg_max(type, row_id) FILTER (coalesce(type, '') <> '') AS type, coalesce(list_sort(list(DISTINCT description) FILTER (description <> '')), []) AS descriptions, coalesce(list_sort(list(DISTINCT chunk_id) FILTER (chunk_id IS NOT NULL)), []) AS text_unit_ids FROM n GROUP BY 1""")
def graph_node_merge(s: SparkSession, d: str) -> DataFrame:
    return index.merge_graph_nodes(_nodes(s, d))


@query(f"""WITH n AS ({_NODES}) SELECT title, arg_min(coalesce(type, ''), row_id) AS type, list(coalesce(description, '') ORDER BY row_id) AS descriptions FROM n GROUP BY 1""")
def title_merge(s: SparkSession, d: str) -> DataFrame:
    n = _nodes(s, d).select("ord", "title", F.coalesce("type", F.lit("")).alias("type"), F.array(F.coalesce("description", F.lit(""))).alias("descriptions"))
    return index.merge_titles(n, ["descriptions"], "ord")


@query(f"""WITH n AS ({_NODES}) SELECT row_id AS ord FROM n WHERE type IN ('is_a', 'carries') AND len(description) > 0 AND title <> ''""")
def entity_cleanup(s: SparkSession, d: str) -> DataFrame:
    return index.clean_entities(_nodes(s, d), ["is_a", "carries"]).select("ord")


@query(f"""WITH g AS (SELECT source, target, list_sort(list(DISTINCT relation_type) FILTER (relation_type IN ('is_a', 'carries', 'measures'))) AS r FROM ({_PAIRS}) GROUP BY ALL) SELECT source, target, array_to_string(r, ', ') AS description FROM g WHERE len(r) > 0 AND source <> target""")
def relationship_cleanup(s: SparkSession, d: str) -> DataFrame:
    g = _pairs(s, d).groupBy("source", "target").agg(F.collect_list("relation_type").alias("descriptions"))
    return index.clean_relationships(g, ["is_a", "carries", "measures"])


@query(f"""WITH {_UNDIRECTED}, n AS (SELECT DISTINCT source AS title FROM ({_PAIRS})) SELECT title, coalesce(degree, 0) AS degree, 0.0::double AS x, 0.0::double AS y, row_number() OVER (ORDER BY title) - 1 AS human_readable_id FROM n LEFT JOIN deg USING (title)""")
def finalized_entities(s: SparkSession, d: str) -> DataFrame:
    p = _pairs(s, d)
    e = p.select(F.col("source").alias("title"), F.col("relation_type").alias("type"))
    return index.finalize_entities(e, p).select("title", "degree", "x", "y", "human_readable_id")


@query(f"""WITH {_UNDIRECTED}, g AS (SELECT source, target, count(*)::double AS weight FROM ({_PAIRS}) GROUP BY ALL) SELECT source, target, weight, a.degree + b.degree AS combined_degree, row_number() OVER (ORDER BY source, target) - 1 AS human_readable_id FROM g JOIN deg a ON a.title = source JOIN deg b ON b.title = target""")
def finalized_relationships(s: SparkSession, d: str) -> DataFrame:
    p = _pairs(s, d)
    g = p.groupBy("source", "target").agg(F.count("*").cast("double").alias("weight"))
    return index.finalize_relationships(g, graph.degree_undirected(p)).select("source", "target", "weight", "combined_degree", "human_readable_id")


# communities by the lengths of titles: 20 at level 0, each divided by the last letter at level 1
_MEM = f"""t AS (SELECT DISTINCT source AS title FROM ({_PAIRS}) UNION SELECT target FROM ({_PAIRS})), mem AS (SELECT 0 AS level, len(title) % 20 AS community, -1 AS parent, title FROM t
UNION ALL SELECT 1, 100 + (len(title) % 20) * 10 + unicode(right(title, 1)) % 10, len(title) % 20, title FROM t WHERE title <> '')"""


def _members(s: SparkSession, d: str) -> DataFrame:
    p = _pairs(s, d)
    t = p.select(F.col("source").alias("title")).union(p.select("target")).distinct()
    zero = F.length("title") % 20
    one = t.filter("title <> ''").select(F.lit(1).alias("level"), (100 + zero * 10 + F.ascii(F.right("title", F.lit(1))) % 10).cast("long").alias("community"), zero.cast("long").alias("parent"), "title")
    return t.select(F.lit(0).alias("level"), zero.cast("long").alias("community"), F.lit(-1).cast("long").alias("parent"), "title").unionByName(one)


@query(f"""WITH {_MEM}, g AS (SELECT source, target, min(triple_id) AS id FROM ({_PAIRS}) GROUP BY ALL), e AS (SELECT level, community, parent, count(*) AS size FROM mem GROUP BY ALL),
r AS (SELECT a.level, a.community, count(DISTINCT g.id) AS relationships, list_sort(list(DISTINCT g.id)) AS text_unit_ids FROM g JOIN mem a ON a.title = source JOIN mem b ON b.title = target AND b.level = a.level AND b.community = a.community GROUP BY ALL)
SELECT level, community, parent, size, coalesce(relationships, 0) AS relationships, coalesce(text_unit_ids, []) AS text_unit_ids FROM e LEFT JOIN r USING (level, community)""")
def entity_community_tables(s: SparkSession, d: str) -> DataFrame:
    m = _members(s, d)
    g = _pairs(s, d).groupBy("source", "target").agg(F.min("triple_id").alias("id")).select(F.col("id").cast("string").alias("id"), "source", "target", F.array(F.col("id").cast("string")).alias("text_unit_ids"))
    out = index.community_tables(m, m.select("title", F.col("title").alias("id")).distinct(), g, "2024-01-01")
    return out.select("level", "community", "parent", F.col("size").cast("long").alias("size"), F.size("relationship_ids").cast("long").alias("relationships"), F.array_sort(F.transform("text_unit_ids", lambda x: x.cast("long"))).alias("text_unit_ids"))


@query(f"""WITH {_MEM}, n AS (SELECT level, community, count(*) AS n FROM mem GROUP BY ALL) SELECT 0 AS level, parent AS community, mem.community AS sub_community, count(*) AS sub_size FROM mem WHERE level = 1 GROUP BY ALL""")
def entity_community_subsets(s: SparkSession, d: str) -> DataFrame:
    return graph.subset_communities(_members(s, d))


@query(f"""WITH {_MEM} SELECT level, community, parent, 'Community ' || community AS title, array_to_string(list_sort(list(title)), ', ') AS full_content, count(*) AS size, min(title) AS summary FROM mem GROUP BY ALL""")
def community_report_rows(s: SparkSession, d: str) -> DataFrame:
    m = _members(s, d)
    e = m.select("title", F.col("title").alias("id")).distinct()
    c = index.community_tables(m, e, _pairs(s, d).limit(0).select("source", "target", F.lit("x").alias("id"), F.array().cast("array<string>").alias("text_unit_ids")), "2024-01-01")
    return index.community_reports(c, e).select("level", "community", "parent", "title", "full_content", F.col("size").cast("long").alias("size"), "summary")


@query(f"""WITH {_MEM}, {_UNDIRECTED}, p AS (SELECT DISTINCT source, target FROM ({_PAIRS})), e AS (SELECT p.*, x.degree + y.degree AS combined_degree FROM p JOIN deg x ON x.title = source JOIN deg y ON y.title = target),
r AS (SELECT a.level, a.community, e.*, row_number() OVER (PARTITION BY a.level, a.community ORDER BY combined_degree DESC, source, target) AS n FROM e JOIN mem a ON a.title = source JOIN mem b ON b.title = target AND b.level = a.level AND b.community = a.community)
SELECT level, community, list(source || '|' || target || '|' || combined_degree ORDER BY n) AS context FROM r WHERE n <= 30 GROUP BY ALL""")
def community_context_lists(s: SparkSession, d: str) -> DataFrame:
    p = _pairs(s, d).select("source", "target").distinct()
    return index.context_lists(graph.combined_degree(p, graph.degree_undirected(p)), _members(s, d), 30)


@query(f"""WITH {_MEM} SELECT community, coalesce((SELECT list_sort(list(DISTINCT x.community)) FROM mem x WHERE x.parent = m.community), []) AS children FROM (SELECT DISTINCT community FROM mem) m""")
def community_children(s: SparkSession, d: str) -> DataFrame:
    return linking.community_children(_members(s, d).select("community", "parent").distinct())


@query(f"""WITH {_MEM}, x AS (SELECT DISTINCT arg_max(community, level) AS community FROM mem GROUP BY title) SELECT community FROM x""")
def report_roll_up(s: SparkSession, d: str) -> DataFrame:
    m = _members(s, d)
    return linking.rolled_up(m.select("community").distinct(), m, 1)


@query("""WITH f AS (SELECT DISTINCT ON (title) upper(head) AS title, relation_type AS type, tail AS description FROM seed_kg_ch2 WHERE head IS NOT NULL ORDER BY title, row_id), m AS (SELECT DISTINCT ON (title) upper(head) AS title, relation_type AS type, tail AS description FROM validated_ch3 WHERE head IS NOT NULL ORDER BY title, triple_id)
SELECT title, coalesce(m.type, f.type) AS type, coalesce(m.description, f.description) AS description FROM f FULL JOIN m USING (title)""")
def manual_override(s: SparkSession, d: str) -> DataFrame:
    def first(name: str, key: str) -> DataFrame:
        g = table(s, d, name).filter("head IS NOT NULL").groupBy(F.upper("head").alias("title")).agg(F.min(F.struct(key, "relation_type", "tail")).alias("m"))
        return g.select("title", F.col("m.relation_type").alias("type"), F.col("m.tail").alias("description"))

    return index.override(first("seed_kg_ch2", "row_id"), first("validated_ch3", "triple_id"))


@query("SELECT row_id FROM seed_kg_ch2 WHERE chunk_id IS NULL OR chunk_id NOT IN (SELECT id FROM injections_ch5 WHERE id IS NOT NULL)")
def unfinished_rows(s: SparkSession, d: str) -> DataFrame:
    done = table(s, d, "injections_ch5").filter("id IS NOT NULL").select(F.col("id").alias("chunk_id"))
    return update.missing_rows(table(s, d, "seed_kg_ch2"), done, ["chunk_id"]).select("row_id")


@query("""WITH l AS (SELECT upper(head) AS title, max(tail) AS note FROM seed_kg_ch2 WHERE head IS NOT NULL GROUP BY 1), r AS (SELECT upper(head) AS title, min(tail) AS note, true AS there FROM validated_ch3 WHERE head IS NOT NULL GROUP BY 1)
SELECT title, CASE WHEN r.there THEN r.note ELSE l.note END AS note FROM l FULL JOIN r USING (title)""")
def graph_compose(s: SparkSession, d: str) -> DataFrame:
    side = lambda name, f: table(s, d, name).filter("head IS NOT NULL").groupBy(F.upper("head").alias("title")).agg(f("tail").alias("note"))
    return linking.composed(side("seed_kg_ch2", F.max), side("validated_ch3", F.min), ["title"], ["note"])


@query(r"""WITH RECURSIVE t AS (SELECT item_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n, row_number() OVER (ORDER BY item_id) AS k FROM eval_items WHERE text IS NOT NULL),
f AS (SELECT item_id, k, 0 AS batch, n AS used, 1 AS m FROM t WHERE k = 1 UNION ALL SELECT t.item_id, t.k, CASE WHEN m >= 16 OR used + t.n > 800 THEN batch + 1 ELSE batch END, CASE WHEN m >= 16 OR used + t.n > 800 THEN t.n ELSE used + t.n END, CASE WHEN m >= 16 OR used + t.n > 800 THEN 1 ELSE m + 1 END FROM f JOIN t ON t.k = f.k + 1)
SELECT batch, list(item_id ORDER BY item_id) AS ids FROM f GROUP BY 1""")
def embedding_batches(s: SparkSession, d: str) -> DataFrame:
    return external.text_batches(table(s, d, "eval_items"), "item_id", "text", 16, 800).select("batch", "ids")


@query(r"""WITH RECURSIVE t AS (SELECT DISTINCT upper(head) AS title, tail AS x, len(list_filter(regexp_split_to_array(tail, '\s+'), lambda x: x <> '')) AS n FROM validated_ch3 WHERE head IS NOT NULL AND tail <> ''), k AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY x) AS k FROM t),
f AS (SELECT title, x, k, 0 AS pack, n AS used FROM k WHERE k = 1 UNION ALL SELECT k.title, k.x, k.k, CASE WHEN used + n > 12 THEN pack + 1 ELSE pack END, CASE WHEN used + n > 12 THEN n ELSE used + n END FROM f JOIN k ON k.title = f.title AND k.k = f.k + 1)
SELECT title, pack, list(x ORDER BY x) AS descriptions FROM f GROUP BY ALL""")
def summary_packs(s: SparkSession, d: str) -> DataFrame:
    g = table(s, d, "validated_ch3").filter("head IS NOT NULL").groupBy(F.upper("head").alias("title")).agg(F.collect_list("tail").alias("c"))
    return g.select("title", F.posexplode(index.summary_packs(F.col("c"), 12)).alias("pack", "descriptions"))


@query(r"""WITH g AS (SELECT id // 10 AS part, split_name, string_agg(text, chr(10) ORDER BY id) AS text FROM text_chunks WHERE text IS NOT NULL GROUP BY ALL), t AS (SELECT part, split_name, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM g)
SELECT part, split_name, count(*) AS chunks, sum(len(w[s + 1 : s + 50])) AS tokens FROM (SELECT *, unnest(range(0, len(w), 40)) AS s FROM t) GROUP BY ALL""")
def grouped_chunks(s: SparkSession, d: str) -> DataFrame:
    """Chunks of ten neighbouring texts of a split put together: groups are documents, so they stay small."""
    t = table(s, d, "text_chunks").withColumn("part", F.floor(F.col("id") / 10))
    c = index.grouped_chunks(t, ["part", "split_name"], "id", 50, 10)
    return c.groupBy("part", "split_name").agg(F.count("*").alias("chunks"), F.sum("n_tokens").alias("tokens"))


# --- graphs ----------------------------------------------------------------------------------------------------------------

_HOPS = f"""e AS (SELECT DISTINCT source, target FROM ({_PAIRS}) UNION SELECT target, source FROM ({_PAIRS})), r AS (SELECT DISTINCT source AS root FROM ({_PAIRS}) ORDER BY 1 LIMIT 3),
h1 AS (SELECT DISTINCT root, target AS t FROM r JOIN e ON source = root WHERE target <> root), h2 AS (SELECT DISTINCT root, e.target AS t FROM h1 JOIN e ON source = h1.t WHERE e.target <> root AND (root, e.target) NOT IN (SELECT (root, t) FROM h1)),
h3 AS (SELECT DISTINCT root, e.target AS t FROM h2 JOIN e ON source = h2.t WHERE e.target <> root AND (root, e.target) NOT IN (SELECT (root, t) FROM h1 UNION ALL SELECT (root, t) FROM h2))"""


@query(f"""WITH {_HOPS} SELECT root AS source, hops, count(*) AS n FROM (SELECT root, 0 AS hops FROM r UNION ALL SELECT root, 1 FROM h1 UNION ALL SELECT root, 2 FROM h2 UNION ALL SELECT root, 3 FROM h3
UNION ALL SELECT root, 510 FROM r, (SELECT DISTINCT source FROM e) n WHERE n.source <> root AND (root, n.source) NOT IN (SELECT (root, t) FROM h1 UNION ALL SELECT (root, t) FROM h2 UNION ALL SELECT (root, t) FROM h3)) GROUP BY ALL""")
def entity_path_lengths(s: SparkSession, d: str) -> DataFrame:
    p = _pairs(s, d).select("source", "target")
    roots = p.select(F.col("source").alias("title")).distinct().orderBy("title").limit(3)
    return graph.shortest_paths(p, roots, most=3).groupBy("source", "hops").agg(F.count("*").alias("n"))


@query("""SELECT t AS title, CASE WHEN t < 6 THEN list_transform(range(0, t + 1), lambda x: x) ELSE list_concat(range(0, (t - 6) // 3 + 1), [t]) END AS path FROM range(24) x(t)""")
def fixed_graph_paths(s: SparkSession, d: str) -> DataFrame:
    e = graph.fixed_graph(["root_directed", "leaf_directed", "leaf_connected_directed"], 6, 3, s)
    out = graph.shortest_paths(e, s.range(1).select(F.col("id").cast("int").alias("title")), most=10, directed=True)
    return out.select("title", F.transform("path", lambda x: x.cast("long")).alias("path"))


@query("""WITH k AS (SELECT unnest(['root_directed', 'root_undirected', 'root_fully_connected', 'leaf_directed', 'leaf_undirected', 'leaf_connected_directed', 'leaf_connected_undirected']) AS kind, unnest([4, 8, 20, 15, 30, 10, 20]) AS edges) SELECT * FROM k""")
def graph_types(s: SparkSession, d: str) -> DataFrame:
    parts = [graph.fixed_graph([k], 5, 3, s).agg(F.lit(k).alias("kind"), F.count("*").alias("edges")) for k in graph.GRAPH_TYPES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"SELECT 2 * count(DISTINCT t) AS walks, 0 AS jumps, 5 AS least, 5 AS most FROM (SELECT source AS t FROM ({_PAIRS}) WHERE source <> target UNION ALL SELECT target FROM ({_PAIRS}) WHERE source <> target)")
def random_walk_checks(s: SparkSession, d: str) -> DataFrame:
    """What holds of random walks: two from every node, each of five nodes, each step along an edge."""
    p = _pairs(s, d).select("source", "target")
    w = materialize(embed.random_walks(p, 2, 5), "walks")
    steps = w.select(F.explode(F.arrays_zip(F.slice("path", 1, 4).alias("a"), F.slice("path", 2, 4).alias("b"))).alias("x")).select(F.col("x.a").alias("source"), F.col("x.b").alias("target"))
    known = p.unionAll(p.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()
    jumps = steps.join(known, ["source", "target"], "left_anti").agg(F.count("*").alias("jumps"))
    return w.agg(F.count("*").alias("walks"), F.min(F.size("path")).alias("least"), F.max(F.size("path")).alias("most")).crossJoin(jumps)


@query("""SELECT p_size AS page, string_agg(trim(p_name), ' ' ORDER BY p_partkey) AS text FROM part WHERE (p_brand LIKE 'Brand#1%' OR p_brand LIKE 'Brand#2%') AND p_size BETWEEN 5 AND 30 AND trim(p_name) <> '' AND NOT contains(p_name, 'ss') GROUP BY 1""")
def page_body_text(s: SparkSession, d: str) -> DataFrame:
    spans = table(s, d, "part").select(F.col("p_partkey").alias("ord"), F.col("p_size").alias("page"), F.col("p_brand").alias("font"), F.lit(9.5).alias("size"), F.col("p_name").alias("text"))
    return io.body_spans(spans, ["Brand#1", "Brand#2"], 9.0, 10.0, (5, 30), "ss")


@query("""SELECT 'top' AS how, id FROM (SELECT id FROM text_chunks ORDER BY id LIMIT 7) UNION ALL SELECT 'all', id FROM text_chunks""")
def sampled_units(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "text_chunks")
    return retrieval.sampled_units(t, "top", 7).select(F.lit("top").alias("how"), "id").unionByName(retrieval.sampled_units(t, "all", 7).select(F.lit("all").alias("how"), "id"))


# --- search ----------------------------------------------------------------------------------------------------------------


def _entities(s: SparkSession, d: str) -> DataFrame:
    """A vector an entity: that of the first usable relation whose head it is."""
    r = table(s, d, "relation_embeddings").filter("size(embedding) = 96").withColumn("title", F.upper(F.split("relation", " \\| ")[0]))
    ok = F.exists("embedding", lambda x: x != 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return r.filter(ok & F.col("title").isNotNull()).groupBy("title").agg(F.min("id").alias("id"), F.min_by("embedding", "id").alias("v"))


_ENT = """ent AS (SELECT upper(split_part(relation, ' | ', 1)) AS title, min(id) AS id, arg_min(embedding::double[], id) AS v FROM relation_embeddings WHERE relation IS NOT NULL AND len(embedding) = 96 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY 1)"""
_NEAR = f"""{_ENT}, qs AS (SELECT id AS qid, v AS q FROM ent WHERE id % 50 = 0), sc AS (SELECT qid, id, title, round(list_cosine_similarity(q, v), 6) AS score FROM qs, ent),
near AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS ord FROM sc QUALIFY ord <= 6)"""
_GROWN = f"""{_NEAR}, {_UNDIRECTED}, p AS (SELECT DISTINCT source, target FROM ({_PAIRS})), ed AS (SELECT source, target, a.degree + b.degree AS cd FROM p JOIN deg a ON a.title = source JOIN deg b ON b.title = target),
st AS (SELECT n.qid, n.ord AS state, e.source, e.target, e.cd, bool_or(m.title = e.source) AS x, bool_or(m.title = e.target) AS y FROM near n JOIN near m ON m.qid = n.qid AND m.ord <= n.ord JOIN ed e ON e.source = m.title OR e.target = m.title GROUP BY ALL),
lk AS (SELECT qid, state, CASE WHEN x THEN target ELSE source END AS far, count(DISTINCT CASE WHEN x THEN source ELSE target END) AS links FROM st WHERE x <> y GROUP BY ALL),
rk AS (SELECT st.*, CASE WHEN x AND y THEN 'in' ELSE 'out' END AS kind, coalesce(links, 0) AS links FROM st LEFT JOIN lk ON lk.qid = st.qid AND lk.state = st.state AND x <> y AND far = CASE WHEN x THEN target ELSE source END),
nr AS (SELECT *, row_number() OVER w AS nr, count(*) FILTER (kind = 'in') OVER (PARTITION BY qid, state) AS ins FROM rk WINDOW w AS (PARTITION BY qid, state ORDER BY kind, links DESC, cd DESC, source, target)),
us AS (SELECT *, sum(2) OVER (PARTITION BY qid, state ORDER BY nr) AS used FROM nr WHERE kind = 'in' OR nr - ins <= 2 * state), ok AS (SELECT * FROM us WHERE used <= 24),
ov AS (SELECT qid, min(state) AS ov FROM (SELECT qid, state, max(used) AS u FROM ok GROUP BY ALL) WHERE u + 6 > 24 GROUP BY 1)"""


def _near(s: SparkSession, d: str) -> DataFrame:
    e = materialize(_entities(s, d), "entities")
    found = retrieval.batch_vector_search(e.filter("id % 50 = 0").select(F.col("id").alias("qid"), F.col("v").alias("q")), e.select("id", "v"), 6)
    return found.join(e.select("id", "title"), "id").withColumnRenamed("rank", "ord")


def _degree_edges(s: SparkSession, d: str) -> DataFrame:
    p = _pairs(s, d).select("source", "target").distinct()
    return graph.combined_degree(p, graph.degree_undirected(p))


@query(f"WITH {_NEAR} SELECT qid, ord, title, score FROM near")
def batch_context_entities(s: SparkSession, d: str) -> DataFrame:
    """The entities nearest to every fiftieth entity vector, all queries in one job."""
    return _near(s, d).select("qid", "ord", "title", "score")


@query(f"""WITH {_GROWN}, k AS (SELECT qid, coalesce(ov - 1, 6) AS state FROM qs LEFT JOIN ov USING (qid)) SELECT qid, state, source, target, kind, nr FROM ok JOIN k USING (qid, state)""")
def batch_contexts(s: SparkSession, d: str) -> DataFrame:
    """Contexts of all those queries, grown entity by entity: each entity counts 1, each relationship 2, of at most 24."""
    return retrieval.grown_contexts(_near(s, d), _degree_edges(s, d), F.lit(1), F.lit(2), 24, 2)[1]


@query(f"""WITH {_ENT}, q AS (SELECT v AS q FROM ent ORDER BY id LIMIT 1), s AS (SELECT id, round(list_cosine_similarity(q, v), 6) AS score FROM ent, q ORDER BY score DESC, id LIMIT 20), i AS (SELECT id FROM ent ORDER BY id DESC LIMIT 2)
SELECT id, 1.0::double AS score, 0 AS first FROM i UNION ALL SELECT id, score, 1 FROM s WHERE id NOT IN (SELECT id FROM i) AND id NOT IN (SELECT id FROM ent ORDER BY id LIMIT 1)""")
def mapped_entities(s: SparkSession, d: str) -> DataFrame:
    e = materialize(_entities(s, d).withColumnRenamed("v", "embedding"), "entities")
    first = e.orderBy("id").first()
    return retrieval.mapped_entities(e, list(first.embedding), 10, 2, [r.id for r in e.orderBy(F.desc("id")).limit(2).collect()], [first.id])


_UNITS = f"""m AS (SELECT DISTINCT title, u FROM (SELECT source AS title, triple_id AS u FROM ({_PAIRS}) UNION ALL SELECT target, triple_id FROM ({_PAIRS})))"""


@query(f"""WITH {_UNITS}, f AS (SELECT title, row_number() OVER (ORDER BY count(*) DESC, title) AS ord FROM m GROUP BY 1 QUALIFY ord <= 20), c AS (SELECT u, min((ord, title)) AS o FROM m JOIN f USING (title) GROUP BY 1),
l AS (SELECT title, triple_id AS u, count(*) AS n FROM (SELECT source AS title, triple_id FROM ({_PAIRS}) UNION ALL SELECT target, triple_id FROM ({_PAIRS}) WHERE source <> target) GROUP BY ALL)
SELECT c.u AS text_unit_id, o[1] AS entity_order, coalesce(n, 0) AS relations FROM c LEFT JOIN l ON l.title = o[2] AND l.u = c.u""")
def text_unit_ranking(s: SparkSession, d: str) -> DataFrame:
    n = graph.noun_nodes(_mentions(s, d))
    top = n.orderBy(F.desc("frequency"), "title").limit(20).withColumn("ord", F.expr("row_number() OVER (ORDER BY frequency DESC, title)"))
    e = _pairs(s, d).select("source", "target", F.array("triple_id").alias("text_unit_ids"))
    return retrieval.text_unit_ranking(top.select("ord", "title", "text_unit_ids"), e)


@query(f"""WITH {_MEM}, x AS (SELECT DISTINCT source AS title FROM ({_PAIRS}) WHERE source < 'C'), n AS (SELECT community, level, count(*) AS matches FROM mem JOIN x USING (title) GROUP BY ALL)
SELECT community, matches, level, row_number() OVER (ORDER BY matches DESC, level DESC, community) AS nr FROM n""")
def community_matches(s: SparkSession, d: str) -> DataFrame:
    x = _pairs(s, d).filter("source < 'C'").select(F.col("source").alias("title")).distinct()
    n = _members(s, d).join(x, "title").groupBy("community", "level").agg(F.count("*").alias("matches"))
    return ids.numbered(n, [F.desc("matches"), F.desc("level"), "community"], "nr", 1).select("community", "matches", "level", "nr")


@query("""WITH c AS (SELECT user_id AS conv_id, event_id, event_type = 'click' AS u, props FROM events), t AS (SELECT *, sum(u::int) OVER (PARTITION BY conv_id ORDER BY event_id) AS qa_turn FROM c),
g AS (SELECT conv_id, qa_turn, max(CASE WHEN u THEN props END) AS q, coalesce(list(props ORDER BY event_id) FILTER (NOT u), []) AS a FROM t WHERE qa_turn > 0 GROUP BY ALL),
n AS (SELECT *, len(list_filter(regexp_split_to_array(coalesce(q, ''), '\\s+'), lambda x: x <> '')) + len(list_filter(regexp_split_to_array(array_to_string(a, ' '), '\\s+'), lambda x: x <> '')) AS size FROM g QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY qa_turn DESC) <= 5),
w AS (SELECT conv_id, qa_turn, row_number() OVER (PARTITION BY conv_id ORDER BY qa_turn DESC) AS nr, sum(size) OVER (PARTITION BY conv_id ORDER BY qa_turn DESC) AS used FROM n) SELECT conv_id, nr, qa_turn, used FROM w WHERE used <= 30""")
def conversation_context(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "events").select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"), F.when(F.col("event_type") == "click", "user").otherwise("assistant").alias("role"), F.col("props").alias("text"))
    return retrieval.conversation_context(retrieval.qa_turns(c), 5, 30)


@query(f"""WITH {_MEM}, w AS (SELECT community, count(DISTINCT title) AS n FROM mem GROUP BY 1), b AS (SELECT DISTINCT community, community % 3 AS batch, level FROM mem) SELECT community, batch, round(n / (SELECT max(n) FROM w), 6) AS weight, row_number() OVER (PARTITION BY batch ORDER BY n DESC, level DESC, community) AS nr FROM b JOIN w USING (community)""")
def ranked_report_batches(s: SparkSession, d: str) -> DataFrame:
    m = _members(s, d)
    w = retrieval.community_weights(m, m.select("title", F.array("title").alias("text_unit_ids")).distinct())
    r = m.select("community", (F.col("community") % 3).alias("batch"), F.col("level").alias("rank")).distinct()
    return retrieval.weighted_reports(r, w).select("community", "batch", F.round("weight", 6).alias("weight"), "nr")


@query(f"""WITH {_ENT}, q AS (SELECT v AS q FROM ent ORDER BY id LIMIT 1), s AS (SELECT id AS community, round(list_cosine_similarity(q, v), 6) AS score FROM ent, q ORDER BY score DESC, id LIMIT 23) SELECT community, score, ntile(5) OVER (ORDER BY score DESC, community) - 1 AS fold FROM s""")
def primer_folds(s: SparkSession, d: str) -> DataFrame:
    e = materialize(_entities(s, d).select(F.col("id").alias("community"), F.col("v").alias("embedding")), "reports")
    return retrieval.primer_folds(e.select("community"), e, list(e.orderBy("community").first().embedding), 23, 5)


@query("""WITH f AS (SELECT event_id % 40 AS fold, min(event_type) AS answer, list_sort(list(DISTINCT event_type)) AS follow_ups, max(value) AS score FROM events GROUP BY 1)
SELECT string_agg(answer, chr(10) || chr(10) ORDER BY fold) AS answer, len(flatten(list(follow_ups ORDER BY fold))) AS follow_ups, round(avg(score), 6) AS score FROM f""")
def primer_merge(s: SparkSession, d: str) -> DataFrame:
    f = table(s, d, "events").groupBy((F.col("event_id") % 40).alias("fold")).agg(F.min("event_type").alias("answer"), F.array_sort(F.collect_set("event_type")).alias("follow_ups"), F.max("value").alias("score"))
    return retrieval.merged_primer(f).select("answer", F.size("follow_ups").cast("long").alias("follow_ups"), F.round("score", 6).alias("score"))


@query("""WITH c AS (SELECT vec_id AS head, (vec_id * 7 + i) % (SELECT count(*) FROM embeddings) AS id FROM embeddings, range(8) t(i)), s AS (SELECT DISTINCT c.head, c.id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) AS score FROM c JOIN embeddings a ON a.vec_id = head JOIN embeddings b ON b.vec_id = id)
SELECT head, id, score, row_number() OVER (PARTITION BY head ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 4""")
def candidate_topk(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    n = e.count()
    c = e.select(F.col("vec_id").alias("head"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i")).select("head", ((F.col("head") * 7 + F.col("i")) % n).alias("id"))
    return retrieval.ranked_candidates(c, e.select(F.col("vec_id").alias("head"), F.col("embedding").alias("v")), e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 4)


# --- lookups, scores -------------------------------------------------------------------------------------------------------


@query("SELECT event_id FROM events WHERE value > 0.85 AND value / 2 > 0.5 AND value / 3 > 0.7")
def three_metric_filter(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select("event_id", F.col("value").alias("similarity"), (F.col("value") / 2).alias("jaccard"), (F.col("value") / 3).alias("cosine"))
    return linking.passing_matches(e).select("event_id")


@query(f"""WITH n AS (SELECT DISTINCT upper(head) AS name, min(tail) AS entity FROM validated_ch3 WHERE head IS NOT NULL AND tail IS NOT NULL GROUP BY 1) SELECT triple_id, coalesce(a.entity, source) AS subject_id, coalesce(b.entity, target) AS object_id FROM ({_PAIRS}) LEFT JOIN n a ON a.name = source LEFT JOIN n b ON b.name = target""")
def resolved_claims(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "validated_ch3").filter("head IS NOT NULL AND tail IS NOT NULL").groupBy(F.upper("head").alias("name")).agg(F.min("tail").alias("entity"))
    return linking.resolved(_pairs(s, d).select("triple_id", F.col("source").alias("subject_id"), F.col("target").alias("object_id")), n)


@query("SELECT triple_id AS nr, v.head IS NOT DISTINCT FROM s.head AS same FROM validated_ch3 v JOIN seed_kg_ch2 s ON s.row_id = v.triple_id")
def positional_check(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "validated_ch3").select(F.col("triple_id").alias("nr"), "head")
    return linking.positional(a, table(s, d, "seed_kg_ch2").select(F.col("row_id").alias("nr"), "head"), "nr", "head").select("nr", "same")


@query(f"""WITH x AS (SELECT DISTINCT source AS title FROM ({_PAIRS}) WHERE source < 'B'), {_MEM} SELECT 'relationships' AS kind, count(*) AS n FROM ({_PAIRS}) WHERE source IN (SELECT title FROM x) OR target IN (SELECT title FROM x)
UNION ALL SELECT 'covariates', count(*) FROM ({_PAIRS}) WHERE source IN (SELECT title FROM x) UNION ALL SELECT 'text_units', count(*) FROM ({_PAIRS}) WHERE source IN (SELECT title FROM x)
UNION ALL SELECT 'communities', count(DISTINCT (level, community)) FROM mem WHERE title IN (SELECT title FROM x)""")
def candidate_rows(s: SparkSession, d: str) -> DataFrame:
    p = _pairs(s, d)
    chosen = p.filter("source < 'B'").groupBy(F.col("source").alias("title")).agg(F.collect_list("triple_id").alias("text_unit_ids"))
    found = linking.candidate_rows(chosen, p, p.select(F.col("source").alias("subject_id"), "triple_id"), p.select(F.col("triple_id").alias("id")), _members(s, d))
    parts = [df.agg(F.lit(k).alias("kind"), F.count("*").alias("n")) for k, df in found.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(f"WITH {_MEM} SELECT level, community, count(*)::double AS rank FROM mem WHERE level <= 0 GROUP BY ALL HAVING count(*) >= 20")
def ranked_reports(s: SparkSession, d: str) -> DataFrame:
    r = _members(s, d).groupBy("level", "community").agg(F.count("*").cast("double").alias("rank"))
    return linking.ranked_reports(r, 0, 20.0)


@query("SELECT replace(substr(md5(row_id::varchar), 1, 12), 'a', '-a') AS id, row_id FROM seed_kg_ch2 WHERE substr(md5(row_id::varchar), 1, 12) = (SELECT substr(md5(min(row_id)::varchar), 1, 12) FROM seed_kg_ch2)")
def entity_by_id(s: SparkSession, d: str) -> DataFrame:
    """Found by its id without dashes."""
    t = table(s, d, "seed_kg_ch2")
    key = F.substring(F.md5(F.col("row_id").cast("string")), 1, 12)
    wanted = t.select(F.substring(F.md5(F.min("row_id").cast("string")), 1, 12)).first()[0]
    return linking.entity_by_id(t.select(F.replace(key, F.lit("a"), F.lit("-a")).alias("id"), "row_id"), wanted)


@query("""WITH l AS (SELECT event_id AS epoch, value AS loss, abs(value - 3) AS eval_loss, value * 2 AS acc FROM events)
SELECT (SELECT epoch FROM l ORDER BY loss, epoch LIMIT 1) AS loss_epoch, min(loss) AS loss, (SELECT epoch FROM l ORDER BY eval_loss, epoch LIMIT 1) AS eval_loss_epoch, min(eval_loss) AS eval_loss, (SELECT epoch FROM l ORDER BY acc DESC, epoch LIMIT 1) AS accuracy_epoch, max(acc) AS accuracy FROM l""")
def best_epochs(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    return evaluate.best_epochs(e.select(F.col("event_id").alias("epoch"), F.col("value").alias("loss"), F.abs(F.col("value") - 3).alias("eval_loss"), (F.col("value") * 2).alias("eval_accuracy")))


@query("SELECT event_type AS category, count(*) AS llm_calls, sum((props->>'$.k')::int) AS prompt_tokens, sum(event_id) AS output_tokens FROM events GROUP BY ROLLUP (event_type)")
def usage_sums(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select(F.col("event_type").alias("category"), F.lit(1).alias("llm_calls"), F.get_json_object("props", "$.k").cast("long").alias("prompt_tokens"), F.col("event_id").alias("output_tokens"))
    return evaluate.usage(e)


@query("SELECT round(avg(CASE WHEN said = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round((SELECT exp(avg(value / 10)) FROM events), 6) AS perplexity FROM (SELECT CASE WHEN event_id % 3 = 0 THEN -100 ELSE event_id % 7 END AS label, event_id % 5 AS said FROM events) WHERE label <> -100")
def masked_scores(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select(F.when(F.col("event_id") % 3 == 0, -100).otherwise(F.col("event_id") % 7).alias("label"), (F.col("event_id") % 5).alias("said"), (F.col("value") / 10).alias("loss"))
    return evaluate.masked_accuracy(e, "label", "said").crossJoin(evaluate.perplexity(e, "loss")).select(F.round("accuracy", 6).alias("accuracy"), F.round("perplexity", 6).alias("perplexity"))


@query("SELECT user_id, event_type, round(sum(ln(1 / (1 + value) + 1e-12)), 6) AS score, count(*) AS tokens FROM events GROUP BY ALL")
def token_logprobs(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").withColumn("prob", 1 / (1 + F.col("value")))
    return evaluate.token_logprobs(e, ["user_id", "event_type"], "prob").withColumn("score", F.round("score", 6))


def _index(s: SparkSession, d: str) -> workflows.Tables:
    docs = table(s, d, "eval_items").filter("text IS NOT NULL").select(F.concat(F.lit("d"), "item_id").alias("id"), "text")
    return workflows.build_index(docs, size=60, overlap=10)


@query(r"""SELECT (SELECT count(*) FROM eval_items WHERE text IS NOT NULL) AS documents, (SELECT sum(ceil(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) / 50)) FROM eval_items WHERE text IS NOT NULL)::bigint AS units, 0 AS lost_edges, 0 AS wrong_degrees, 0 AS titles_twice, 0 AS unreported, 0 AS astray""")
def index_checks(s: SparkSession, d: str) -> DataFrame:
    """What holds of the index built of all evaluation texts: ends of edges are entities, degrees count edges, every entity with an edge has its community, every community its report."""
    t = _index(s, d)
    e, r, m = t["entities"], t["relationships"], t["members"]
    ends = r.select(F.col("source").alias("title")).union(r.select("target"))
    lost = ends.join(e, "title", "left_anti").agg(F.count("*").alias("lost_edges"))
    degree = ends.groupBy("title").agg(F.count("*").alias("n"))
    wrong = e.join(degree, "title", "left").filter(F.coalesce("n", F.lit(0)) != F.col("degree")).agg(F.count("*").alias("wrong_degrees"))
    twice = m.groupBy("level", "title").count().filter("count > 1").agg(F.count("*").alias("titles_twice"))
    unreported = m.select("community").distinct().join(t["community_reports"], "community", "left_anti").agg(F.count("*").alias("unreported"))
    astray = ends.distinct().join(m.filter("level = 0"), "title", "left_anti").agg(F.count("*").alias("astray"))
    head = t["final_documents"].agg(F.count("*").alias("documents")).crossJoin(t["final_text_units"].agg(F.count("*").alias("units")))
    for x in (lost, wrong, twice, unreported, astray):
        head = head.crossJoin(x)
    return head


@query("""SELECT true AS found_itself, true AS within_budget, true AS units_known""")
def local_search_checks(s: SparkSession, d: str) -> DataFrame:
    """What holds of a local search of that index for the vector of its first entity."""
    t = _index(s, d)
    vectors = materialize(t["entities"].select("id", "title", external.hashed_embedding(F.col("title"), 16).alias("embedding")), "vectors")
    first = vectors.orderBy("title").first()
    found = workflows.local_search(t, list(first.embedding), vectors, 5, 5, 400)
    itself = found["entities"].agg(F.coalesce(F.max((F.col("title") == first.title).cast("int")) == 1, F.lit(False)).alias("found_itself"))
    used = None
    for x in found.values():
        n = x.agg(F.coalesce(F.max("used"), F.lit(0)).alias("u"))
        used = n if used is None else used.unionByName(n)
    fits = used.agg((F.sum("u") <= 500).alias("within_budget"))
    known = found["text_units"].join(t["text_units"].select(F.col("id").alias("text_unit_id")), "text_unit_id", "left_anti").agg((F.count("*") == 0).alias("units_known"))
    return itself.crossJoin(fits).crossJoin(known)


# --- one form for both sides, as in queries --------------------------------------------------------------------------------

_LISTS = {
    "answer_forms": ["verdicts", "lists"], "array_forms": ["rebuilt", "mask"], "graph_inputs": ["nodes", "mask"], "noun_phrase_merge": ["phrases"],
    "graph_node_merge": ["descriptions", "text_unit_ids"], "title_merge": ["descriptions"], "entity_community_tables": ["text_unit_ids"], "community_context_lists": ["context"],
    "community_children": ["children"], "embedding_batches": ["ids"], "summary_packs": ["descriptions"], "fixed_graph_paths": ["path"],
}
_WHOLE = {
    "community_checks": "titles repeated missing astray torn", "text_forms": "row_id", "document_cleaning": "doc_id tokens", "answer_forms": "row_id", "json_repair": "event_id",
    "array_forms": "id at head_at pairs", "softmax_top_tokens": "event_id token", "relation_maps": "chunk_id", "graph_inputs": "event_id moved", "noun_phrase_merge": "event_id",
    "seeded_uuids": "row_id", "prefix_subset": "doc_id", "head_occurrences": "chunk_id occurrence", "entity_cleanup": "ord", "finalized_entities": "degree human_readable_id",
    "finalized_relationships": "combined_degree human_readable_id", "entity_community_tables": "level community parent size relationships",
    "entity_community_subsets": "level community sub_community sub_size", "community_report_rows": "level community parent size", "community_context_lists": "level community",
    "community_children": "community", "report_roll_up": "community", "unfinished_rows": "row_id", "embedding_batches": "batch", "summary_packs": "pack",
    "grouped_chunks": "part chunks tokens", "entity_path_lengths": "hops n", "fixed_graph_paths": "title", "graph_types": "edges", "random_walk_checks": "walks jumps least most", "page_body_text": "page", "batch_context_entities": "qid ord",
    "batch_contexts": "qid state nr", "mapped_entities": "id first", "text_unit_ranking": "text_unit_id entity_order relations",
    "community_matches": "community matches level nr", "conversation_context": "conv_id nr qa_turn used", "ranked_report_batches": "community batch nr",
    "primer_folds": "community fold", "primer_merge": "follow_ups", "candidate_topk": "head id rank", "three_metric_filter": "event_id", "resolved_claims": "triple_id",
    "positional_check": "nr", "candidate_rows": "n", "ranked_reports": "level community", "entity_by_id": "row_id", "best_epochs": "loss_epoch eval_loss_epoch accuracy_epoch",
    "usage_sums": "llm_calls prompt_tokens output_tokens", "token_logprobs": "user_id tokens",
    "index_checks": "documents units lost_edges wrong_degrees titles_twice unreported astray",
}

for _name in sorted({*_LISTS, *_WHOLE}):
    _plain(_name, _LISTS.get(_name, []), _WHOLE.get(_name, "").split())
