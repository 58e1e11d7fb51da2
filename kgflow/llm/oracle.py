"""SQL that gives the same rows as the queries of this folder, where SQL can."""

_CORE = r"regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}]+', '', 'g')"


def _core(c: str) -> str:
    return _CORE.format(c=c)


_P4 = f"""
WITH labels AS (SELECT DISTINCT {_core('relation_type')} AS label FROM relation_map WHERE {_core('relation_type')} <> ''),
c AS (SELECT row_id, {_core('head')} AS a, {_core('relation_type')} AS b, {_core('tail')} AS c FROM seed_kg_ch2),
k AS (SELECT *, CASE WHEN b IN (SELECT label FROM labels) THEN 1 WHEN a IN (SELECT label FROM labels) THEN 0
  WHEN c IN (SELECT label FROM labels) THEN 2 ELSE 1 END AS pos FROM c WHERE a <> '' AND b <> '' AND c <> ''),
r AS (SELECT row_id, CASE WHEN pos = 0 THEN b ELSE a END AS h, CASE WHEN pos = 0 THEN a WHEN pos = 2 THEN c ELSE b END AS r,
  CASE WHEN pos = 2 THEN b ELSE c END AS t FROM k),
g AS (SELECT row_id, min(row_id) OVER (PARTITION BY h, r, t) AS kept, count(*) OVER (PARTITION BY h, r, t) AS n_copies FROM r)
"""


def _terms(name: str, table: str, id_col: str, col: str) -> str:
    return f"""SELECT '{name}' AS field_name, term, count(*) AS occurrences, count(DISTINCT id) AS records,
  CASE WHEN count(DISTINCT id) < 3 THEN 'rare'
    WHEN count(DISTINCT id) > 0.02 * (SELECT count(DISTINCT {id_col}) FROM {table}) THEN 'common' END AS mark
  FROM (SELECT {id_col} AS id, {_core(col)} AS term FROM {table}) WHERE term <> '' AND id IS NOT NULL GROUP BY term"""


_P6 = _terms("seed_kg_ch2.relation_type", "seed_kg_ch2", "row_id", "relation_type") + "\nUNION ALL\n" + _terms("injections_ch5.tail", "injections_ch5", "id", "tail")

# all pairs, so for small tables; the operator is approximate on large ones
_P3 = """
WITH v AS (SELECT id, embedding::double[] AS v FROM relation_embeddings WHERE id IS NOT NULL AND len(embedding) = 96
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT a.id, b.id AS neighbour, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM v a JOIN v b ON a.id <> b.id),
r AS (SELECT id, neighbour, similarity, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, neighbour) AS rank FROM s QUALIFY rank <= 5)
"""

ORACLE = {
    "p3_found": _P3 + "SELECT DISTINCT least(id, neighbour) AS id_a, greatest(id, neighbour) AS id_b FROM r WHERE similarity >= 0.8",
    "p3_neighbours": _P3 + "SELECT id, neighbour, rank, similarity FROM r",
    "p4_found": _P4 + "SELECT kept AS kept_row_id, row_id FROM g WHERE row_id <> kept",
    "p4_records": _P4 + "SELECT row_id, n_copies FROM g WHERE row_id = kept",
    "p6_found": f"SELECT field_name, term, mark FROM ({_P6}) WHERE mark IS NOT NULL",
    "p6_terms": _P6,
    "p7_validity": "SELECT count(*) AS documents, 0 AS over_full, 0 AS overlapping, 0 AS changed, 0 AS divided, false AS wasteful FROM documents",
}
