"""Functions over arrays, maps and JSON strings, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RELATIONS_SCHEMA = "map<string,array<struct<relation:string,score:double,tail_cui:string>>>"


def json_map(c: Column, schema: str) -> Column:
    """A JSON object as a map; an empty map for NULL or malformed text."""
    return F.coalesce(F.from_json(c, schema), F.create_map().cast(schema))


def windows(a: Column, size: int, overlap: int = 0) -> Column:
    """Windows of `size` elements whose starts lie size - overlap apart, as structs (start from 0, items)."""
    step = size - overlap
    if step <= 0:
        raise ValueError("overlap must be smaller than size")
    starts = F.when(F.size(a) > 0, F.sequence(F.lit(0), F.greatest(F.size(a) - 1, F.lit(0)), F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice(a, s + 1, F.lit(size)).alias("items")))


def find_subarray(a: Column, b: Column) -> Column:
    """Where b first stands in a, from 0; -1 if nowhere or if b is empty."""
    last = F.size(a) - F.size(b)
    at = F.when((last >= 0) & (F.size(b) > 0), F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.slice(a, i + 1, F.size(b)) == b))
    return F.coalesce(F.try_element_at(at, F.lit(1)), F.lit(-1))


def zipped(a: Column, b: Column, names: tuple[str, str]) -> Column:
    """Two parallel arrays as structs, as far as the shorter one goes."""
    both = F.zip_with(a, b, lambda x, y: F.struct(x.alias(names[0]), y.alias(names[1])))
    return F.slice(both, 1, F.greatest(F.least(F.size(a), F.size(b)), F.lit(0)))


def valid_relations(m: Column, allowed: list[str]) -> Column:
    """A map head -> relations with only allowed relations, each once, in order; heads without any are dropped."""
    ok = F.array(*[F.lit(x) for x in allowed])
    return F.map_filter(F.transform_values(m, lambda _, v: F.array_intersect(v, ok)), lambda _, v: F.size(v) > 0)


def leaf_slots(entries: Column, roots: int) -> Column:
    """An array of `roots` slots filled from (position, value) structs; None where nothing is put, positions outside ignored."""
    filled = F.map_from_entries(F.filter(entries, lambda e: (e["position"] >= 0) & (e["position"] < roots)))
    return F.transform(F.sequence(F.lit(0), F.lit(roots - 1)), lambda i: F.try_element_at(filled, i))


def input_nodes(roots: Column, leaves: Column, pad: int = 0) -> Column:
    """Root tokens followed by the flattened leaves, NULL as the padding id."""
    return F.transform(F.concat(roots, F.flatten(leaves)), lambda x: F.coalesce(x, F.lit(pad)))


def attention_mask(nodes: Column, pad: int = 0) -> Column:
    return F.transform(nodes, lambda x: F.when(x == pad, 0).otherwise(1))


def start_mask(size: int, starts: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(F.array_contains(starts, i), 1).otherwise(0))


def exploded_pairs(df: DataFrame, map_col: str, *keep: str) -> DataFrame:
    """head, relation ('h | r | t'), score for each entry of a map of relation lists; a head with an empty list keeps a row of NULLs."""
    one = df.select(*keep, F.posexplode(F.map_entries(map_col)).alias("head_no", "e"))
    return one.select(*keep, "head_no", F.col("e.key").alias("head"), F.explode_outer("e.value").alias("r")).select(*keep, "head_no", "head", F.col("r.relation").alias("relation"), F.col("r.score").alias("score"))


def softmax(a: Column) -> Column:
    top = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.transform(e, lambda x: x / total)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return F.when((norm(a) > 0) & (norm(b) > 0), dot(a, b) / (norm(a) * norm(b)))


def top_tokens(logits: Column, k: int) -> Column:
    """The k likeliest positions (from 0) with their softmax probabilities, as structs (token, prob), likeliest first, of equal ones the smaller position."""
    p = F.transform(softmax(logits), lambda x, i: F.struct((-x).alias("p"), i.alias("token")))
    return F.transform(F.slice(F.array_sort(p), 1, k), lambda x: F.struct(x["token"].alias("token"), (-x["p"]).alias("prob")))


def head_position(tokens: Column, variants: Column) -> Column:
    """Where the first of the variants (arrays of tokens) that occurs at all stands in tokens, from 0; -1 if none does."""
    at = F.filter(F.transform(variants, lambda v: find_subarray(tokens, v)), lambda p: p >= 0)
    return F.coalesce(F.try_element_at(at, F.lit(1)), F.lit(-1))


def rebuilt(flat: Column, sizes: Column) -> Column:
    """An array of arrays of the given sizes from their elements one after another (the reverse of flatten)."""
    ends = F.aggregate(sizes, F.array().cast("array<int>"), lambda s, n: F.concat(s, F.array(F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0)) + n.cast("int"))))
    return F.zip_with(ends, sizes, lambda e, n: F.slice(flat, e - n.cast("int") + 1, n.cast("int")))


def has_types(c: Column, fields: dict[str, str]) -> Column:
    """Whether a JSON object has every field with the type (as schema_of_variant names it, such as STRING, BIGINT, BOOLEAN or ARRAY)."""
    v = F.try_parse_json(c)
    ok = F.lit(True)
    for name, kind in fields.items():
        got = F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
        ok = ok & F.coalesce(got.startswith(kind), F.lit(False))
    return ok & v.isNotNull()


def namespaced(c: Column, chapter: Column, width: int = 100_000) -> Column:
    """Ids of a chapter (from 1) moved into a range of their own."""
    return c + (chapter - 1) * width
