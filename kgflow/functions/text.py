"""Scalar functions over strings, as Column expressions. White space is Unicode's, as (?U) says."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Dashes that count as a hyphen in entity names, and in text.
ENTITY_DASHES = "‐‑‒–—"
TEXT_DASHES = "‐‑‒–—―−﹘﹣－"
# Entities known under two names.
ENTITY_RENAMES = {"bit torrent": "bittorrent", "unreliable edge to edge message delivery service": "unreliable channel"}


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_entity(c: Column) -> Column:
    """Stripped, lower case, underscores as blanks, typographic dashes as hyphens."""
    return F.translate(F.lower(strip(c)), "_" + ENTITY_DASHES, " " + "-" * len(ENTITY_DASHES))


def rename_entity(c: Column, renames: dict[str, str] = ENTITY_RENAMES) -> Column:
    if not renames:
        return c
    table = F.create_map(*[F.lit(x) for pair in renames.items() for x in pair])
    return F.coalesce(F.try_element_at(table, c), c)


def normalize_dashes(c: Column) -> Column:
    return collapse(F.translate(F.lower(c), TEXT_DASHES, "-" * len(TEXT_DASHES)))


def head_variants(c: Column) -> Column:
    """Spellings to look a head up under, in order of preference, without repeats or empty ones."""
    raw, base = collapse(F.lower(c)), normalize_dashes(c)
    bare = F.trim(F.regexp_replace(base, r"\s*[(\[].*?[)\]]\s*$", ""))
    spaced = [collapse(F.regexp_replace(x, r"\s*-\s*", " - ")) for x in (base, bare)]
    tight = [collapse(F.regexp_replace(x, r"\s*-\s*", "-")) for x in (base, bare)]
    number = F.when(~base.endswith("s"), F.concat(base, F.lit("s"))).when(F.length(base) > 4, base.substr(F.lit(1), F.length(base) - 1))
    every = F.array(raw, base, spaced[0], tight[0], bare, spaced[1], tight[1], F.when(base != "", number))
    return F.array_distinct(F.filter(every, lambda v: v.isNotNull() & (v != "")))


def relation_name(c: Column, stripped: bool = True) -> Column:
    """Blanks as underscores (two blanks give two)."""
    return F.replace(F.trim(c) if stripped else c, F.lit(" "), F.lit("_"))


def triple_parts(c: Column) -> Column:
    """'head | relation | tail' as a struct; parts that are missing are NULL."""
    parts = F.split(c, r" \| ")
    return F.struct(*[F.try_element_at(parts, F.lit(i + 1)).alias(n) for i, n in enumerate(("head", "relation", "tail"))])


def format_relation(head: Column, relation: Column, tail: Column) -> Column:
    return F.concat_ws(" | ", head, relation, tail)


def unescape_html(c: Column) -> Column:
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def clean_str(c: Column) -> Column:
    """Trimmed, common HTML entities resolved, control characters dropped."""
    return F.regexp_replace(unescape_html(strip(c)), r"[\x00-\x1f\x7f-\x9f]", "")


def records(c: Column, record: str = "##", field: str = "<|>") -> Column:
    """An extraction answer as an array of arrays of cleaned fields; outer brackets of a record are dropped."""
    quote = lambda s: "\\Q" + s + "\\E"
    rows = F.filter(F.transform(F.split(c, quote(record)), strip), lambda r: r != "")
    return F.transform(rows, lambda r: F.transform(F.split(F.regexp_replace(r, r"^\(|\)$", ""), quote(field)), clean_str))


def after_think(c: Column) -> Column:
    """What follows the first </think>, else everything."""
    at = F.instr(c, "</think>")
    return strip(F.when(at > 0, F.substr(c, at + 8)).otherwise(c))


def last_bracket(c: Column) -> Column:
    """Content of the right-most square brackets, stripped and in lower case; '' if there are none."""
    return F.lower(F.trim(F.regexp_extract(c, r"(?s)^.*\[([^\[]*)\][^\]]*$", 1)))


def last_json_list(c: Column) -> Column:
    """The right-most [...] of an answer parsed as a list of strings; empty if it can't be parsed."""
    found = F.try_element_at(F.regexp_extract_all(F.regexp_replace(c, "```(?:json)?", ""), F.lit(r"(?s)\[[^\[\]]*\]"), F.lit(0)), F.lit(-1))
    return F.coalesce(F.from_json(found, "array<string>", {"allowSingleQuotes": "true"}), F.array().cast("array<string>"))


def last_json_lists(c: Column, n: int) -> Column:
    """A list of lists parsed from an answer, padded with empty lists or cut to n."""
    found = F.regexp_extract(F.regexp_replace(c, "```(?:json)?", ""), r"(?s)(\[.*\])", 1)
    rows = F.coalesce(F.from_json(found, "array<array<string>>", {"allowSingleQuotes": "true"}), F.array().cast("array<array<string>>"))
    return F.slice(F.concat(rows, F.array_repeat(F.array().cast("array<string>"), n)), 1, n)


def last_json_object(c: Column) -> Column:
    """The right-most {...} with as many opening as closing braces (so nested ones stay whole) that parses as an object, with its keys sorted; '' if there is none."""
    end = F.length(c) - F.coalesce(F.nullif(F.instr(F.reverse(c), "}"), F.lit(0)), F.length(c) + 1) + 1
    body = F.when(end > 0, F.substr(c, F.lit(1), end))
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.length(body), F.lit(1))), lambda p: F.substr(body, p, F.lit(1)) == "{")
    found = F.filter(F.transform(starts, lambda p: F.substr(body, p)), lambda x: (F.length(F.replace(x, F.lit("{"), F.lit(""))) == F.length(F.replace(x, F.lit("}"), F.lit("")))) & F.try_parse_json(x).isNotNull())
    return F.coalesce(F.to_json(F.try_parse_json(F.try_element_at(found, F.lit(-1)))), F.lit(""))


def repaired_json(c: Column) -> Column:
    """The outermost {...} of an answer with fences, comments of models and trailing commas removed and single quotes read as double ones, as canonical JSON; NULL if it still can't be parsed."""
    body = F.regexp_extract(F.regexp_replace(c, "```(?:json)?", ""), r"(?s)(\{.*\})", 1)
    plain = F.regexp_replace(body, r",\s*([}\]])", "$1")
    quoted = F.regexp_replace(plain, r"'", '"')
    return F.to_json(F.coalesce(F.try_parse_json(body), F.try_parse_json(plain), F.try_parse_json(quoted)))


def boxed_choice(c: Column) -> Column:
    """Number of the last boxed answer: a-d 0-3, none 4, maybe 5, anything else 6 (yes, no and maybe answers too)."""
    got = F.lower(F.trim(F.try_element_at(F.regexp_extract_all(c, F.lit(r"\\boxed\{([^}]*)\}"), F.lit(1)), F.lit(-1))))
    return F.when(got.isNull(), 4).when(got.isin("a", "b", "c", "d"), F.ascii(got) - 97).when(got == "maybe", 5).otherwise(6)


def answer_relation(c: Column, relations: list[str]) -> Column:
    """The relation after 'Answer:'; else the first of `relations` that occurs as a whole word; else NULL."""
    said = F.lower(F.regexp_extract(c, r"(?i)answer:\s*(\w+)", 1))
    out = F.when(said.isin(*relations), said)
    for r in relations:
        out = F.coalesce(out, F.when(F.lower(c).rlike(rf"\b{r}\b"), F.lit(r)))
    return out


def line_verdicts(c: Column) -> Column:
    """The first yes, no or weak of each line that has one."""
    got = F.transform(F.split(F.lower(c), "\n"), lambda x: F.regexp_extract(x, r"\b(yes|no|weak)\b", 1))
    return F.filter(got, lambda x: x != "")


def tail_lines(c: Column, most: int = 80) -> Column:
    """Lines of an answer as tails: bullets and numbers stripped, lower case, long ones and ones that introduce a list left out."""
    lines = F.transform(F.split(c, "\n"), lambda x: F.lower(F.trim(F.regexp_replace(x, r"^[\s\-*•\d.)]+", ""))))
    return F.filter(lines, lambda x: (x != "") & (F.length(x) <= most) & ~((F.length(x) > 40) & F.contains(x, F.lit(":"))))


def strip_lead(c: Column) -> Column:
    """Without the heading word an abstract may begin with."""
    return F.regexp_replace(c, r"(?i)^\s*(abstract|background|introduction|summary|objectives?|purpose|overview of)\s*[:.\-]?\s+", "")


def dehyphenate(c: Column) -> Column:
    """Words broken at line ends are joined, white space collapsed."""
    return collapse(F.regexp_replace(c, r"(\w)-\s*\n\s*(\w)", "$1$2"))


def ngram_set(c: Column, n: int = 3) -> Column:
    """Distinct character n-grams; empty for shorter strings."""
    size = F.length(c)
    return F.when(size >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(size - (n - 1), F.lit(1))), lambda i: F.substr(c, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    return F.when(F.size(F.array_union(a, b)) > 0, F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def set_cosine(a: Column, b: Column) -> Column:
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.sqrt(F.size(a).cast("double") * F.size(b))).otherwise(0.0)


def tokens(c: Column) -> Column:
    """White-space tokens; empty for a blank string."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")


def token_overlap(a: Column, b: Column) -> Column:
    """1 for equal names, 0.85 if one contains the other, else the Jaccard index of their words."""
    x, y = F.lower(a), F.lower(b)
    return F.when(x == y, 1.0).when(F.contains(x, y) | F.contains(y, x), 0.85).otherwise(jaccard(F.array_distinct(tokens(x)), F.array_distinct(tokens(y))))


def token_density(entity: Column, token: Column) -> Column:
    """Share of an entity's words that equal the token."""
    words = tokens(entity)
    return F.when(F.size(words) > 0, F.size(F.filter(words, lambda w: w == token)) / F.size(words)).otherwise(0.0)


def context_relation(description: Column, source: Column, target: Column) -> Column:
    """A relation's description without the names of its two ends."""
    return collapse(F.replace(F.replace(F.lower(description), F.lower(source), F.lit("")), F.lower(target), F.lit("")))


def titled(title: Column, description: Column) -> Column:
    return F.concat(title, F.lit(":"), F.coalesce(description, F.lit("")))


def hash_id(*cols: Column) -> Column:
    """SHA-512 id over the values, NULL as the empty string, with a separator that keeps ('ab','c') and ('a','bc') apart."""
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]), 512)


def cache_name(c: Column) -> Column:
    return F.substring(F.md5(c), 1, 8)


def delimited(cols: list[str], sep: str = "|") -> Column:
    """A row of a context table; NULL as the empty string."""
    return F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])


# How tagged words merge into noun phrases, which tags make one, and tags left out.
PHRASE_GRAMMAR = {("PROPN", "PROPN"): "PROPN", ("NOUN", "NOUN"): "NOUNS", ("NOUNS", "NOUN"): "NOUNS", ("ADJ", "ADJ"): "ADJ", ("ADJ", "NOUN"): "NOUNS"}
PHRASE_TAGS = ("PROPN", "NOUNS")
LEFT_OUT_TAGS = ("DET", "PRON", "INTJ", "X")
#: Longest word of a phrase.
WORD_LENGTH = 15


def is_compound(words: Column) -> Column:
    """Whether a word has a hyphen with something at its side."""
    return F.exists(words, lambda w: F.contains(w, F.lit("-")) & (F.length(F.trim(w)) > 1))


def short_words(words: Column, most: int = WORD_LENGTH) -> Column:
    return F.forall(words, lambda w: F.length(w) <= most)


def plain_words(words: Column) -> Column:
    """Whether all words consist of Latin letters, digits and hyphens."""
    return F.forall(words, lambda w: w.rlike(r"^[a-zA-Z0-9\-]+$"))


def is_entity(label: Column, words: Column) -> Column:
    """Whether a named entity counts: a number or rank only with several words or a compound one."""
    number = label.isin("CARDINAL", "ORDINAL")
    return (~number & (F.size(words) > 0)) | (number & ((F.size(words) > 1) | is_compound(words)))


def kept_phrase(phrase: Column, proper: Column, stop: tuple[str, ...] = (), most: int = WORD_LENGTH) -> Column:
    """The phrase in upper case without stop nouns; NULL unless it is proper, of several words or compound, and its words are plain and short."""
    words = tokens(phrase)
    if stop:
        words = F.filter(words, lambda w: ~F.upper(w).isin(*[x.upper() for x in stop]))
    ok = (proper | (F.size(words) > 1) | is_compound(words)) & plain_words(words) & short_words(words, most) & (F.size(words) > 0)
    return F.when(ok, F.upper(F.array_join(words, " ")))


def merged_tags(tagged: Column, grammar: dict[tuple[str, str], str] = PHRASE_GRAMMAR, wanted: tuple[str, ...] = PHRASE_TAGS, left_out: tuple[str, ...] = LEFT_OUT_TAGS) -> Column:
    """Noun phrases, as structs (text, pos), of a sentence's tagged words (text, pos): the left-most two neighbours whose tags the grammar
    names merge, again and again, until none do.

    One pass from the left does the same, as in PHRASE_GRAMMAR a merged phrase never merges with a word before it that its first word wouldn't
    have merged with: each word joins the phrase at its left or begins one.
    """
    rule = F.create_map(*[F.lit(x) for (a, b), c in grammar.items() for x in (f"{a},{b}", c)])
    words = F.filter(tagged, lambda t: ~t["pos"].isin(*left_out) & (F.trim(t["text"]) != "") & (t["text"] != "-"))
    made = lambda a, b: F.try_element_at(rule, F.concat_ws(",", a["pos"], b["pos"]))
    joined = lambda a, b: F.struct(F.concat_ws(" ", a["text"], b["text"]).alias("text"), made(a, b).alias("pos"))
    kind = "array<struct<text:string,pos:string>>"

    def put(done: Column, w: Column) -> Column:
        w = F.struct(w["text"].alias("text"), w["pos"].alias("pos"))
        last = F.try_element_at(done, F.lit(-1))
        return F.when((F.size(done) > 0) & made(last, w).isNotNull(), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined(last, w)))).otherwise(F.concat(done, F.array(w))).cast(kind)

    return F.filter(F.aggregate(words, F.array().cast(kind), put), lambda t: t["pos"].isin(*wanted))


def tagged_phrases(tagged: Column, stop: tuple[str, ...] = ()) -> Column:
    """Distinct noun phrases of tagged words, merged by the grammar and kept by kept_phrase."""
    found = F.transform(merged_tags(tagged), lambda t: kept_phrase(t["text"], t["pos"] == "PROPN", stop))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull())))


# Words by which the stand-in tagger knows determiners and pronouns.
DETERMINERS = ("a", "an", "the", "this", "that", "these", "those", "each", "every", "some", "any", "no", "both", "all", "another", "either", "neither")
PRONOUNS = ("i", "you", "he", "she", "it", "we", "they", "them", "us", "him", "her", "its", "their", "our", "his", "which", "who", "whose", "what", "one")
SMALL_WORDS = ("and", "or", "but", "of", "in", "on", "to", "for", "with", "at", "by", "from", "as", "into", "than", "then", "if", "when", "while", "not", "is", "are", "was", "were", "be", "been", "has", "have", "had", "do", "does", "did", "will", "would", "can", "could", "may", "must", "should", "so", "because", "whenever", "after", "before", "through", "still", "again", "first", "only")


def rule_tags(c: Column) -> Column:
    """Words of a text with part-of-speech tags by plain rules (capitals, endings, lists of small words): the stand-in where a tagger is plugged in."""
    words = F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*|[^\s\p{L}\p{N}])"), F.lit(1))

    def tag(w: Column, i: Column) -> Column:
        low = F.lower(w)
        return (
            F.when(low.isin(*DETERMINERS), "DET").when(low.isin(*PRONOUNS), "PRON").when(low.isin(*SMALL_WORDS), "ADP").when(w.rlike(r"^[^\p{L}\p{N}]$"), "PUNCT").when(w.rlike(r"^\p{N}+$"), "NUM")
            .when((i > 0) & w.rlike(r"^\p{Lu}"), "PROPN").when(low.rlike(r"(ing|ed|izes?|ifies|ates?)$"), "VERB").when(low.rlike(r"ly$"), "ADV").when(low.rlike(r"(ous|ful|ive|able|ible|al|ic|less|ant|ent)$"), "ADJ").otherwise("NOUN")
        )

    return F.transform(words, lambda w, i: F.struct(w.alias("text"), tag(w, i).alias("pos")))


def noun_phrases(c: Column, stop: tuple[str, ...] = ()) -> Column:
    """Upper-cased noun phrases of a text: names (runs of capitalised words) and the phrases that the grammar makes of its tagged words; stop words left out."""
    found = F.regexp_extract_all(c, F.lit(r"\b([A-Z][A-Za-z0-9]+(?:[ -][A-Z0-9][A-Za-z0-9]*)*)\b"), F.lit(1))
    upper = F.array_distinct(F.transform(found, F.upper))
    return F.filter(upper, lambda x: (F.length(x) > 2) & ~x.isin(*[s.upper() for s in stop])) if stop else F.filter(upper, lambda x: F.length(x) > 2)


def sentences_simple(c: Column) -> Column:
    """Pieces between full stops, question and exclamation marks followed by white space."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), strip), lambda s: s != "")


def valid_word_start(token: Column, prefix: str = "##") -> Column:
    return ~token.startswith(prefix) & token.rlike(r"^[\p{L}\p{N}]")


def seeded_uuid(seed: int, *cols: Column) -> Column:
    """A version-4 UUID that depends on a seed and the values alone."""
    h = F.md5(F.concat_ws("\u0001", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]))
    part = lambda a, n: F.substring(h, a, n)
    variant = F.element_at(F.array(*[F.lit(x) for x in "89ab"]), F.pmod(F.conv(part(17, 1), 16, 10).cast("int"), F.lit(4)) + 1)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-4"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def unit_ids_of(sources: Column, unit_ids: Column) -> Column:
    """A comma list of indexes into unit_ids (from 0) as the ids they stand for; what is no index is dropped."""
    at = F.transform(F.split(sources, ","), lambda x: F.try_to_number(F.trim(x), F.lit("999999999")).cast("int"))
    ids = F.transform(F.filter(at, lambda i: i.isNotNull() & (i >= 0) & (i < F.size(unit_ids))), lambda i: F.get(unit_ids, i))
    return F.array_join(ids, ", ")
