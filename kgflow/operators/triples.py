"""Selecting, cleaning, injecting and expanding triples."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import materialize, small

# Tails that say nothing after is_a.
TRIVIAL_TAILS = ("concept", "metric", "service", "attack", "protocol", "algorithm", "pdu", "channel", "checksum", "delay", "packet", "shared medium")
# Names of single instances in examples.
INSTANCE_PATTERN = (
    r"^(host [a-z]|router [a-z]|router r\d+|router \d+[a-z]+|r\d+|s\d+|h\d+|ap\d+|node [a-z0-9]|station h\d+|switch s\d+|destination [a-z]"
    r"|prefix [a-z]|prefix \d[\d.]+/\d+|subnet \d+|address space [\d.]+/\d+|[a-z]-[a-z] traffic)$"
)
INSTANCE_NAMES = ("salesperson laptop", "headquarters gateway router", "branch-office gateway router", "cisco 6500 router", "bob laptop")
FICTIONAL_NAMES = ("alice", "bob")
COMMERCIAL_HEADS = ("netflix", "youtube")
COMMERCIAL_TAILS = ("gmail", "google maps", "instagram", "youtube")
# Relations with too few triples.
DROPPED_RELATIONS = ("manages", "controls", "maps_to", "decreases", "prevents", "measures", "mitigates", "routes_to")

# Triples that are wrong or misleading.
WRONG_TRIPLES = (
    ("traceroute", "runs_on", "source host"),
    ("router", "causes", "packet loss"),
    ("packet", "increases", "delay"),
    ("n", "increases", "distribution time"),
    ("three-way tcp handshake", "mitigates", "playback attack"),
    ("tcp fin segment", "enables", "truncation attack"),
    ("hit rate", "measures", "web cache"),
    ("source host", "measures", "round-trip delay"),
    ("source host", "measures", "round-trip time"),
    ("central ids processor", "receives", "ids sensor"),
    ("packet switching", "enables", "secure voice"),
)
# Single triples about invented persons, and about products.
FICTIONAL_TRIPLES = (("malicious host", "sends", "spam e-mail"),)
COMMERCIAL_TRIPLES = (("web", "enables", "internet commerce"), ("web", "enables", "search"), ("web", "enables", "social network"))
# Triples that repeat others in other words.
DUPLICATE_TRIPLES = (
    ("dns", "provides", "dns service"),
    ("dns", "provides", "mapping"),
    ("p2p architecture", "provides", "selfscalability"),
    ("tcp", "implements", "slow-start"),
    ("quic", "implements", "reliable data transfer service"),
)
# Fixed values: (head, relation, weaker tail, stronger tail).
SUPERSEDED_TRIPLES = (
    ("tcp", "provides", "reliable data transfer service", "reliable data transfer"),
    ("tcp", "provides", "congestion-control mechanism", "congestion control"),
    ("tcp", "provides", "connection-oriented service", "connection-oriented service"),
    ("tcp", "implements", "congestion control algorithm", "congestion control"),
    ("tcp", "implements", "tcp congestion-control algorithm", "congestion control"),
    ("tcp", "implements", "end-to-end congestion control", "congestion control"),
    ("tcp", "implements", "reliable data transfer service", "reliable data transfer"),
    ("router", "forwards", "network-layer datagram", "ip datagram"),
    ("router", "forwards", "datagram", "ip datagram"),
)


#: Tokens of a (head, relation) up to which they are carried in a row, and pairs of a prediction and an entity that one task meets, about.
CARRIED, PAIRS = 256, 1_000_000
#: Mentions and triples of a list that is joined as one row, about, and injected rows that one task writes, about.
IDS, FACTS, INJECTED = 1_008, 1_008, 5_000_000


@dataclass
class CleaningRules:
    """Data of the cleaning cascade. Triples are (head, relation, tail), superseded are (head, relation, weaker tail, stronger tail)."""

    trivial_tails: tuple[str, ...] = TRIVIAL_TAILS
    instance_pattern: str = INSTANCE_PATTERN
    instance_names: tuple[str, ...] = INSTANCE_NAMES
    fictional: tuple[str, ...] = FICTIONAL_NAMES
    commercial_heads: tuple[str, ...] = COMMERCIAL_HEADS
    commercial_tails: tuple[str, ...] = COMMERCIAL_TAILS
    dropped_relations: tuple[str, ...] = DROPPED_RELATIONS
    wrong: list[tuple[str, str, str]] = field(default_factory=lambda: list(WRONG_TRIPLES))
    fictional_triples: list[tuple[str, str, str]] = field(default_factory=lambda: list(FICTIONAL_TRIPLES))
    commercial_triples: list[tuple[str, str, str]] = field(default_factory=lambda: list(COMMERCIAL_TRIPLES))
    duplicates: list[tuple[str, str, str]] = field(default_factory=lambda: list(DUPLICATE_TRIPLES))
    superseded: list[tuple[str, str, str, str]] = field(default_factory=lambda: list(SUPERSEDED_TRIPLES))


def _among(rows: list[tuple[str, str, str]]) -> Column:
    """Whether (h, r, t) is one of some given triples."""
    tests = [(F.col("h") == a) & (F.col("r") == b) & (F.col("t") == c) for a, b, c in rows]
    return reduce(lambda x, y: x | y, tests, F.lit(False))


def cleaning_reasons(triples: DataFrame, order: list[str], group: list[str] = [], rules: CleaningRules | None = None) -> DataFrame:
    """triples with h, r, t (normalised) and reason (NULL if kept); the first rule that applies wins.

    Rules: exact_duplicate (a later row, by `order`, which must be total, of the same h, r, t in the group), trivial_isa, instance_specific, factually_wrong,
    alice_bob, commercial, near_dupe, dropped_relation, and near_dupe again for a weaker tail whose stronger form is kept in the group.
    """
    rules = rules or CleaningRules()
    name = lambda c: T.rename_entity(T.normalize_entity(F.col(c)))
    df = triples.withColumns({"h": name("head"), "r": T.strip(F.col("relation_type")), "t": name("tail")})
    # the first of equal triples is found by aggregation: a hot one isn't sorted in one task
    key = [*group, "h", "r", "t"]
    first = df.groupBy(*key).agg(F.min(F.struct(*order)).alias("_first")).withColumnsRenamed({c: f"_k{i}" for i, c in enumerate(key)})
    df = df.join(first, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(key)]).drop(*[f"_k{i}" for i in range(len(key))])
    instance = lambda c: F.col(c).rlike(rules.instance_pattern) | F.col(c).isin(*rules.instance_names)
    reason = (
        F.when(~F.struct(*order).eqNullSafe(F.col("_first")), "exact_duplicate")
        .when((F.col("r") == "is_a") & F.col("t").isin(*rules.trivial_tails), "trivial_isa")
        .when(instance("h") | instance("t"), "instance_specific")
        .when(_among(rules.wrong), "factually_wrong")
        .when(F.col("h").isin(*rules.fictional) | F.col("t").isin(*rules.fictional) | _among(rules.fictional_triples), "alice_bob")
        .when(F.col("h").isin(*rules.commercial_heads) | F.col("t").isin(*rules.commercial_tails) | _among(rules.commercial_triples), "commercial")
        .when(_among(rules.duplicates), "near_dupe")
        .when(F.col("r").isin(*rules.dropped_relations), "dropped_relation")
    )
    df = df.withColumn("reason", reason).drop("_first")
    return supersede(df, rules.superseded, group) if rules.superseded else df


def supersede(df: DataFrame, rules: list[tuple[str, str, str, str]], group: list[str] = []) -> DataFrame:
    """Sets reason near_dupe on kept rows (h, r, weaker) if (h, r, stronger) is kept in the same group, itself included."""
    table = df.sparkSession.createDataFrame(rules, "h string, r string, t string, _strong string")
    kept = df.filter("reason IS NULL").select(*group, "h", "r", F.col("t").alias("_strong")).distinct().withColumn("_there", F.lit(True))
    out = df.join(F.broadcast(table), ["h", "r", "t"], "left").join(kept, [*group, "h", "r", "_strong"], "left")
    return out.withColumn("reason", F.coalesce("reason", F.when(F.col("_there"), F.lit("near_dupe")))).drop("_strong", "_there").select(*df.columns)


def relation_counts(df: DataFrame, relation: str = "relation_type", value: str = "tail") -> DataFrame:
    return df.groupBy(relation).agg(F.count(value).alias("total"))


def frequent_relations(df: DataFrame, least: int, relation: str = "relation_type", value: str = "tail") -> DataFrame:
    """Rows whose relation has at least `least` rows with a value. Counted by aggregation, joined back small: a hot relation isn't windowed."""
    keep = relation_counts(df.filter(F.col(relation).isNotNull()), relation, value).filter(F.col("total") >= least).select(relation)
    return df.join(small(keep), relation, "left_semi")


def above(df: DataFrame, score: str, threshold: float) -> DataFrame:
    """Rows with a score strictly above the threshold; NaN and NULL aren't."""
    return df.filter((F.col(score) > threshold) & ~F.isnan(score))


def without_relations(df: DataFrame, relations: list[str], relation: str = "relation_type") -> DataFrame:
    """Rows with other relations; NULL relations stay."""
    return df.filter(~F.coalesce(F.col(relation).isin(*relations), F.lit(False)))


def top_triples(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in a total order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def score_then_diversity(df: DataFrame, head_id: str, tie: list[str], score_bucket: float = 0.01, relation_bucket: int = 100) -> DataFrame:
    """One row per head: best score bucket, then the rarest relation bucket, then the score, then `tie`."""
    top = df.agg(F.max("score").alias("_max"))
    counts = df.groupBy("relation_type").agg(F.count("*").alias("_rel"))
    wide = df.join(small(counts), "relation_type").crossJoin(F.broadcast(top))
    wide = wide.withColumn("_bucket", ((F.col("_max") - F.col("score")) / score_bucket).cast("int")).withColumn("_rare", F.floor(F.col("_rel") / relation_bucket))
    order = [F.asc("_bucket"), F.asc("_rare"), F.desc("score"), *[F.asc(c) for c in tie]]
    return top_triples(wide, [head_id], order).drop("_max", "_rel", "_bucket", "_rare")


def select_seed_triples(df: DataFrame, threshold: float, least: int, head_id: str, tie: list[str], undesired: list[str] = [], again: bool = True) -> DataFrame:
    """The seed selection: cut-off, relation names, blacklist, best row per triple, frequent relations, one triple per head, frequent relations again."""
    kept = above(df.filter("tail IS NOT NULL"), "score", threshold).withColumn("relation_type", T.relation_name(F.col("relation_type")))
    if undesired:
        kept = without_relations(kept, undesired)
    # read three times from here on, so written once
    kept = materialize(top_triples(kept, ["head", "relation_type", "tail"], [F.desc("score"), *[F.asc(c) for c in tie]]), "triples")
    kept = score_then_diversity(frequent_relations(kept, least), head_id, tie)
    return frequent_relations(materialize(kept, "selected"), least) if again else kept


def agreed(df: DataFrame, first: str, second: str, how: str = "both") -> DataFrame:
    """Rows accepted by two judges: both say yes, either does, or soft (one yes and no no)."""
    a, b = F.coalesce(F.col(first), F.lit("")), F.coalesce(F.col(second), F.lit(""))
    test = {"both": (a == "yes") & (b == "yes"), "either": (a == "yes") | (b == "yes"), "soft": ((a == "yes") | (b == "yes")) & (a != "no") & (b != "no")}[how]
    return df.filter(test)


def inject(mentions: DataFrame, triples: DataFrame) -> DataFrame:
    """id, head (as mentioned), relation_type, tail for mentions(id, entity) whose stripped lower-case form is a triple's head. A bag.

    The result grows as the square of a hot head, so mentions and triples of a head are joined as lists of about IDS and FACTS, and a pair of
    lists is dealt to a task before it becomes rows. Those lie together, the mentions innermost and as many as whole bytes hold, so that a
    written file repeats itself and takes a small part of the room.
    """
    spark = mentions.sparkSession
    key = lambda c: F.lower(T.strip(F.col(c)))
    right = materialize(triples.select(key("head").alias("_k"), "relation_type", "tail").filter("_k IS NOT NULL"), "triples")
    left = mentions.select("id", F.col("entity"), key("entity").alias("_k"))
    left = materialize(left.join(small(right.select("_k").distinct()), "_k", "left_semi"), "mentions")

    def lists(df: DataFrame, row: list[str], most: int, name: str) -> DataFrame:
        many = small(df.groupBy("_k").agg(F.count("*").alias("_n")).filter(F.col("_n") > most).select("_k", F.ceil(F.col("_n") / most).alias("_parts")))
        dealt = df.join(many, "_k", "left").withColumn(name, F.pmod(F.xxhash64(*row), F.coalesce("_parts", F.lit(1))))
        return dealt.groupBy("_k", name).agg(F.array_sort(F.collect_list(F.struct(*row))).alias(f"{name}s"))

    sizes = [df.groupBy("_k").agg(F.count("*").alias(n)) for df, n in ((left, "a"), (right, "b"))]
    total = sizes[0].join(sizes[1], "_k").agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // INJECTED)
    met = lists(left, ["entity", "id"], IDS, "_mention").join(lists(right, ["relation_type", "tail"], FACTS, "_fact"), "_k")
    met = met.repartition(tasks, "_k", "_mention", "_fact")
    whole = F.size("_mentions") - F.size("_mentions") % 8
    met = met.select(F.explode(F.array(F.slice("_mentions", F.lit(1), whole), F.slice("_mentions", whole + 1, F.lit(7)))).alias("_mentions"), "_facts")
    met = met.select("_mentions", F.explode("_facts").alias("t")).select("t", F.explode("_mentions").alias("m"))
    return met.select("m.id", F.col("m.entity").alias("head"), "t.relation_type", "t.tail")


def inject_bridged(mentions: DataFrame, triples: DataFrame, bridge: DataFrame) -> DataFrame:
    """Like inject; a mention without a direct hit is looked up through bridge(ord, seed_head, entity), the last seed head given for an entity."""
    key = lambda c: F.lower(T.strip(F.col(c)))
    heads = triples.select(key("head").alias("_k")).filter("_k IS NOT NULL").distinct().withColumn("_direct", F.lit(True))
    last = bridge.groupBy(key("entity").alias("_e")).agg(F.max_by(key("seed_head"), "ord").alias("_via"))
    left = mentions.select("id", "entity", key("entity").alias("_e")).filter("_e IS NOT NULL")
    left = left.join(heads.withColumnRenamed("_k", "_e"), "_e", "left").join(last, "_e", "left")
    left = left.select("id", "entity", F.when(F.col("_direct"), F.col("_e")).otherwise(F.col("_via")).alias("_k"))
    return left.join(triples.select(key("head").alias("_k"), "relation_type", "tail"), "_k").select("id", F.col("entity").alias("head"), "relation_type", "tail")


def new_injections(found: DataFrame, existing: DataFrame) -> DataFrame:
    """Existing rows (a bag) and those found rows that are not among them (a set)."""
    key = ["id", "head", "relation_type", "tail"]
    return existing.select(*key).unionByName(found.select(*key).distinct().join(existing.select(*key), key, "left_anti"))


def first_injection(injections: DataFrame, order: list[str], most_tokens: int) -> DataFrame:
    """The first triple (by `order`) of each chunk and head whose tail has at most most_tokens tokens."""
    fits = injections.filter(F.size(T.tokens(F.col("tail"))) <= most_tokens)
    return top_triples(fits, ["id", "head"], [F.asc(c) for c in order])


def expansion_scores(predictions: DataFrame, entities: DataFrame) -> DataFrame:
    """head, relation, tail, score, n_evidence, tokens from predictions(head, relation, token, prob) and entities(entity).

    A token supports each entity it is a word of, with ln(prob + 1e-12) divided by the number of those entities.
    A prediction's row carries all tokens of its (head, relation), so a pair is whole where its first common token is met and
    what the join gives isn't shuffled. A (head, relation) of over CARRIED tokens would make long rows; its tokens are
    joined one by one with entities that lie in partitions by name. Tokens of many pairs are dealt over several tasks.
    """
    spark, pair = entities.sparkSession, ["head", "relation"]
    words = entities.select("entity", F.array_distinct(T.tokens(F.col("entity"))).alias("_in")).filter(F.size("_in") > 0).dropDuplicates(["entity"])
    words = materialize(words, "words")
    fan = words.select(F.explode("_in").alias("token")).groupBy("token").agg(F.count("*").alias("fan_out"))
    each = predictions.filter(~F.col("token").startswith("##")).join(fan, "token")
    each = each.groupBy(*pair, "token", "fan_out").agg(F.sum(F.log(F.col("prob") + 1e-12) / F.col("fan_out")).alias("_s"), F.count("*").alias("_n"))
    each = materialize(each, "predictions")
    long = small(each.groupBy(*pair).agg(F.count("*").alias("_t")).filter(F.col("_t") > CARRIED).select(*[F.col(c).alias(f"_{c}") for c in pair]))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in pair]

    load = each.groupBy("token").agg((F.count("*") * F.first("fan_out")).alias("_pairs"))
    total = load.agg(F.sum("_pairs")).first()[0] or 0
    hot = small(load.filter(F.col("_pairs") > PAIRS).select("token", F.ceil(F.col("_pairs") / PAIRS).alias("_parts")))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // PAIRS)
    lists = each.join(long, same, "left_anti").groupBy(*pair).agg(F.array_sort(F.collect_list(F.struct("token", "_s", "_n"))).alias("_all"))
    left = lists.select(*pair, "_all", F.col("_all.token").alias("_tokens"), F.explode("_all").alias("e")).select(*pair, "_all", "_tokens", F.col("e.token").alias("token"), "e._s", "e._n")
    left = left.join(hot, "token", "left").withColumn("_salt", F.pmod(F.xxhash64(*pair), F.coalesce("_parts", F.lit(1)))).drop("_parts")
    right = words.select("entity", "_in", F.explode("_in").alias("token")).join(hot, "token", "left")
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    met = left.repartition(tasks, "token", "_salt").join(right.repartition(tasks, "token", "_salt"), ["token", "_salt"])
    met = met.withColumn("tokens", F.array_intersect("_tokens", "_in")).filter(F.col("tokens")[0] == F.col("token"))
    common, alone = F.filter("_all", lambda x: F.array_contains("tokens", x["token"])), F.size("tokens") == 1
    total_of = lambda field, zero, kind: F.aggregate(common, F.lit(zero).cast(kind), lambda s, x: s + x[field])
    score, count = F.when(alone, F.col("_s")).otherwise(total_of("_s", 0.0, "double")), F.when(alone, F.col("_n")).otherwise(total_of("_n", 0, "long"))
    # as a generator's row: a filter on the score would otherwise go into the join and compute it for every pair met
    row = F.struct(score.alias("score"), count.alias("n_evidence"), F.col("tokens").alias("tokens"))
    out = met.select(*pair, F.col("entity").alias("tail"), F.explode(F.array(row)).alias("_r")).select(*pair, "tail", "_r.*")

    some = small(each.join(long, same, "left_semi"))
    by_name = words.repartition(tasks, "entity").select(F.col("entity").alias("tail"), F.explode("_in").alias("token"))
    rest = by_name.join(some, "token").groupBy(*pair, "tail").agg(F.sum("_s").alias("score"), F.sum("_n").alias("n_evidence"), F.array_sort(F.collect_set("token")).alias("tokens"))
    return out.unionByName(rest)


def expansion_candidates(scores: DataFrame, known: DataFrame | Column, min_score: float = -5.0, min_evidence: int = 1, per_pair: int = 20) -> DataFrame:
    """New, non-reflexive candidates: the densest entity of each (head, relation, token), then the best per_pair of each (head, relation).

    known: the triples that aren't new, or a condition on the scores' rows that tells them, which needs no join.
    """
    valid = scores.filter((F.col("head") != F.col("tail")) & (F.col("score") >= min_score) & (F.col("n_evidence") >= min_evidence))
    if isinstance(known, Column):
        valid = valid.filter(~F.coalesce(known, F.lit(False)))
    else:
        valid = valid.join(small(known.select("head", "relation", "tail").distinct()), ["head", "relation", "tail"], "left_anti")
    # a tail is taken apart before its tokens become rows: once a row, not once a token
    rows = valid.withColumn("_words", T.tokens(F.col("tail"))).withColumn("token", F.explode("tokens"))
    rows = rows.withColumn("density", F.when(F.size("_words") > 0, (F.size("_words") - F.size(F.array_remove("_words", F.col("token")))) / F.size("_words")).otherwise(0.0)).drop("_words")
    best = top_triples(rows, ["head", "relation", "token"], [F.desc("density"), F.desc("score"), F.asc("tail")])
    best = best.select("head", "relation", "tail", "score", "n_evidence", F.array_join("tokens", " | ").alias("matched_tokens")).distinct()
    return top_triples(best, ["head", "relation"], [F.desc("score"), F.asc("tail")], per_pair)


def fuzzy_bridge(unmatched: DataFrame, discovered: DataFrame, least: float = 0.2, k: int = 5) -> DataFrame:
    """seed_head, candidate, score, rank: the k best discovered names of each unmatched head with token overlap >= least.

    Pairs are found by a shared word, or, for names that contain one another, by the first three letters (or all, if
    fewer) of the contained one among the n-grams of the other. Nothing is cross joined.
    """
    a = unmatched.select(F.lower("head").alias("seed_head")).filter("seed_head <> ''").distinct()
    b = discovered.select(F.lower("entity").alias("candidate")).filter("candidate <> ''").distinct()
    wa, wb = a.withColumn("w", F.explode(F.array_distinct(T.tokens(F.col("seed_head"))))), b.withColumn("w", F.explode(F.array_distinct(T.tokens(F.col("candidate")))))
    pairs = wa.join(wb, "w").select("seed_head", "candidate")
    for n in (1, 2, 3):
        length = lambda c: F.length(c) == n if n < 3 else F.length(c) >= 3  # noqa: B023, E731
        inner = b.filter(length("candidate")).withColumn("g", F.substring("candidate", 1, n))
        pairs = pairs.union(a.withColumn("g", F.explode(T.ngram_set(F.col("seed_head"), n))).join(inner, "g").filter(F.contains(F.col("seed_head"), F.col("candidate"))).select("seed_head", "candidate"))
        inner = a.filter(length("seed_head")).withColumn("g", F.substring("seed_head", 1, n))
        pairs = pairs.union(b.withColumn("g", F.explode(T.ngram_set(F.col("candidate"), n))).join(inner, "g").filter(F.contains(F.col("candidate"), F.col("seed_head"))).select("seed_head", "candidate"))
    scored = pairs.distinct().withColumn("score", T.token_overlap(F.col("seed_head"), F.col("candidate"))).filter(F.col("score") >= least)
    order = Window.partitionBy("seed_head").orderBy(F.desc("score"), F.desc("candidate"))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def link_by_ngrams(heads: DataFrame, names: DataFrame, jaccard: float = 0.5, cosine: float = 0.7) -> DataFrame:
    """head, name, jaccard, cosine: pairs above both thresholds (strictly) by their trigrams, best Jaccard per head with ties.

    A pair over the Jaccard threshold shares one of the rarest n - ceil(jaccard x n) + 1 trigrams of either side, in one order of
    rarity, so only those are joined and frequent trigrams hardly meet; the whole sets are then compared.
    """
    grams = lambda df, c: df.select(F.col(c).alias("s")).filter("s IS NOT NULL").distinct().withColumn("g", T.ngram_set(F.lower("s"), 3))
    a, b = materialize(grams(heads, "head"), "grams"), materialize(grams(names, "name"), "grams")
    rare = a.select(F.explode("g").alias("x")).unionAll(b.select(F.explode("g"))).groupBy("x").agg(F.count("*").alias("df"))
    rare = materialize(rare, "grams")

    def prefix(df: DataFrame) -> DataFrame:
        order = df.select("s", F.explode("g").alias("x")).join(rare, "x").groupBy("s").agg(F.array_sort(F.collect_list(F.struct("df", "x"))).alias("o"))
        return order.select("s", F.explode(F.slice("o", 1, F.size("o") - F.ceil(F.lit(jaccard) * F.size("o")).cast("int") + 1)).alias("o")).select("s", F.col("o.x").alias("x"))

    pairs = prefix(a).withColumnRenamed("s", "head").join(prefix(b).withColumnRenamed("s", "name"), "x").select("head", "name").distinct()
    wide = pairs.join(a.select(F.col("s").alias("head"), F.col("g").alias("p")), "head").join(b.select(F.col("s").alias("name"), F.col("g").alias("q")), "name")
    c, n, m = F.size(F.array_intersect("p", "q")), F.size("p"), F.size("q")
    scored = wide.select("head", "name", (c / (n + m - c)).alias("jaccard"), (c / F.sqrt(n.cast("double") * m)).alias("cosine"))
    scored = scored.filter((F.col("jaccard") > jaccard) & (F.col("cosine") > cosine))
    return scored.withColumn("_r", F.rank().over(Window.partitionBy("head").orderBy(F.desc("jaccard")))).filter("_r = 1").drop("_r")


def supported_tails(df: DataFrame, tail: str, predictions: str, source: str, how: str = "strict") -> DataFrame:
    """Rows whose tail tokens are all predicted (strict), predicted or in the source (relaxed), or all but one of more than two (loose)."""
    words = F.array_distinct(T.tokens(F.col(tail)))
    missing = F.array_except(words, T.tokens(F.col(predictions)))
    left = missing if how == "strict" else F.array_except(missing, T.tokens(F.lower(source)))
    ok = F.size(left) == 0
    return df.filter(ok | ((F.size(words) > 2) & (F.size(left) <= 1)) if how == "loose" else ok)
