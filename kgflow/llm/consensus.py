"""Problem 2: one verdict per item from annotators who disagree (competence-and-spamming mixture)."""

from __future__ import annotations

import json
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS, materialize

#: The three verdicts.
VERDICTS = ("maybe", "no", "yes")


def verdict(c: str):
    """A spelled answer as one of VERDICTS; NULL if it says none of them."""
    plain = F.regexp_replace(F.lower(c), r"[^a-z]+", "")
    return F.when(plain.isin(*VERDICTS), plain)


def votes_of(triples: DataFrame, extra: DataFrame) -> DataFrame:
    """item, annotator, label: the two verdict columns as annotators qwen and gpt, and every vote once (by vote_id).

    Of votes delivered twice the earliest loaded answer is taken. A vote without vote_id is a vote of its own. Votes on
    items that triples doesn't hold, by NULL annotators or without an answer are left out. A triple_id delivered twice counts once.
    """
    once = triples.groupBy(F.col("triple_id").alias("item")).agg(F.min("verdict_qwen").alias("qwen"), F.min("verdict_gpt").alias("gpt")).filter("item IS NOT NULL")
    two = once.select("item", F.expr("stack(2, 'qwen', qwen, 'gpt', gpt) as (annotator, said)"))
    rows = extra.select(F.col("triple_id").alias("item"), "annotator", F.col("verdict").alias("said"), "vote_id", "loaded_at")
    known = rows.filter("vote_id IS NOT NULL").groupBy("vote_id").agg(F.min(F.struct("loaded_at", "item", "annotator", "said")).alias("v"))
    many = known.select("v.item", "v.annotator", "v.said").unionByName(rows.filter("vote_id IS NULL").select("item", "annotator", "said"))
    many = many.join(once.select("item"), "item", "left_semi")
    out = two.unionByName(many).select("item", "annotator", verdict("said").alias("label"))
    return out.filter("label IS NOT NULL AND annotator IS NOT NULL")


def _start(counts: np.ndarray, smooth: float) -> tuple[np.ndarray, np.ndarray]:
    """(competences, guesses) to begin with: competence 0.7, guesses as the annotator's answers (a row an annotator, a column a label)."""
    return np.full(len(counts), 0.7), (counts + smooth) / (counts.sum(1, keepdims=True) + counts.shape[1] * smooth)


def _next(own: np.ndarray, counts: np.ndarray, t: np.ndarray, g: np.ndarray, smooth: float) -> tuple[np.ndarray, np.ndarray]:
    """(competences, guesses) of the next round from `own`, the posterior of the label given summed over the annotator's votes."""
    true = own * t[:, None] / (t[:, None] + (1 - t[:, None]) * g)
    spam = counts - true
    return (true.sum(1) + smooth) / (counts.sum(1) + 2 * smooth), (spam + smooth) / (spam.sum(1, keepdims=True) + counts.shape[1] * smooth)


def _weights(t: np.ndarray, g: np.ndarray) -> np.ndarray:
    """What a vote for a label adds to the label's log-posterior: ln((t + (1 - t) g) / ((1 - t) g))."""
    return np.log1p(t[:, None] / ((1 - t[:, None]) * g))


def competence_mixture(votes: DataFrame, labels: tuple[str, ...] = VERDICTS, rounds: int = 60, tolerance: float = 2e-3, smooth: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Expectation-maximisation over votes(item, annotator, label): (items, annotators).

    A label is the item's true label with the annotator's probability `competence`, else a draw from the annotator's own guess
    distribution. items: item, label (posterior mode; of equal ones the first in `labels`), confidence (its posterior),
    agreement (share of the item's vote pairs that agree; 1 for a single vote), n_votes, n_annotators. annotators: annotator,
    competence, n_votes, guess (map label -> probability). Votes given twice count twice; votes with a NULL item, annotator or
    label or another label take no part; an empty table gives two empty tables.

    An item's votes are written once as a ballot, at most one entry an annotator and label. In a round every task computes the posteriors of its
    ballots from the annotators' weights, which are sent along, and adds them up by annotator and label: one
    exchange of at most annotators x labels rows a task, none by item. Beyond BROADCAST_ROWS annotators (whose ballots might be long
    too) votes and parameters stay tables which are joined, and items are aggregated; both ways give the same result.
    """
    known = votes.filter(F.col("label").isin(*labels) & F.col("annotator").isNotNull() & F.col("item").isNotNull())
    per = materialize(known.groupBy("item", "annotator", "label").agg(F.count("*").alias("n")), "votes")
    totals = materialize(per.groupBy("annotator", "label").agg(F.sum("n").alias("n")), "annotators")
    few = totals.select("annotator").distinct().limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    fit = _fit_ballots if few else _fit_tables
    scored, who = fit(per, totals, labels, rounds, tolerance, smooth)

    k = len(labels)
    l, c = [F.col(f"l{i}") for i in range(k)], [F.col(f"c{i}") for i in range(k)]
    top, n = F.greatest(*l), reduce(lambda a, b: a + b, c)
    mode = reduce(lambda found, i: found.when(l[i] == top, labels[i]), range(1, k), F.when(l[0] == top, labels[0]))
    agree = reduce(lambda a, b: a + b, [x * (x - 1) for x in c])
    items = scored.select(
        "item", mode.alias("label"), (1 / reduce(lambda a, b: a + b, [F.exp(x - top) for x in l])).alias("confidence"),
        F.when(n > 1, agree / (n * (n - 1))).otherwise(1.0).alias("agreement"), n.alias("n_votes"), "n_annotators",
    )
    return items, who


def _prior(mass: np.ndarray) -> np.ndarray:
    return (mass + 1) / (mass.sum() + len(mass))


def _fit_ballots(per: DataFrame, totals: DataFrame, labels: tuple[str, ...], rounds: int, tolerance: float, smooth: float) -> tuple[DataFrame, DataFrame]:
    """(items with l0.., c0.., n_annotators; annotators) with a bounded number of annotators, whose parameters are kept on the driver."""
    spark, k = per.sparkSession, len(labels)
    names = sorted({r.annotator for r in totals.select("annotator").distinct().collect()})
    at = {a: i for i, a in enumerate(names)}
    counts = np.zeros((len(names), k))
    for r in totals.collect():
        counts[at[r.annotator], labels.index(r.label)] = r.n
    number = F.broadcast(spark.createDataFrame([(a, x, at[a] * k + j) for a in names for j, x in enumerate(labels)], f"annotator {dict(per.dtypes)['annotator']}, label string, code int"))
    # entries are sorted, so sums don't depend on the order of arrival
    ballots = per.join(number, ["annotator", "label"]).groupBy("item").agg(F.array_sort(F.collect_list(F.struct("code", "n"))).alias("ballot"))
    ballots = materialize(ballots, "ballots")

    def scored(w: np.ndarray, prior: np.ndarray) -> DataFrame:
        """ballots with l0..lk-1, the labels' log-posteriors (up to a constant)."""
        every = F.from_json(F.lit(json.dumps(w.ravel().tolist())), "array<double>")  # folded into one literal that travels with the plan
        of = lambda i: F.aggregate("ballot", F.lit(float(np.log(prior[i]))), lambda a, v: a + F.when(v["code"] % k == i, v["n"] * F.get(every, v["code"])).otherwise(0.0))
        return ballots.select("item", "ballot", *[of(i).alias(f"l{i}") for i in range(k)])

    t, g = _start(counts, smooth)
    prior = _prior(counts.sum(0))
    for _ in range(rounds if len(names) else 0):
        s = scored(_weights(t, g), prior)
        top = F.greatest(*[F.col(f"l{i}") for i in range(k)])
        s = s.select("ballot", *[F.exp(F.col(f"l{i}") - top).alias(f"e{i}") for i in range(k)])
        norm = reduce(lambda a, b: a + b, [F.col(f"e{i}") for i in range(k)])
        q = F.array(*[F.col(f"e{i}") / norm for i in range(k)])
        votes = s.select(q.alias("q"), F.explode("ballot").alias("v")).select(F.col("v.code").alias("code"), "v.n", "q")
        sums = votes.groupBy("code").agg(*[F.sum(F.col("n") * F.get("q", F.lit(i))).alias(f"p{i}") for i in range(k)]).toPandas()
        full = np.zeros((len(names) * k, k))
        full[sums["code"].to_numpy(dtype=int)] = sums[[f"p{i}" for i in range(k)]].to_numpy(dtype=float)
        own = full[np.arange(len(full)), np.arange(len(full)) % k].reshape(-1, k)
        before = t
        t, g = _next(own, counts, t, g, smooth)
        prior = _prior(full.sum(0))
        if np.abs(t - before).max() < tolerance:
            break
    given = lambda i: F.aggregate("ballot", F.lit(0).cast("long"), lambda a, v: a + F.when(v["code"] % k == i, v["n"]).otherwise(F.lit(0).cast("long")))
    items = scored(_weights(t, g), prior)
    items = items.select(
        "item", *[f"l{i}" for i in range(k)], *[given(i).alias(f"c{i}") for i in range(k)],
        F.size(F.array_distinct(F.transform("ballot", lambda v: F.floor(v["code"] / k)))).alias("n_annotators"),
    )
    rows = [(a, float(t[i]), int(counts[i].sum()), {x: float(g[i, j]) for j, x in enumerate(labels)}) for i, a in enumerate(names)]
    return items, spark.createDataFrame(rows, f"annotator {dict(per.dtypes)['annotator']}, competence double, n_votes long, guess map<string,double>")


def _fit_tables(per: DataFrame, totals: DataFrame, labels: tuple[str, ...], rounds: int, tolerance: float, smooth: float) -> tuple[DataFrame, DataFrame]:
    """As _fit_ballots for any number of annotators: parameters are a row an annotator, all sums are aggregations."""
    k = len(labels)
    count = lambda df: [F.coalesce(F.sum(F.when(F.col("label") == x, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, x in enumerate(labels)]
    base = materialize(totals.groupBy("annotator").agg(F.sum("n").alias("n_votes"), *count(totals)), "annotators")
    params = base.select("*", F.lit(0.7).alias("t"), *[((F.col(f"n{i}") + smooth) / (F.col("n_votes") + k * smooth)).alias(f"g{i}") for i in range(k)])
    mass = base.agg(*[F.sum(f"n{i}") for i in range(k)]).first()
    prior = _prior(np.array([float(x) for x in mass]))

    def scored(params: DataFrame, prior: np.ndarray) -> DataFrame:
        w = lambda i: F.log1p(F.col("t") / ((1 - F.col("t")) * F.col(f"g{i}")))
        rows = per.join(params, "annotator")
        own = [F.sum(F.when(F.col("label") == x, F.col("n") * w(i)).otherwise(0.0)) + float(np.log(prior[i])) for i, x in enumerate(labels)]
        given = [F.sum(F.when(F.col("label") == x, F.col("n")).otherwise(0)) for x in labels]
        return rows.groupBy("item").agg(*[x.alias(f"l{i}") for i, x in enumerate(own)], *[x.alias(f"c{i}") for i, x in enumerate(given)], F.count_distinct("annotator").alias("n_annotators"))

    for _ in range(rounds):
        top = F.greatest(*[F.col(f"l{i}") for i in range(k)])
        e = [F.exp(F.col(f"l{i}") - top) for i in range(k)]
        norm = reduce(lambda a, b: a + b, e)
        q = scored(params, prior).select("item", *[(x / norm).alias(f"q{i}") for i, x in enumerate(e)])
        votes = per.join(q, "item")
        sums = votes.groupBy("annotator").agg(
            *[F.sum(F.when(F.col("label") == x, F.col("n") * F.col(f"q{i}")).otherwise(0.0)).alias(f"o{i}") for i, x in enumerate(labels)], *[F.sum(F.col("n") * F.col(f"q{i}")).alias(f"p{i}") for i in range(k)]
        )
        t = F.col("t")
        true = [F.col(f"o{i}") * t / (t + (1 - t) * F.col(f"g{i}")) for i in range(k)]
        spam = [F.col(f"n{i}") - x for i, x in enumerate(true)]
        every = reduce(lambda a, b: a + b, spam)
        new = params.join(sums, "annotator").select(
            "annotator", "n_votes", *[f"n{i}" for i in range(k)], F.abs((reduce(lambda a, b: a + b, true) + smooth) / (F.col("n_votes") + 2 * smooth) - t).alias("moved"),
            ((reduce(lambda a, b: a + b, true) + smooth) / (F.col("n_votes") + 2 * smooth)).alias("t"),
            *[((x + smooth) / (every + k * smooth)).alias(f"g{i}") for i, x in enumerate(spam)], *[f"p{i}" for i in range(k)],
        )
        new = materialize(new, "annotators")
        step = new.agg(F.max("moved").alias("moved"), *[F.sum(f"p{i}").alias(f"p{i}") for i in range(k)]).first()
        params = new.drop("moved", *[f"p{i}" for i in range(k)])
        if step.moved is None:
            break
        prior = _prior(np.array([step[f"p{i}"] for i in range(k)]))
        if step.moved < tolerance:
            break
    guess = F.map_from_arrays(F.array(*[F.lit(x) for x in labels]), F.array(*[F.col(f"g{i}") for i in range(k)]))
    return scored(params, prior), params.select("annotator", F.col("t").alias("competence"), "n_votes", guess.alias("guess"))
