"""Scores of triples and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def verdict_distribution(df: DataFrame, verdict: str, group: list[str] = []) -> DataFrame:
    share = lambda v: F.round(F.avg(F.when(F.col(verdict) == v, 1.0).otherwise(0.0)), 3).alias(f"{v}_share")
    return df.groupBy(*group).agg(F.count("*").alias("n"), share("yes"), share("maybe"), share("no"))


def fact_score(df: DataFrame, key: list[str], accepted: str, group: list[str] = []) -> DataFrame:
    """Accepted distinct keys over all distinct keys."""
    k = F.struct(*key)
    yes, every = F.count_distinct(F.when(F.col(accepted) == "yes", k)), F.count_distinct(k)
    return df.groupBy(*group).agg(every.alias("triples"), yes.alias("accepted"), F.round(yes / every, 6).alias("fact_score"))


def accuracy(truth: DataFrame, answers: DataFrame, key: list[str], level: str) -> DataFrame:
    """seed, level (NULL: all), accuracy: every truth counts for every seed; a missing answer is wrong.

    Right answers are counted by seed and level, truths by level; only these small tables meet, not truths and seeds.
    """
    hit = truth.join(answers.select(*key, "seed", "said"), key).filter(F.col("said") == F.col("answer"))
    hits = hit.groupBy("seed", level).agg(F.count("*").alias("_h"))
    cells = answers.select("seed").distinct().crossJoin(F.broadcast(truth.groupBy(level).agg(F.count("*").alias("_n"))))
    out = cells.join(hits.withColumnRenamed(level, "_l"), (cells["seed"] == hits["seed"]) & cells[level].eqNullSafe(F.col("_l")), "left").select(cells["seed"], level, F.coalesce("_h", F.lit(0)).alias("_h"), "_n")
    return out.rollup("seed", level).agg(F.sum("_h").alias("_h"), F.sum("_n").alias("_n"), F.grouping("seed").alias("_g")).filter("_g = 0").select("seed", level, (F.col("_h") / F.col("_n")).alias("accuracy"))


def best_epochs(log: DataFrame) -> DataFrame:
    """Of a trainer's log (epoch, loss, eval_loss, eval_accuracy) the epochs of least losses and greatest accuracy, and their values; the first of equal ones."""
    at = lambda c, sign: F.min(F.when(F.col(c).isNotNull(), F.struct((sign * F.col(c)).alias("v"), "epoch")))
    out = log.agg(at("loss", 1).alias("a"), at("eval_loss", 1).alias("b"), at("eval_accuracy", -1).alias("c"))
    return out.select(F.col("a.epoch").alias("loss_epoch"), F.col("a.v").alias("loss"), F.col("b.epoch").alias("eval_loss_epoch"), F.col("b.v").alias("eval_loss"), F.col("c.epoch").alias("accuracy_epoch"), (-F.col("c.v")).alias("accuracy"))


def usage(calls: DataFrame, category: str = "category") -> DataFrame:
    """category (NULL: all), llm_calls, prompt_tokens, output_tokens summed over calls; NULL counts are 0."""
    total = [F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in ("llm_calls", "prompt_tokens", "output_tokens")]
    return calls.filter(F.col(category).isNotNull()).rollup(category).agg(*total)


def over_seeds(acc: DataFrame, level: str) -> DataFrame:
    """Mean and sample variance over the seeds."""
    return acc.groupBy(level).agg(F.round(F.avg("accuracy"), 6).alias("mean"), F.round(F.var_samp("accuracy"), 6).alias("variance"))


def majority(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Most frequent value of each group, the least of equally frequent ones. Counted first, so a hot group combines on the map side."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_n"))
    return counts.groupBy(*group).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v"))).alias("m")).select(*group, F.col("m.v").alias("majority"), (-F.col("m.n")).alias("votes"))


def masked_accuracy(df: DataFrame, label: str, said: str, ignore: int = -100) -> DataFrame:
    return df.filter(F.col(label) != ignore).agg(F.avg(F.when(F.col(label) == F.col(said), 1.0).otherwise(0.0)).alias("accuracy"))


def perplexity(df: DataFrame, loss: str) -> DataFrame:
    return df.agg(F.exp(F.avg(loss)).alias("perplexity"))


def token_logprobs(df: DataFrame, key: list[str], prob: str) -> DataFrame:
    """key, score (sum of ln(prob + 1e-12), unweighted), tokens; NULL probabilities are left out."""
    return df.filter(F.col(prob).isNotNull()).groupBy(*key).agg(F.sum(F.log(F.col(prob) + 1e-12)).alias("score"), F.count("*").alias("tokens"))
