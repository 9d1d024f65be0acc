"""Consensus of annotators by confidence-aware truth discovery (problem 4).

A rater's weight is the inverse of an upper bound on the variance of their error: with n answers and summed squared distance e
from the consensus, e divided by the alpha/2 quantile of the chi-squared distribution with n degrees of freedom. A rater of few answers has a
wide interval and so a low weight, however well they did. Weights and consensus alternate until they stand still.
"""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.lineage import only, settle, table

#: Level of the interval; rounds at most, and the relative change of the weights at which they end.
ALPHA, ROUNDS, STILL = 0.05, 30, 2e-3


def gamma_share(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function, by its series or its continued fraction."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-15 * abs(total):
            n += 1
            term *= x / n
            total += term
        return total * front
    b, tiny = x + 1 - a, 1e-300
    c, d = 1 / tiny, 1 / b
    h, i = d, 0
    while True:
        i += 1
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-14 or i > 10_000:
            return 1 - front * h


@lru_cache(100_000)
def chi_squared(p: float, n: int) -> float:
    """The quantile p of the chi-squared distribution with n degrees of freedom, by bisection."""
    low, high = 0.0, n + 20 * math.sqrt(2 * n) + 40
    for _ in range(200):
        mid = (low + high) / 2
        if gamma_share(n / 2, mid / 2) < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def votes(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """blind_id (of the original), rater_id, y (1.0 equivalent, 0.0 not), c: each rater's latest answer to each blind_id, repeats taken to their original.

    Spelling, case and white space of labels don't matter; other labels take no side. c is the weight of the answer in its rater's own eyes: 0.6, 0.8 or 1 for a
    confidence of 1, 2 or 3, else 0.8. Of two answers at one time the greater counts. Answers to a blind_id that isn't in pairs, or whose rater is null, don't count."""
    said = F.regexp_replace(F.trim(F.regexp_replace(F.lower("label"), r"[\s_-]+", " ")), " ", "_")
    y = F.when(said == "equivalent", 1.0).when(said == "not_equivalent", 0.0)
    c = F.when(F.col("confidence").isin(1, 2, 3), 0.4 + 0.2 * F.col("confidence")).otherwise(0.8)
    rows = only(labels, "blind_id", "rater_id", "label", "confidence", "submitted_at").where("rater_id IS NOT NULL")
    latest = rows.groupBy("blind_id", "rater_id").agg(F.max(F.struct("submitted_at", y.alias("y"), c.alias("c"))).alias("x")).where("x.y IS NOT NULL")
    of = originals(pairs).select("blind_id", "original").distinct()
    return latest.join(of, "blind_id").select(F.col("original").alias("blind_id"), "rater_id", "x.y", "x.c")


def originals(pairs: DataFrame) -> DataFrame:
    rows = only(pairs, "blind_id", "repeat_of").where("blind_id IS NOT NULL")
    again = F.trim(F.coalesce("repeat_of", F.lit("")))
    return rows.select("blind_id", F.when(again == "", F.col("blind_id")).otherwise(again).alias("original"), (again == "").alias("first"))


def discovered(said: DataFrame, alpha: float = ALPHA, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Consensus (blind_id, t from 0 to 1, n_votes, agreement) and raters (rater_id, n, error, bound, weight, against).

    against: the rater's answers stand nearer to the consensus when taken the other way round, and are taken so. All raters begin with one weight.
    Both tables are joined as tables, so neither the number of items nor that of raters is bounded."""
    quantile = F.pandas_udf(lambda n: n.map(lambda k: chi_squared(alpha / 2, int(k))).astype("float64"), "double")
    said = settle(said.repartition("blind_id"))
    weights = said.groupBy("rater_id").agg(F.count("*").alias("n")).select("rater_id", F.lit(1.0).alias("weight"), F.lit(False).alias("against"))

    def agreed(weights: DataFrame) -> DataFrame:
        w = F.col("c") * F.col("weight")
        z = F.when(F.col("against"), 1 - F.col("y")).otherwise(F.col("y"))
        return said.join(weights.select("rater_id", "weight", "against"), "rater_id").groupBy("blind_id").agg((F.sum(w * z) / F.sum(w)).alias("t"))

    for _ in range(rounds):
        near = said.join(agreed(weights), "blind_id")
        by = near.groupBy("rater_id").agg(F.count("*").alias("n"), F.sum(F.col("c") * (F.col("y") - F.col("t")) ** 2).alias("e"), F.sum(F.col("c") * (1 - F.col("y") - F.col("t")) ** 2).alias("g"))
        # As if each rater had erred by half an answer more, so that one who never differs has a finite weight.
        error = F.least("e", "g") + 0.5
        new = by.select("rater_id", "n", error.alias("error"), (error / quantile("n")).alias("bound"), (F.col("g") < F.col("e")).alias("against")).withColumn("weight", 1 / F.col("bound"))
        new = settle(new)
        moved = new.join(weights.select("rater_id", F.col("weight").alias("old")), "rater_id").agg(F.max(F.abs(F.col("weight") / F.col("old") - 1))).first()[0]
        weights = new
        if moved is None or moved < STILL:
            break
    side = F.col("t") > 0.5
    share = F.avg(F.when(F.col("y") == side.cast("double"), 1.0).otherwise(0.0)).alias("agreement")
    found = said.join(agreed(weights), "blind_id").groupBy("blind_id", "t").agg(F.count("*").alias("n_votes"), share)
    return found, weights


def consensus(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """blind_id, label, t, n_votes, agreement of each original pair, once. agreement: the share of its answers that give its label, null without answers.

    A pair that no answer takes a side on gets the label that most pairs have; a tie (t = 0.5) is not_equivalent."""
    found, _ = discovered(votes(pairs, labels))
    found = settle(found)
    most = found.agg((F.avg((F.col("t") > 0.5).cast("double")) > 0.5).alias("most"))
    all_of = originals(pairs).where("first").select("blind_id").distinct().join(found, "blind_id", "left").crossJoin(F.broadcast(most))  # most is one row
    yes = F.coalesce(F.col("t") > 0.5, "most", F.lit(False))
    return all_of.select("blind_id", F.when(yes, "equivalent").otherwise("not_equivalent").alias("label"), "t", F.coalesce("n_votes", F.lit(0)).alias("n_votes"), "agreement")


def tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "semantic_pairs"), table(spark, sf_dir, "equivalence_labels")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus(*tables(spark, sf_dir)).select("blind_id", "label")


def p4_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus(*tables(spark, sf_dir)).select("blind_id", "label", F.round("agreement", 6).alias("agreement"), "n_votes")


def p4_raters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rater_id, answers, error_bound (upper bound of the variance of the error), weight (the weights sum to 1), against."""
    _, raters = discovered(votes(*tables(spark, sf_dir)))
    total = raters.agg(F.sum("weight").alias("total"))
    return raters.crossJoin(F.broadcast(total)).select("rater_id", F.col("n").alias("answers"), F.round("bound", 6).alias("error_bound"), F.round(F.col("weight") / F.col("total"), 6).alias("weight"), "against")
