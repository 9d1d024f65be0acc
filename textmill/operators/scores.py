"""Summaries of scores, tokens and finish reasons (E06 to E13, E20, E35, E47, E48, E50, C and B columns beside them)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmill.functions.columns import pearson
from textmill.operators.views import LATEST, RECORDS, records, scored
from textmill.plans.registry import query

R = lambda c: F.round(c, 6)


@query(
    "e06_scores",
    f"WITH {LATEST} SELECT count(*) AS n, round(avg(quality_score), 6) AS mean, round(quantile_cont(quality_score, 0.5), 6) AS median, round(stddev_pop(quality_score), 6) AS sd, min(quality_score) AS least, max(quality_score) AS most, round(avg(CASE WHEN quality_score = 1 THEN 1.0 ELSE 0 END), 6) AS ceiling_rate FROM scored",
)
def e06(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("quality_score")
    return scored(spark, sf_dir).agg(F.count("*").alias("n"), R(F.avg(q)).alias("mean"), R(F.percentile(q, 0.5)).alias("median"), R(F.stddev_pop(q)).alias("sd"), F.min(q).alias("least"), F.max(q).alias("most"), R(F.avg((q == 1).cast("double"))).alias("ceiling_rate"))


@query("e06_histogram", f"WITH {LATEST} SELECT quality_score, count(*) AS n FROM scored GROUP BY quality_score")
def e06h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).groupBy("quality_score").agg(F.count("*").alias("n"))


@query(
    "e07_within_prompt",
    f"WITH {LATEST}, p AS (SELECT max(quality_score) - min(quality_score) AS r, count(DISTINCT quality_score) AS k FROM scored GROUP BY prompt_id) SELECT round(avg(r), 6) AS mean_range, round(avg(k), 6) AS mean_distinct FROM p",
)
def e07(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = scored(spark, sf_dir).groupBy("prompt_id").agg((F.max("quality_score") - F.min("quality_score")).alias("r"), F.count_distinct("quality_score").alias("k"))
    return by.agg(R(F.avg("r")).alias("mean_range"), R(F.avg("k")).alias("mean_distinct"))


@query(
    "e09_correlation",
    f"""WITH {LATEST}, x AS (SELECT prompt_id, quality_score AS q, length(text) * 1.0 AS n, quality_score - avg(quality_score) OVER (PARTITION BY prompt_id) AS dq, length(text) - avg(length(text)) OVER (PARTITION BY prompt_id) AS dn FROM scored)
    SELECT round(corr(q, n), 6) AS pearson, round(corr(dq, dn), 6) AS centred_pearson FROM x""",
)
def e09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all samples, and with each prompt's means taken off. Means come by aggregation and a join, so a large prompt isn't sorted in one task."""
    x = scored(spark, sf_dir).select("prompt_id", F.col("quality_score").alias("q"), F.length("text").cast("double").alias("n"))
    means = x.groupBy("prompt_id").agg(F.avg("q").alias("mq"), F.avg("n").alias("mn"))
    y = x.join(means, "prompt_id").withColumns({"dq": F.col("q") - F.col("mq"), "dn": F.col("n") - F.col("mn")})

    def r(a: str, b: str) -> F.Column:
        a, b = F.col(a), F.col(b)
        return R(pearson(F.count("*"), F.sum(a), F.sum(b), F.sum(a * a), F.sum(b * b), F.sum(a * b)))

    return y.agg(r("q", "n").alias("pearson"), r("dq", "dn").alias("centred_pearson"))


@query(
    "e10_finish",
    f"WITH {RECORDS} SELECT model, coalesce(finish_reason, 'unknown') AS finish_reason, count(*) AS n, round(avg(completion_tokens), 6) AS mean_tokens, quantile_cont(completion_tokens, 0.5) AS median_tokens, max(completion_tokens) AS most_tokens FROM records GROUP BY ALL",
)
def e10(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("completion_tokens")
    by = records(spark, sf_dir).groupBy("model", F.coalesce("finish_reason", F.lit("unknown")).alias("finish_reason"))
    return by.agg(F.count("*").alias("n"), R(F.avg(t)).alias("mean_tokens"), F.percentile(t, 0.5).alias("median_tokens"), F.max(t).alias("most_tokens"))


@query(
    "e10_length_rate",
    f"WITH {RECORDS} SELECT model, round(avg(CASE WHEN finish_reason = 'length' THEN 1.0 ELSE 0 END), 6) AS length_rate FROM records WHERE finish_reason IS NOT NULL GROUP BY model",
)
def e10r(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).where("finish_reason IS NOT NULL").groupBy("model").agg(R(F.avg((F.col("finish_reason") == "length").cast("double"))).alias("length_rate"))


@query(
    "e12_profile",
    f"""WITH {RECORDS} SELECT model, count(*) AS n, round(avg(completion_tokens), 6) AS mean, round(stddev_pop(completion_tokens), 6) AS sd, round(quantile_cont(completion_tokens, 0.05), 6) AS p05, round(quantile_cont(completion_tokens, 0.25), 6) AS p25,
    round(quantile_cont(completion_tokens, 0.5), 6) AS p50, round(quantile_cont(completion_tokens, 0.75), 6) AS p75, round(quantile_cont(completion_tokens, 0.95), 6) AS p95 FROM records WHERE completion_tokens IS NOT NULL GROUP BY model""",
)
def e12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A distribution's profile with linearly interpolated quantiles."""
    t = F.col("completion_tokens")
    cols = [R(F.percentile(t, p)).alias(f"p{int(p * 100):02d}") for p in (0.05, 0.25, 0.5, 0.75, 0.95)]
    return records(spark, sf_dir).where(t.isNotNull()).groupBy("model").agg(F.count("*").alias("n"), R(F.avg(t)).alias("mean"), R(F.stddev_pop(t)).alias("sd"), *cols)


@query(
    "e20_repeats",
    f"WITH {RECORDS}, p AS (SELECT config_hash, prompt_id, count(*) AS n, count(DISTINCT text) AS k FROM records WHERE text IS NOT NULL GROUP BY ALL) SELECT config_hash, count(*) FILTER (k < n) AS with_repeats, round(avg(k), 6) AS mean_unique, min(k) AS least_unique FROM p GROUP BY config_hash",
)
def e20(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = records(spark, sf_dir).where("text IS NOT NULL").groupBy("config_hash", "prompt_id").agg(F.count("*").alias("n"), F.count_distinct("text").alias("k"))
    return by.groupBy("config_hash").agg(F.count_if(F.col("k") < F.col("n")).alias("with_repeats"), R(F.avg("k")).alias("mean_unique"), F.min("k").alias("least_unique"))


@query(
    "e47_lengths",
    """WITH t AS (SELECT source, length(text) AS n FROM documents WHERE text IS NOT NULL)
    SELECT coalesce(lower(trim(source)), 'unknown') AS source, count(*) AS n, round(avg(n), 6) AS mean, round(quantile_cont(n, 0.5), 6) AS median, round(quantile_cont(n, 0.95), 6) AS p95, max(n) AS most,
    count(*) FILTER (n > 2000) AS over_limit, round(avg(CASE WHEN n > 2000 THEN 1.0 ELSE 0 END), 6) AS over_rate, sum(greatest(n - 2000, 0)) AS over_sum FROM t GROUP BY 1""",
)
def e47(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of documents by source and what exceeds a limit of 2,000."""
    from textmill.lineage import table

    n, over = F.col("n"), F.col("n") > 2000
    t = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.coalesce(F.lower(F.trim("source")), F.lit("unknown")).alias("source"), F.length("text").alias("n"))
    return t.groupBy("source").agg(F.count("*").alias("n"), R(F.avg(n)).alias("mean"), R(F.percentile(n, 0.5)).alias("median"), R(F.percentile(n, 0.95)).alias("p95"), F.max(n).cast("bigint").alias("most"), F.count_if(over).alias("over_limit"), R(F.avg(over.cast("double"))).alias("over_rate"), F.sum(F.greatest(n - 2000, F.lit(0))).cast("double").alias("over_sum"))


@query(
    "e50_gate",
    f"""WITH {LATEST}, p AS (SELECT prompt_id, count(DISTINCT quality_score) AS k, max(quality_score) - min(quality_score) AS r FROM scored GROUP BY prompt_id), a AS (SELECT avg(k) AS k, avg(r) AS r FROM p), c AS (SELECT avg(CASE WHEN quality_score = 1 THEN 1.0 ELSE 0 END) AS c FROM scored)
    SELECT round(k, 6) AS mean_distinct, round(r, 6) AS mean_range, round(c, 6) AS ceiling_rate, k >= 2 AND r >= 0.1 AND c <= 0.5 AS passed FROM a, c""",
)
def e50(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether scores tell samples apart: distinct scores and range within a prompt, and the share at the ceiling."""
    by = scored(spark, sf_dir).groupBy("prompt_id").agg(F.count_distinct("quality_score").alias("k"), (F.max("quality_score") - F.min("quality_score")).alias("r"), F.count("*").alias("n"), F.count_if(F.col("quality_score") == 1).alias("top"))
    a = by.agg(F.avg("k").alias("k"), F.avg("r").alias("r"), (F.sum("top") / F.sum("n")).alias("c"))
    return a.select(R("k").alias("mean_distinct"), R("r").alias("mean_range"), R("c").alias("ceiling_rate"), ((F.col("k") >= 2) & (F.col("r") >= 0.1) & (F.col("c") <= 0.5)).alias("passed"))


@query(
    "e13_seed_spread",
    f"""WITH {RECORDS}, m AS (SELECT r.model, s.seed, avg(r.completion_tokens) AS v FROM records r JOIN generation_specs s USING (config_hash) WHERE r.completion_tokens IS NOT NULL GROUP BY ALL)
    SELECT model, count(*) AS seeds, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0), 6) AS sd FROM m GROUP BY model""",
)
def e13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean by model and seed, then mean and sample deviation over seeds (0 for one seed)."""
    from textmill.lineage import table

    by = records(spark, sf_dir).where("completion_tokens IS NOT NULL").join(table(spark, sf_dir, "generation_specs").select("config_hash", "seed"), "config_hash").groupBy("model", "seed").agg(F.avg("completion_tokens").alias("v"))
    return by.groupBy("model").agg(F.count("*").alias("seeds"), R(F.avg("v")).alias("mean"), R(F.coalesce(F.stddev_samp("v"), F.lit(0.0))).alias("sd"))


@query(
    "g_running_best",
    f"WITH {LATEST} SELECT prompt_id, sample_index, max(quality_score) OVER (PARTITION BY prompt_id ORDER BY sample_index) AS best_so_far FROM scored",
)
def running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G: the best score of each prompt up to each sample."""
    return scored(spark, sf_dir).select("prompt_id", "sample_index", F.max("quality_score").over(Window.partitionBy("prompt_id").orderBy("sample_index")).alias("best_so_far"))
