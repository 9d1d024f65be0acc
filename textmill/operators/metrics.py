"""The cube of metrics by method, seed and prompt, contrasts between methods and their stability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmill.lineage import table
from textmill.operators.views import RECORDS, records
from textmill.plans.registry import query

R = lambda c: F.round(c, 6)
#: Critical values of Student's t for a 95 % interval by degrees of freedom 1 to 10 (fixed values), beyond that 1.96.
STUDENT = [12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228]
BASE = "orla-7b-chat"
THRESHOLDS = (100, 150, 200, 250)
CUBE = f"""{RECORDS}, cube AS (
  SELECT r.model AS method, s.seed, r.prompt_id, u.metric, avg(u.value) AS value
  FROM records r JOIN generation_specs s USING (config_hash), LATERAL (VALUES ('chars', CAST(length(r.text) AS DOUBLE)), ('tokens', CAST(r.completion_tokens AS DOUBLE))) u(metric, value)
  WHERE u.value IS NOT NULL GROUP BY ALL
), flat AS (SELECT method, prompt_id, metric, avg(value) AS value FROM cube GROUP BY ALL)"""
TCUBE = f"""{CUBE}, tcube AS (SELECT method, prompt_id, t.threshold, avg(CASE WHEN value >= t.threshold THEN 1.0 ELSE 0.0 END) AS value FROM cube, (VALUES (100), (150), (200), (250)) t(threshold) WHERE metric = 'tokens' GROUP BY ALL)"""
PAIRS = f"""{CUBE}, pairs AS (SELECT t.method, t.metric, t.prompt_id, t.value - b.value AS d, b.value AS b, t.value AS t FROM flat t JOIN flat b USING (prompt_id, metric) WHERE b.method = '{BASE}' AND t.method <> '{BASE}')"""


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """method, seed, prompt_id, metric, value: B20's long form, the mean over a prompt's samples."""
    specs = table(spark, sf_dir, "generation_specs").select("config_hash", "seed")
    rows = records(spark, sf_dir).join(specs, "config_hash").select(F.col("model").alias("method"), "seed", "prompt_id", F.length("text").cast("double").alias("chars"), F.col("completion_tokens").cast("double").alias("tokens"))
    long = rows.unpivot(["method", "seed", "prompt_id"], ["chars", "tokens"], "metric", "value").where("value IS NOT NULL")
    return long.groupBy("method", "seed", "prompt_id", "metric").agg(F.avg("value").alias("value"))


def over_seeds(rows: DataFrame) -> DataFrame:
    """The mean over seeds of each method, prompt and metric."""
    return rows.groupBy("method", "prompt_id", "metric").agg(F.avg("value").alias("value"))


def at_thresholds(rows: DataFrame) -> DataFrame:
    """For each threshold whether a prompt's tokens reach it, as a mean over seeds."""
    t = F.explode(F.array(*map(F.lit, THRESHOLDS))).alias("threshold")
    return rows.where("metric = 'tokens'").select("method", "prompt_id", "value", t).groupBy("method", "prompt_id", "threshold").agg(F.avg((F.col("value") >= F.col("threshold")).cast("double")).alias("value"))


def paired(rows: DataFrame, base: str = BASE) -> DataFrame:
    """Each method's value beside the base method's on the same prompt, and the difference d."""
    b = rows.where(F.col("method") == base).select("prompt_id", "metric", F.col("value").alias("b"))
    return rows.where(F.col("method") != base).join(b, ["prompt_id", "metric"]).select("method", "metric", "prompt_id", "b", F.col("value").alias("t"), (F.col("value") - F.col("b")).alias("d"))


def sign_of(d: Column) -> Column:
    return F.when(d > 1e-12, "up").when(d < -1e-12, "down").otherwise("tied")


@query("e01_methods", f"WITH {CUBE} SELECT method, metric, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median FROM flat GROUP BY ALL")
def e01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over_seeds(cube(spark, sf_dir)).groupBy("method", "metric").agg(F.count("*").alias("n"), R(F.avg("value")).alias("mean"), R(F.percentile("value", 0.5)).alias("median"))


@query("e02_prompts", f"WITH {CUBE} SELECT method, prompt_id, metric, round(value, 6) AS value FROM flat")
def e02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return over_seeds(cube(spark, sf_dir)).withColumn("value", R("value"))


@query("e03_thresholds", f"WITH {TCUBE} SELECT method, prompt_id, threshold, round(value, 6) AS value FROM tcube")
def e03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return at_thresholds(cube(spark, sf_dir)).withColumn("value", R("value"))


@query("e04_seeds", f"WITH {CUBE} SELECT method, seed, metric, count(*) AS prompts, round(avg(value), 6) AS mean FROM cube GROUP BY ALL")
def e04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube(spark, sf_dir).groupBy("method", "seed", "metric").agg(F.count("*").alias("prompts"), R(F.avg("value")).alias("mean"))


@query("e05_sensitivity", f"WITH {TCUBE} SELECT threshold, round(avg(value), 6) AS mean FROM tcube GROUP BY threshold")
def e05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return at_thresholds(cube(spark, sf_dir)).groupBy("threshold").agg(R(F.avg("value")).alias("mean"))


@query("e14_curves", f"WITH {TCUBE} SELECT method, threshold, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS sd FROM tcube GROUP BY ALL")
def e14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return at_thresholds(cube(spark, sf_dir)).groupBy("method", "threshold").agg(R(F.avg("value")).alias("mean"), R(F.coalesce(F.stddev_samp("value"), F.lit(0.0))).alias("sd"))


@query(
    "e15_stability",
    f"""WITH {PAIRS} SELECT method, metric, count(*) AS n, round(avg(d), 6) AS mean_difference, count(*) FILTER (d > 1e-12) AS up, count(*) FILTER (d < -1e-12) AS down, count(*) FILTER (abs(d) <= 1e-12) AS tied,
    round(min(d), 6) AS least, round(max(d), 6) AS most, round(CASE WHEN count(*) > 1 AND stddev_samp(d) > 0 THEN avg(d) / stddev_samp(d) END, 6) AS dz FROM pairs GROUP BY ALL""",
)
def e15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences from the base method on shared prompts; dz is the mean over the sample deviation."""
    by, s = paired(over_seeds(cube(spark, sf_dir))).groupBy("method", "metric"), sign_of(F.col("d"))
    sd = F.stddev_samp("d")
    return by.agg(F.count("*").alias("n"), R(F.avg("d")).alias("mean_difference"), *(F.count_if(s == x).alias(x) for x in ("up", "down", "tied")), R(F.min("d")).alias("least"), R(F.max("d")).alias("most"), R(F.when(sd > 0, F.avg("d") / sd)).alias("dz"))


@query(
    "e16_directions",
    f"""WITH {TCUBE}, p AS (SELECT t.method, t.threshold, t.value - b.value AS d FROM tcube t JOIN tcube b USING (prompt_id, threshold) WHERE b.method = '{BASE}' AND t.method <> '{BASE}'),
    m AS (SELECT method, threshold, avg(d) AS m, count(*) FILTER (d > 1e-12) AS up, count(*) FILTER (d < -1e-12) AS down, count(*) FILTER (abs(d) <= 1e-12) AS tied FROM p GROUP BY ALL),
    x AS (SELECT *, CASE WHEN m > 1e-12 THEN 'up' WHEN m < -1e-12 THEN 'down' ELSE 'tied' END AS way FROM m)
    SELECT method, CAST(sum(up) AS BIGINT) AS up, CAST(sum(down) AS BIGINT) AS down, CAST(sum(tied) AS BIGINT) AS tied, CASE WHEN count(DISTINCT way) = 1 THEN min(way) ELSE 'mixed' END AS direction FROM x GROUP BY method""",
)
def e16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per threshold who gains, and whether the mean points one way at all thresholds."""
    rows = at_thresholds(cube(spark, sf_dir))
    b = rows.where(F.col("method") == BASE).select("prompt_id", "threshold", F.col("value").alias("b"))
    p = rows.where(F.col("method") != BASE).join(b, ["prompt_id", "threshold"]).withColumn("d", F.col("value") - F.col("b"))
    by = p.groupBy("method", "threshold").agg(F.avg("d").alias("m"), *(F.count_if(sign_of(F.col("d")) == x).alias(x) for x in ("up", "down", "tied"))).withColumn("way", sign_of(F.col("m")))
    one = F.when(F.count_distinct("way") == 1, F.min("way")).otherwise("mixed").alias("direction")
    return by.groupBy("method").agg(*(F.sum(x).alias(x) for x in ("up", "down", "tied")), one)


@query(
    "e17_seed_interval",
    f"""WITH {CUBE}, s AS (SELECT method, metric, seed, avg(value) AS v FROM cube GROUP BY ALL), a AS (SELECT method, metric, count(*) AS n, avg(v) AS m, coalesce(stddev_samp(v), 0) AS sd FROM s GROUP BY ALL),
    t AS (SELECT unnest([{", ".join(f"{x:.3f}::DOUBLE" for x in STUDENT)}]) AS t, unnest(range(1, 11)) AS df)
    SELECT method, metric, n, round(m, 6) AS mean, round(sd, 6) AS sd, round(sd / sqrt(n), 6) AS se, round(m - coalesce(t, 1.96) * sd / sqrt(n), 6) AS low, round(m + coalesce(t, 1.96) * sd / sqrt(n), 6) AS high FROM a LEFT JOIN t ON t.df = n - 1""",
)
def e17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over seeds with Student's interval."""
    a = cube(spark, sf_dir).groupBy("method", "metric", "seed").agg(F.avg("value").alias("v")).groupBy("method", "metric").agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("sd"))
    t = F.coalesce(F.get(F.array(*map(F.lit, STUDENT)), (F.col("n") - 2).cast("int")), F.lit(1.96))
    se = F.col("sd") / F.sqrt("n")
    return a.select("method", "metric", "n", R("m").alias("mean"), R("sd").alias("sd"), R(se).alias("se"), R(F.col("m") - t * se).alias("low"), R(F.col("m") + t * se).alias("high"))


@query("e18_matrix", f"WITH {CUBE}, s AS (SELECT method, metric, seed, avg(value) AS v FROM cube GROUP BY ALL) SELECT method, metric, count(*) AS seed_count, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd FROM s GROUP BY ALL")
def e18(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = cube(spark, sf_dir).groupBy("method", "metric", "seed").agg(F.avg("value").alias("v"))
    return s.groupBy("method", "metric").agg(F.count("*").alias("seed_count"), R(F.avg("v")).alias("mean"), R(F.stddev_pop("v")).alias("sd"))


@query(
    "e19_benchmark",
    f"""WITH {PAIRS} SELECT method, metric, round(avg(b), 6) AS base_mean, round(avg(t), 6) AS mean, round(avg(d), 6) AS delta, round(coalesce(stddev_samp(d), 0) / sqrt(count(*)), 6) AS stderr,
    round(avg(CASE WHEN d > 0 THEN 1.0 ELSE 0 END), 6) AS improved, round(avg(CASE WHEN d = 0 THEN 1.0 ELSE 0 END), 6) AS tied, round(avg(CASE WHEN d < 0 THEN 1.0 ELSE 0 END), 6) AS worsened FROM pairs GROUP BY ALL""",
)
def e19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means, the standard error of the difference, and the shares of prompts that gain and lose."""
    d, share = F.col("d"), lambda c: R(F.avg(c.cast("double")))
    by = paired(over_seeds(cube(spark, sf_dir))).groupBy("method", "metric")
    return by.agg(R(F.avg("b")).alias("base_mean"), R(F.avg("t")).alias("mean"), R(F.avg(d)).alias("delta"), R(F.coalesce(F.stddev_samp(d), F.lit(0.0)) / F.sqrt(F.count("*"))).alias("stderr"), share(d > 0).alias("improved"), share(d == 0).alias("tied"), share(d < 0).alias("worsened"))


@query("c08_evaluable", f"WITH {CUBE}, m AS (SELECT DISTINCT method FROM cube), c AS (SELECT * FROM (VALUES ('c1', '{BASE}', 'tarn-3b'), ('c2', '{BASE}', 'absent'), ('c3', 'pellar-1b', 'tarn-3b')) t(contrast_id, reference, treatment)) SELECT contrast_id, reference IN (SELECT method FROM m) AND treatment IN (SELECT method FROM m) AS evaluable FROM c")
def c08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A contrast can be evaluated if both its methods are present."""
    present = cube(spark, sf_dir).select("method").distinct()
    c = spark.createDataFrame([("c1", BASE, "tarn-3b"), ("c2", BASE, "absent"), ("c3", "pellar-1b", "tarn-3b")], "contrast_id STRING, reference STRING, treatment STRING")
    for side in ("reference", "treatment"):
        c = c.join(present.select(F.col("method").alias(side), F.lit(True).alias(f"{side}_there")), side, "left")
    return c.select("contrast_id", (F.coalesce("reference_there", F.lit(False)) & F.coalesce("treatment_there", F.lit(False))).alias("evaluable"))


@query("l08_missing_prompts", f"WITH {CUBE}, m AS (SELECT DISTINCT method FROM cube), p AS (SELECT DISTINCT prompt_id FROM cube) SELECT m.method, count(*) AS missing FROM m, p WHERE NOT EXISTS (SELECT 1 FROM cube c WHERE c.method = m.method AND c.prompt_id = p.prompt_id) GROUP BY m.method")
def l08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of all prompts each method lacks, by counts: no grid of methods and prompts is built."""
    have = cube(spark, sf_dir).select("method", "prompt_id").distinct()
    total = have.agg(F.count_distinct("prompt_id").alias("total"))
    return have.groupBy("method").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("method", (F.col("total") - F.col("n")).alias("missing")).where("missing > 0")  # total is one row


@query(
    "d13_common_slots",
    f"WITH {RECORDS}, s AS (SELECT prompt_id, sample_index, count(DISTINCT model) AS k FROM records GROUP BY ALL) SELECT k AS methods, count(*) AS slots FROM s GROUP BY k",
)
def d13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many slots (prompt, sample) so many methods share."""
    s = records(spark, sf_dir).groupBy("prompt_id", "sample_index").agg(F.count_distinct("model").alias("methods"))
    return s.groupBy("methods").agg(F.count("*").alias("slots"))


def holm(rows: DataFrame, family: list[str], p: str = "p") -> DataFrame:
    """Holm's step-down adjustment of p within each family: the running maximum of (m - rank + 1) p, at most 1."""
    order = Window.partitionBy(*family).orderBy(p, "id")
    raw = (F.count("*").over(Window.partitionBy(*family)) - F.row_number().over(order) + 1) * F.col(p)
    return rows.withColumn("raw", raw).withColumn("adjusted", F.least(F.lit(1.0), F.max("raw").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("raw")


@query(
    "j04_holm",
    f"""WITH {PAIRS}, z AS (SELECT metric, method AS id, CASE WHEN stddev_samp(d) > 0 THEN 1 / (1 + abs(avg(d) / (stddev_samp(d) / sqrt(count(*))))) ELSE 1.0 END AS p FROM pairs GROUP BY ALL HAVING count(*) > 1),
    r AS (SELECT *, (count(*) OVER (PARTITION BY metric) - row_number() OVER (PARTITION BY metric ORDER BY p, id) + 1) * p AS raw FROM z)
    SELECT metric, id, round(p, 6) AS p, round(least(1.0, max(raw) OVER (PARTITION BY metric ORDER BY p, id ROWS UNBOUNDED PRECEDING)), 6) AS adjusted FROM r""",
)
def j04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holm over the methods within each metric, of a score that falls with |t|."""
    sd = F.stddev_samp("d")
    z = paired(over_seeds(cube(spark, sf_dir))).groupBy("metric", F.col("method").alias("id")).agg(F.when(sd > 0, 1 / (1 + F.abs(F.avg("d") / (sd / F.sqrt(F.count("*")))))).otherwise(1.0).alias("p"), F.count("*").alias("n")).where("n > 1").drop("n")
    return holm(z, ["metric"]).select("metric", "id", R("p").alias("p"), R("adjusted").alias("adjusted"))
