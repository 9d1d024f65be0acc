"""The fail-closed layer: each rule gives its violations as rows, or raises on the first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.lineage import table
from textmill.operators.views import RECORDS, records
from textmill.plans.registry import query


class Violated(ValueError):
    """A rule that doesn't hold, with up to 5 examples."""


def must(violations: DataFrame, rule: str) -> None:
    """Raises if there is any violation: one job that ends at the fifth."""
    rows = violations.limit(5).collect()
    if rows:
        raise Violated(f"{rule}: {[r.asDict() for r in rows]}")


def report(**rules: DataFrame) -> DataFrame:
    """rule, violations: all rules in one job."""
    parts = [df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations") for name, df in rules.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def unique(df: DataFrame, *key: str) -> DataFrame:
    """Keys that several rows have."""
    return df.groupBy(*key).agg(F.count("*").alias("rows")).where("rows > 1")


def outside(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Values that are null, NaN, or not from low to high."""
    c = F.col(column)
    return df.where(c.isNull() | F.isnan(c.cast("double")) | ~c.between(low, high))


def missing(df: DataFrame, other: DataFrame, *key: str) -> DataFrame:
    """Keys of df that other lacks."""
    return df.select(*key).distinct().join(other.select(*key).distinct(), list(key), "left_anti")


def same_keys(a: DataFrame, b: DataFrame, *key: str) -> DataFrame:
    """Keys that only one side has, and which."""
    return missing(a, b, *key).withColumn("only", F.lit("left")).union(missing(b, a, *key).withColumn("only", F.lit("right")))


@query(
    "l01_rules",
    """SELECT 'prompt id unique' AS rule, count(*) AS violations FROM (SELECT id FROM prompts GROUP BY id HAVING count(*) > 1)
    UNION ALL SELECT 'request id unique', count(*) FROM (SELECT request_id FROM generation_records GROUP BY request_id HAVING count(*) > 1)
    UNION ALL SELECT 'score from 0 to 1', count(*) FROM teacher_generations WHERE quality_score IS NULL OR isnan(quality_score) OR NOT quality_score BETWEEN 0 AND 1
    UNION ALL SELECT 'confidence from 1 to 3', count(*) FROM equivalence_labels WHERE confidence IS NULL OR confidence NOT BETWEEN 1 AND 3
    UNION ALL SELECT 'prompt of each record', count(*) FROM (SELECT DISTINCT prompt_id FROM generation_records) r WHERE NOT EXISTS (SELECT 1 FROM prompts p WHERE p.id = r.prompt_id)
    UNION ALL SELECT 'chars as counted', count(*) FROM documents WHERE text IS NOT NULL AND n_chars IS DISTINCT FROM length(text)
    UNION ALL SELECT 'prompt hash binds text', count(*) FROM prompts WHERE text IS NOT NULL AND prompt_hash IS DISTINCT FROM sha256(text)""",
)
def l01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows or keys break each rule."""
    t = lambda name: table(spark, sf_dir, name)
    return report(
        **{
            "prompt id unique": unique(t("prompts"), "id"),
            "request id unique": unique(t("generation_records"), "request_id"),
            "score from 0 to 1": outside(t("teacher_generations"), "quality_score", 0, 1),
            "confidence from 1 to 3": outside(t("equivalence_labels"), "confidence", 1, 3),
            "prompt of each record": missing(t("generation_records"), t("prompts").withColumnRenamed("id", "prompt_id"), "prompt_id"),
            "chars as counted": t("documents").where(F.col("text").isNotNull() & ~F.col("n_chars").eqNullSafe(F.length("text"))),
            "prompt hash binds text": t("prompts").where(F.col("text").isNotNull() & ~F.col("prompt_hash").eqNullSafe(F.sha2(F.col("text").cast("binary"), 256))),
        }
    )


@query("d09_pending", "SELECT DISTINCT id AS prompt_id FROM prompts WHERE id NOT IN (SELECT prompt_id FROM generation_records WHERE prompt_id IS NOT NULL)")
def d09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D09, M: prompts without any record yet."""
    return missing(table(spark, sf_dir, "prompts").select(F.col("id").alias("prompt_id")), table(spark, sf_dir, "generation_records"), "prompt_id")


@query("h02_key_sets", "SELECT DISTINCT prompt_id, 'left' AS only FROM generation_records WHERE prompt_id NOT IN (SELECT prompt_id FROM teacher_generations WHERE prompt_id IS NOT NULL) UNION ALL SELECT DISTINCT prompt_id, 'right' FROM teacher_generations WHERE prompt_id NOT IN (SELECT prompt_id FROM generation_records WHERE prompt_id IS NOT NULL)")
def h02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_keys(table(spark, sf_dir, "generation_records"), table(spark, sf_dir, "teacher_generations"), "prompt_id")


@query("h03_leakage", "SELECT a.id, b.id AS other FROM (SELECT DISTINCT id, split, sha256(lower(trim(text))) AS h FROM prompts WHERE text IS NOT NULL) a JOIN (SELECT DISTINCT id, split, sha256(lower(trim(text))) AS h FROM prompts WHERE text IS NOT NULL) b ON a.h = b.h AND a.split = 'train' AND b.split <> 'train'")
def h03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of the training split whose text is in another split too."""
    p = table(spark, sf_dir, "prompts").where("text IS NOT NULL").select("id", "split", F.sha2(F.lower(F.trim("text")), 256).alias("h")).distinct()
    return p.where("split = 'train'").select("id", "h").join(p.where("split <> 'train'").select(F.col("id").alias("other"), "h"), "h").select("id", "other")


@query("h06_union", "SELECT model, count(DISTINCT request_id) AS n, count(*) - count(DISTINCT request_id) AS again FROM generation_records GROUP BY model")
def h06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by model, and how many rows repeat one."""
    by = table(spark, sf_dir, "generation_records").groupBy("model", "request_id").agg(F.count("*").alias("rows"))
    return by.groupBy("model").agg(F.count("*").alias("n"), (F.sum("rows") - F.count("*")).alias("again"))


@query("l02_counts", f"WITH {RECORDS} SELECT r.config_hash, count(DISTINCT prompt_id) AS prompts, count(*) AS n, count(DISTINCT prompt_id) * any_value(s.samples_per_prompt) AS wished FROM records r JOIN generation_specs s USING (config_hash) GROUP BY r.config_hash")
def l02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of each configuration against prompts times samples."""
    s = table(spark, sf_dir, "generation_specs").select("config_hash", "samples_per_prompt")
    by = records(spark, sf_dir).groupBy("config_hash").agg(F.count_distinct("prompt_id").alias("prompts"), F.count("*").alias("n"))
    return by.join(s, "config_hash").select("config_hash", "prompts", "n", (F.col("prompts") * F.col("samples_per_prompt")).alias("wished"))


@query("d05_scored_texts", "SELECT t.prompt_id, t.sample_index, count(DISTINCT r.request_id) AS records FROM (SELECT DISTINCT prompt_id, sample_index, text FROM teacher_generations WHERE text IS NOT NULL) t JOIN generation_records r ON r.prompt_id = t.prompt_id AND r.text = t.text GROUP BY ALL")
def d05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples and records of one prompt with the same text. The join is on the hash of the text too, which spreads a large prompt."""
    h = F.xxhash64("text").alias("h")
    t = table(spark, sf_dir, "teacher_generations").where("text IS NOT NULL").select("prompt_id", "sample_index", "text", h).distinct()
    r = table(spark, sf_dir, "generation_records").where("text IS NOT NULL").select("prompt_id", "request_id", "text", h)
    return t.join(r, ["prompt_id", "h", "text"]).groupBy("prompt_id", "sample_index").agg(F.count_distinct("request_id").alias("records"))


@query("k07_long_metrics", f"WITH {RECORDS}, m AS (SELECT model, count(*) * 1.0 AS n, avg(completion_tokens) AS mean_tokens, avg(length(text)) AS mean_chars FROM records GROUP BY model) SELECT model, k AS name, round(CAST(v AS DOUBLE), 6) AS value FROM m, LATERAL (VALUES ('n', n), ('mean_tokens', mean_tokens), ('mean_chars', mean_chars)) t(k, v) WHERE v IS NOT NULL AND isfinite(v::DOUBLE)")
def k07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric values in long form; those that aren't finite are left out."""
    m = records(spark, sf_dir).groupBy("model").agg(F.count("*").cast("double").alias("n"), F.avg("completion_tokens").alias("mean_tokens"), F.avg(F.length("text")).alias("mean_chars"))
    long = m.unpivot("model", ["n", "mean_tokens", "mean_chars"], "name", "value")
    return long.where("value IS NOT NULL AND NOT isnan(value) AND abs(value) < double('inf')").select("model", "name", F.round("value", 6).alias("value"))


@query("m_arrivals", "SELECT date_trunc('day', arrived_at) AS day, model, count(*) AS n, count(*) FILTER (lower(trim(finish_reason)) = 'length') AS at_limit FROM generation_records WHERE arrived_at IS NOT NULL GROUP BY ALL")
def m_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M: records by day of arrival, by the function that the stream uses."""
    from textmill.streaming.incremental import counts

    rows = table(spark, sf_dir, "generation_records").where("arrived_at IS NOT NULL")
    return counts(rows.withColumn("arrived_at", F.col("arrived_at").cast("timestamp"))).withColumn("day", F.col("day").cast("timestamp_ntz"))
