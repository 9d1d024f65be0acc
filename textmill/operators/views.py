"""Ranked and diversity-aware views of the samples of each prompt."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmill.functions.columns import hash_index, seeded
from textmill.lineage import table
from textmill.plans.registry import query

SEED = 17
LATEST = """latest AS (
  SELECT prompt_id, sample_index, text, quality_score, cluster_id FROM teacher_generations
  QUALIFY row_number() OVER (PARTITION BY prompt_id, sample_index ORDER BY scored_at DESC NULLS LAST, quality_score DESC NULLS LAST, cluster_id DESC NULLS LAST, text DESC NULLS LAST) = 1
), scored AS (
  SELECT * FROM latest WHERE quality_score BETWEEN 0 AND 1 AND NOT isnan(quality_score) AND text IS NOT NULL
)"""
RECORDS = """records AS (
  SELECT request_id, prompt_id, sample_index, text, lower(trim(finish_reason)) AS finish_reason, model, config_hash, prompt_tokens, completion_tokens FROM generation_records
  QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY arrived_at NULLS LAST) = 1
)"""


def latest(samples: DataFrame) -> DataFrame:
    """Each sample once, by its latest scored_at. The shuffle is on (prompt_id, sample_index), so a large prompt is spread."""
    best = F.max(F.struct("scored_at", "quality_score", "cluster_id", "text")).alias("x")
    return samples.groupBy("prompt_id", "sample_index").agg(best).select("prompt_id", "sample_index", "x.text", "x.quality_score", "x.cluster_id")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = latest(table(spark, sf_dir, "teacher_generations"))
    return rows.where(F.col("quality_score").between(0, 1) & ~F.isnan("quality_score") & F.col("text").isNotNull())


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each generation record once; finish_reason in small letters."""
    cols = ["prompt_id", "sample_index", "text", "finish_reason", "model", "config_hash", "prompt_tokens", "completion_tokens"]
    rows = table(spark, sf_dir, "generation_records").groupBy("request_id").agg(F.min_by(F.struct(*cols), F.struct(F.col("arrived_at").isNull(), "arrived_at")).alias("x"))
    return rows.select("request_id", "x.*").withColumn("finish_reason", F.lower(F.trim("finish_reason")))


def best_of(rows: DataFrame, n: int, view: str) -> DataFrame:
    """The n samples of highest score of each prompt (n = 1: F06)."""
    order = Window.partitionBy("prompt_id").orderBy(F.desc("quality_score"), "sample_index")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).select("prompt_id", F.lit(view).alias("view"), "place", "sample_index")


def random_k(rows: DataFrame, k: int, view: str, seed: int = SEED) -> DataFrame:
    """the sample at a hashed position, then others by hash, in the order of their index. Views of larger k hold those of smaller k."""
    sizes = rows.groupBy("prompt_id").agg(F.count("*").alias("size"), F.min("sample_index").alias("low"))
    placed = rows.join(sizes, "prompt_id").withColumn("first", F.col("sample_index") == hash_index(seeded(seed, "prompt_id"), F.col("size")))
    order = Window.partitionBy("prompt_id").orderBy(F.desc("first"), seeded(seed, "prompt_id", F.lit("random-k"), "sample_index"), "sample_index")
    taken = placed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return taken.select("prompt_id", F.lit(view).alias("view"), F.row_number().over(Window.partitionBy("prompt_id").orderBy("sample_index")).alias("place"), "sample_index")


def mode1(rows: DataFrame) -> DataFrame:
    """the best sample of the largest cluster; of equal clusters that with the better best sample, then the lesser id."""
    by = rows.groupBy("prompt_id", F.coalesce("cluster_id", F.lit("")).alias("cluster_id")).agg(F.count("*").alias("n"), F.max("quality_score").alias("q"), F.min_by("sample_index", F.struct(-F.col("quality_score"), "sample_index")).alias("sample_index"))
    order = Window.partitionBy("prompt_id").orderBy(F.desc("n"), F.desc("q"), "cluster_id")
    return by.withColumn("place", F.row_number().over(order)).where("place = 1").select("prompt_id", F.lit("mode1").alias("view"), "place", "sample_index")


def diverse(rows: DataFrame, k: int = 4) -> DataFrame:
    """the best sample of each cluster by score, then the best of the rest, k in all."""
    own = rows.withColumn("cluster_id", F.coalesce("cluster_id", F.lit("")))
    first = F.row_number().over(Window.partitionBy("prompt_id", "cluster_id").orderBy(F.desc("quality_score"), "sample_index")) > 1
    order = Window.partitionBy("prompt_id").orderBy("later", F.desc("quality_score"), "sample_index")
    return own.withColumn("later", first).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("prompt_id", F.lit(f"diverse{k}").alias("view"), "place", "sample_index")


def views(rows: DataFrame) -> DataFrame:
    """all views of all prompts, one row a view and place."""
    whole = rows.select("prompt_id", F.lit("all").alias("view"), F.row_number().over(Window.partitionBy("prompt_id").orderBy("sample_index")).alias("place"), "sample_index")
    out = best_of(rows, 1, "best1")
    for v in (random_k(rows, 1, "random1"), random_k(rows, 4, "random4"), mode1(rows), diverse(rows), whole):
        out = out.unionByName(v)
    return out


VIEWS = f"""{LATEST}, c AS (
  SELECT prompt_id, sample_index, quality_score AS q, coalesce(cluster_id, '') AS cluster_id, text,
         count(*) OVER (PARTITION BY prompt_id) AS size,
         sha256('17' || chr(0) || prompt_id) AS h,
         sha256('17' || chr(0) || prompt_id || chr(0) || 'random-k' || chr(0) || sample_index) AS hk
  FROM scored
), r AS (
  SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY q DESC, sample_index) AS best,
         row_number() OVER (PARTITION BY prompt_id ORDER BY (sample_index = CAST(('0x' || substr(h, 1, 16))::UBIGINT % size AS INTEGER)) DESC, hk, sample_index) AS random,
         row_number() OVER (PARTITION BY prompt_id, cluster_id ORDER BY q DESC, sample_index) AS own,
         count(*) OVER (PARTITION BY prompt_id, cluster_id) AS n, max(q) OVER (PARTITION BY prompt_id, cluster_id) AS mq
  FROM c
), v AS (
  SELECT prompt_id, 'best1' AS view, 1 AS place, sample_index FROM r WHERE best = 1
  UNION ALL SELECT prompt_id, 'random1', 1, sample_index FROM r WHERE random = 1
  UNION ALL SELECT prompt_id, 'random4', row_number() OVER (PARTITION BY prompt_id ORDER BY sample_index), sample_index FROM r WHERE random <= 4
  UNION ALL SELECT * FROM (SELECT prompt_id, 'mode1', row_number() OVER (PARTITION BY prompt_id ORDER BY n DESC, mq DESC, cluster_id) AS place, sample_index FROM r WHERE own = 1) WHERE place = 1
  UNION ALL SELECT * FROM (SELECT prompt_id, 'diverse4', row_number() OVER (PARTITION BY prompt_id ORDER BY own > 1, q DESC, sample_index) AS place, sample_index FROM r) WHERE place <= 4
  UNION ALL SELECT prompt_id, 'all', row_number() OVER (PARTITION BY prompt_id ORDER BY sample_index), sample_index FROM r
)"""
ONE = "SELECT prompt_id, view, CAST(place AS INTEGER) AS place, sample_index FROM v"


@query("f10_views", f"WITH {VIEWS} {ONE}")
def f10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views(scored(spark, sf_dir))


for _id, _view, _make in (
    ("f04_random1", "random1", lambda r: random_k(r, 1, "random1")),
    ("f05_random4", "random4", lambda r: random_k(r, 4, "random4")),
    ("f06_best1", "best1", lambda r: best_of(r, 1, "best1")),
    ("f07_mode1", "mode1", mode1),
    ("f08_diverse4", "diverse4", diverse),
):
    query(_id, f"WITH {VIEWS} {ONE} WHERE view = '{_view}'")(lambda spark, sf_dir, make=_make: make(scored(spark, sf_dir)))
query("f09_all", f"WITH {VIEWS} {ONE} WHERE view = 'all'")(lambda spark, sf_dir: views(scored(spark, sf_dir)).where("view = 'all'"))


@query(
    "e26_view_summary",
    f"""WITH {VIEWS} SELECT view, count(*) AS responses, count(DISTINCT prompt_id) AS prompts, round(avg(s.quality_score), 6) AS quality_mean,
    round(count(DISTINCT (prompt_id, coalesce(s.cluster_id, ''))) * 1.0 / count(DISTINCT prompt_id), 6) AS clusters_per_prompt
    FROM v JOIN scored s USING (prompt_id, sample_index) GROUP BY view""",
)
def e26(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir)
    of = views(rows).join(rows, ["prompt_id", "sample_index"])
    by = of.groupBy("view", "prompt_id").agg(F.count("*").alias("n"), F.sum("quality_score").alias("q"), F.count_distinct(F.coalesce("cluster_id", F.lit(""))).alias("k"))
    return by.groupBy("view").agg(F.sum("n").alias("responses"), F.count("*").alias("prompts"), F.round(F.sum("q") / F.sum("n"), 6).alias("quality_mean"), F.round(F.avg("k"), 6).alias("clusters_per_prompt"))


@query(
    "e27_view_overlap",
    f"""WITH {VIEWS}, p AS (SELECT prompt_id, max(CASE WHEN view = 'random1' THEN sample_index END) AS r, max(CASE WHEN view = 'best1' THEN sample_index END) AS b,
    max(CASE WHEN view = 'mode1' THEN sample_index END) AS m FROM v GROUP BY prompt_id)
    SELECT count(*) AS prompts, count(*) FILTER (r = b) AS random_best, count(*) FILTER (r = m) AS random_mode, count(*) FILTER (b = m) AS best_mode FROM p""",
)
def e27(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views(scored(spark, sf_dir)).where("place = 1").groupBy("prompt_id").pivot("view", ["random1", "best1", "mode1"]).agg(F.max("sample_index"))
    return p.agg(F.count("*").alias("prompts"), F.count_if(F.col("random1") == F.col("best1")).alias("random_best"), F.count_if(F.col("random1") == F.col("mode1")).alias("random_mode"), F.count_if(F.col("best1") == F.col("mode1")).alias("best_mode"))


@query("f01_subset", "SELECT id, split FROM (SELECT DISTINCT id, split FROM prompts) ORDER BY sha256('17' || chr(0) || id), id LIMIT 100")
def f01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 prompts of least seeded hash: larger sizes hold smaller ones, whatever the order of the rows."""
    return table(spark, sf_dir, "prompts").select("id", "split").distinct().orderBy(seeded(SEED, "id"), "id").limit(100)


@query("f02_dedupe_subset", "SELECT first_id FROM (SELECT min(id) AS first_id, sha256(lower(trim(text))) AS identity FROM prompts WHERE text IS NOT NULL GROUP BY identity) ORDER BY sha256('17' || chr(0) || identity), identity LIMIT 100")
def f02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """of each content the first id, then the 100 of least seeded hash of the content."""
    by = table(spark, sf_dir, "prompts").where("text IS NOT NULL").groupBy(F.sha2(F.lower(F.trim("text")), 256).alias("identity")).agg(F.min("id").alias("first_id"))
    return by.orderBy(seeded(SEED, "identity"), "identity").limit(100).select("first_id")


def positions(rows: DataFrame, *keys: str) -> DataFrame:
    """pos: the position of each row in the order of keys, from 0. Ranges of keys are counted first, so that no task sees all rows."""
    from pyspark.sql.functions import spark_partition_id

    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("part", spark_partition_id()).withColumn("mono", F.monotonically_increasing_id() - F.shiftleft(F.col("part").cast("bigint"), 33))
    from textmill.lineage import settle

    ranged = settle(ranged)
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"))  # a row a partition
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return ranged.join(F.broadcast(before), "part").withColumn("pos", F.col("before") + F.col("mono")).drop("part", "mono", "before")


@query(
    "f13_length_strata",
    """WITH p AS (SELECT DISTINCT id, length(text) AS n FROM prompts WHERE text IS NOT NULL), r AS (SELECT id, n, row_number() OVER (ORDER BY n, id) - 1 AS pos, count(*) OVER () AS total FROM p),
    s AS (SELECT k, min(total) AS total FROM r, range(16) t(k) GROUP BY k) SELECT CAST(s.k AS INTEGER) AS stratum, r.id, CAST(r.n AS INTEGER) AS n FROM s JOIN r ON r.pos = (s.k * s.total // 16 + (s.k + 1) * s.total // 16 - 1) // 2""",
)
def f13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle prompt of each of 16 equal strata of length."""
    p = table(spark, sf_dir, "prompts").where("text IS NOT NULL").select("id", F.length("text").alias("n")).distinct()
    placed = positions(p, "n", "id")
    total = placed.agg(F.count("*").alias("total"))
    strata = spark.range(16).crossJoin(F.broadcast(total)).selectExpr("cast(id AS INT) AS stratum", "(id * total div 16 + (id + 1) * total div 16 - 1) div 2 AS pos")  # 16 rows by one
    return placed.join(F.broadcast(strata), "pos").select("stratum", "id", "n")


@query("f21_shards", "SELECT id, CAST((row_number() OVER (ORDER BY id) - 1) % 4 AS INTEGER) AS shard FROM (SELECT DISTINCT id FROM prompts)")
def f21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of each prompt: its position among the sorted ids, modulo 4."""
    return positions(table(spark, sf_dir, "prompts").select("id").distinct(), "id").select("id", F.pmod("pos", F.lit(4)).cast("int").alias("shard"))


@query("f22_longest", f"WITH {RECORDS} SELECT request_id, length(text) AS n FROM records WHERE text IS NOT NULL ORDER BY n DESC, request_id LIMIT 10")
def f22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).where("text IS NOT NULL").select("request_id", F.length("text").cast("bigint").alias("n")).orderBy(F.desc("n"), "request_id").limit(10)


@query(
    "l03_gaps",
    f"WITH {LATEST} SELECT prompt_id, count(*) AS samples, max(sample_index) AS highest FROM latest GROUP BY prompt_id HAVING count(*) <> 8 OR min(sample_index) <> 0 OR max(sample_index) <> 7",
)
def l03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts whose samples aren't exactly 0 to 7: reported, not dropped."""
    by = latest(table(spark, sf_dir, "teacher_generations")).groupBy("prompt_id").agg(F.count("*").alias("samples"), F.max("sample_index").alias("highest"), F.min("sample_index").alias("low"))
    return by.where("samples <> 8 OR low <> 0 OR highest <> 7").drop("low")
