"""Agreement of raters, blinded packets and calibration of a similarity threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmill.functions.columns import divergence, kappa, seeded
from textmill.lineage import table
from textmill.operators.views import RECORDS, records
from textmill.plans.registry import query

R = lambda c: F.round(c, 6)
#: Half-open bins of similarity.
BINS = (0.0, 0.74, 0.84, 0.90, 0.94, 1.001)
LABELS = """labels AS (
  SELECT blind_id, rater_id, label, confidence FROM (
    SELECT blind_id, rater_id, confidence, submitted_at, regexp_replace(trim(regexp_replace(lower(label), '[\\s_-]+', ' ', 'g')), ' ', '_', 'g') AS label FROM equivalence_labels
  ) QUALIFY row_number() OVER (PARTITION BY blind_id, rater_id ORDER BY submitted_at DESC NULLS LAST, label DESC NULLS LAST, confidence DESC NULLS LAST) = 1
), said AS (SELECT * FROM labels WHERE label IN ('equivalent', 'not_equivalent', 'uncertain'))"""
PAIRS = """pairs AS (SELECT *, coalesce(nullif(trim(repeat_of), ''), blind_id) AS original, coalesce(trim(repeat_of), '') = '' AS is_first FROM semantic_pairs)"""


def said(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each rater's latest answer to each pair, its label in one spelling."""
    label = F.regexp_replace(F.trim(F.regexp_replace(F.lower("label"), r"[\s_-]+", " ")), " ", "_")
    rows = table(spark, sf_dir, "equivalence_labels").withColumn("label", label)
    last = rows.groupBy("blind_id", "rater_id").agg(F.max(F.struct("submitted_at", "label", "confidence")).alias("x")).select("blind_id", "rater_id", "x.label", "x.confidence")
    return last.where(F.col("label").isin("equivalent", "not_equivalent", "uncertain"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    again = F.coalesce(F.trim("repeat_of"), F.lit(""))
    return table(spark, sf_dir, "semantic_pairs").withColumn("original", F.when(again == "", F.col("blind_id")).otherwise(again)).withColumn("is_first", again == "")


@query("e08_label_counts", f"WITH {LABELS} SELECT rater_id, label, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM said GROUP BY ALL")
def e08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return said(spark, sf_dir).groupBy("rater_id", "label").agg(F.count("*").alias("n"), R(F.avg("confidence")).alias("mean_confidence"))


@query(
    "e40_kappa",
    f"""WITH {LABELS}, b AS (SELECT a.rater_id AS rater_a, c.rater_id AS rater_b, a.label AS la, c.label AS lb FROM said a JOIN said c USING (blind_id) WHERE a.rater_id < c.rater_id),
    n AS (SELECT rater_a, rater_b, count(*) AS n, count(*) FILTER (la = lb) AS agreed FROM b GROUP BY ALL),
    m AS (SELECT rater_a, rater_b, l, count(*) FILTER (la = l) * count(*) FILTER (lb = l) AS x FROM b, (VALUES ('equivalent'), ('not_equivalent'), ('uncertain')) t(l) GROUP BY ALL)
    SELECT rater_a, rater_b, any_value(n.n) AS n, round(CASE WHEN sum(x) * 1.0 / (any_value(n.n) * any_value(n.n)) >= 1 THEN 1.0 ELSE (any_value(agreed) * 1.0 / any_value(n.n) - sum(x) * 1.0 / (any_value(n.n) * any_value(n.n))) / (1 - sum(x) * 1.0 / (any_value(n.n) * any_value(n.n))) END, 6) AS kappa
    FROM n JOIN m USING (rater_a, rater_b) GROUP BY ALL""",
)
def e40(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohen's kappa of each two raters over the pairs both answered."""
    s = said(spark, sf_dir)
    b = s.select("blind_id", F.col("rater_id").alias("rater_a"), F.col("label").alias("la")).join(s.select("blind_id", F.col("rater_id").alias("rater_b"), F.col("label").alias("lb")), "blind_id").where("rater_a < rater_b")
    names = ("equivalent", "not_equivalent", "uncertain")
    counts = b.groupBy("rater_a", "rater_b").agg(F.count("*").alias("n"), F.count_if(F.col("la") == F.col("lb")).alias("agreed"), *(F.count_if(F.col(c) == x).alias(f"{c}_{x}") for c in ("la", "lb") for x in names))
    expected = sum((F.col(f"la_{x}") * F.col(f"lb_{x}") for x in names), F.lit(0))
    return counts.select("rater_a", "rater_b", "n", R(kappa(F.col("n"), F.col("agreed"), expected)).alias("kappa"))


@query("f11_flagged", f"WITH {LABELS}, {PAIRS} SELECT p.blind_id, count(*) AS answers FROM pairs p JOIN said s USING (blind_id) WHERE p.is_first GROUP BY p.blind_id HAVING count(DISTINCT s.label) > 1 OR bool_or(s.label = 'uncertain')")
def f11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Originals whose raters disagree or are uncertain, for adjudication."""
    rows = pairs(spark, sf_dir).where("is_first").select("blind_id").join(said(spark, sf_dir), "blind_id")
    by = rows.groupBy("blind_id").agg(F.count("*").alias("answers"), F.count_distinct("label").alias("k"), F.max((F.col("label") == "uncertain").cast("int")).alias("u"))
    return by.where("k > 1 OR u = 1").select("blind_id", "answers")


@query(
    "e38_repeats",
    f"WITH {LABELS}, {PAIRS} SELECT s.rater_id, count(*) AS n, round(avg(CASE WHEN s.label = o.label THEN 1.0 ELSE 0 END), 6) AS same FROM pairs p JOIN said s ON s.blind_id = p.blind_id JOIN said o ON o.blind_id = p.original AND o.rater_id = s.rater_id WHERE NOT p.is_first GROUP BY s.rater_id",
)
def e38(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often raters repeat their answer to a pair shown again."""
    s = said(spark, sf_dir)
    again = pairs(spark, sf_dir).where("NOT is_first").select("blind_id", "original").join(s.select("blind_id", "rater_id", "label"), "blind_id")
    both = again.join(s.select(F.col("blind_id").alias("original"), "rater_id", F.col("label").alias("first")), ["original", "rater_id"])
    return both.groupBy("rater_id").agg(F.count("*").alias("n"), R(F.avg((F.col("label") == F.col("first")).cast("double"))).alias("same"))


@query(
    "e37_rationales",
    """WITH t AS (SELECT rater_id, trim(rationale) AS r FROM (SELECT DISTINCT * FROM equivalence_labels) WHERE trim(rationale) <> '') SELECT rater_id, count(*) AS n, count(DISTINCT r) AS different, round(1 - count(DISTINCT r) * 1.0 / count(*), 6) AS repeated_rate,
    round(avg(len(regexp_split_to_array(r, '\\s+'))), 6) AS mean_words, max(len(regexp_split_to_array(r, '\\s+'))) AS most_words FROM t GROUP BY rater_id""",
)
def e37(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "equivalence_labels").distinct().select("rater_id", F.trim("rationale").alias("r")).where("r <> ''").withColumn("w", F.size(F.split("r", r"\s+")))
    return t.groupBy("rater_id").agg(F.count("*").alias("n"), F.count_distinct("r").alias("different"), R(1 - F.count_distinct("r") / F.count("*")).alias("repeated_rate"), R(F.avg("w")).alias("mean_words"), F.max("w").cast("bigint").alias("most_words"))


@query(
    "e43_thresholds",
    f"""WITH {LABELS}, {PAIRS}, v AS (SELECT p.blind_id, any_value(p.similarity) AS s, avg(CASE WHEN l.label = 'equivalent' THEN 1.0 ELSE 0 END) > 0.5 AS yes FROM pairs p JOIN said l USING (blind_id) WHERE p.is_first AND l.label <> 'uncertain' AND p.similarity IS NOT NULL GROUP BY p.blind_id),
    c AS (SELECT t.k / 100.0 AS threshold, count(*) FILTER (yes AND s >= t.k / 100.0) AS tp, count(*) FILTER (NOT yes AND s >= t.k / 100.0) AS fp, count(*) FILTER (yes AND s < t.k / 100.0) AS fn, count(*) FILTER (NOT yes AND s < t.k / 100.0) AS tn FROM v, (SELECT unnest(range(70, 100, 2)) AS k) t GROUP BY t.k)
    SELECT round(CAST(threshold AS DOUBLE), 6) AS threshold, tp, fp, fn, tn, round(tp * 1.0 / (tp + fn), 6) AS sensitivity, round(tn * 1.0 / (tn + fp), 6) AS specificity, round((tp * 1.0 / (tp + fn) + tn * 1.0 / (tn + fp)) / 2, 6) AS balanced FROM c""",
)
def e43(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E43 and the table E44 chooses from: confusion of similarity at each threshold with the majority's label. The grid has 15 thresholds."""
    v = pairs(spark, sf_dir).where("is_first AND similarity IS NOT NULL").select("blind_id", "similarity").join(said(spark, sf_dir).where("label <> 'uncertain'"), "blind_id")
    v = v.groupBy("blind_id").agg(F.max("similarity").alias("s"), (F.avg((F.col("label") == "equivalent").cast("double")) > 0.5).alias("yes"))
    at = v.select("s", "yes", F.explode(F.array(*(F.lit(k / 100) for k in range(70, 100, 2)))).alias("threshold"))
    high = F.col("s") >= F.col("threshold")
    c = at.groupBy("threshold").agg(F.count_if(F.col("yes") & high).alias("tp"), F.count_if(~F.col("yes") & high).alias("fp"), F.count_if(F.col("yes") & ~high).alias("fn"), F.count_if(~F.col("yes") & ~high).alias("tn"))
    sens, spec = F.try_divide("tp", F.col("tp") + F.col("fn")), F.try_divide("tn", F.col("tn") + F.col("fp"))
    return c.select("threshold", "tp", "fp", "fn", "tn", R(sens).alias("sensitivity"), R(spec).alias("specificity"), R((sens + spec) / 2).alias("balanced"))


def chosen_threshold(rows: DataFrame, least_kappa: float, observed_kappa: float | None) -> DataFrame:
    """The threshold of highest balanced accuracy, of equal ones the higher; null unless the raters' kappa is high enough."""
    ok = observed_kappa is not None and observed_kappa >= least_kappa
    return rows.agg(F.max_by("threshold", F.struct("balanced", "threshold")).alias("t")).select((F.col("t") if ok else F.lit(None).cast("double")).alias("threshold"))


@query("c11_bins", f"""WITH {PAIRS}, b AS (SELECT unnest([0.0, 0.74, 0.84, 0.9, 0.94]::DOUBLE[]) AS low, unnest([0.74, 0.84, 0.9, 0.94, 1.001]::DOUBLE[]) AS high) SELECT low, count(*) AS n, round(avg(similarity), 6) AS mean FROM pairs JOIN b ON similarity >= low AND similarity < high WHERE is_first GROUP BY low""")
def c11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Originals by half-open bin of similarity; values outside are in none."""
    s = F.col("similarity")
    low = F.coalesce(*(F.when((s >= a) & (s < b), F.lit(a)) for a, b in zip(BINS, BINS[1:])))
    return pairs(spark, sf_dir).where("is_first").withColumn("low", low).where("low IS NOT NULL").groupBy("low").agg(F.count("*").alias("n"), R(F.avg(s)).alias("mean"))


@query("b22_public", f"""WITH {PAIRS} SELECT blind_id, CASE WHEN ('0x' || substr(sha256('17' || chr(0) || blind_id), 1, 1))::INT % 2 = 1 THEN right_index ELSE left_index END AS a, CASE WHEN ('0x' || substr(sha256('17' || chr(0) || blind_id), 1, 1))::INT % 2 = 1 THEN left_index ELSE right_index END AS b FROM pairs""")
def b22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What raters see: no prompt, no similarity, sides swapped by the parity of a hash."""
    odd = F.pmod(F.conv(F.substring(seeded(17, "blind_id"), 1, 1), 16, 10).cast("int"), F.lit(2)) == 1
    return pairs(spark, sf_dir).select("blind_id", F.when(odd, F.col("right_index")).otherwise(F.col("left_index")).alias("a"), F.when(odd, F.col("left_index")).otherwise(F.col("right_index")).alias("b"))


@query("f14_round_robin", f"""WITH {RECORDS}, r AS (SELECT request_id, model, row_number() OVER (PARTITION BY model ORDER BY sha256('17' || chr(0) || request_id), request_id) AS k FROM records) SELECT request_id, model FROM r ORDER BY k, sha256('17' || chr(0) || model), model LIMIT 60""")
def f14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """60 records in turn from each model, each by hash. Only the first of each model can be taken, so ranks beyond 60 are cut before the order over all."""
    own = Window.partitionBy("model").orderBy(seeded(17, "request_id"), "request_id")
    rows = records(spark, sf_dir).select("request_id", "model").withColumn("k", F.row_number().over(own)).where("k <= 60")
    return rows.orderBy("k", seeded(17, "model"), "model").limit(60).select("request_id", "model")


@query("f17_quartiles", f"""WITH {RECORDS}, r AS (SELECT model, request_id, row_number() OVER (PARTITION BY model ORDER BY completion_tokens, sha256('17' || chr(0) || request_id), request_id) - 1 AS pos, count(*) OVER (PARTITION BY model) AS n FROM records WHERE completion_tokens IS NOT NULL),
    s AS (SELECT model, request_id, least(3, pos * 4 // n) AS stratum FROM r), t AS (SELECT *, row_number() OVER (PARTITION BY model, stratum ORDER BY sha256('17' || chr(0) || request_id), request_id) AS k FROM s) SELECT model, CAST(stratum AS INTEGER) AS stratum, request_id FROM t WHERE k <= 5""")
def f17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """5 records by hash of each quarter of each model's token counts; quarters are by position, which ntile would cut elsewhere."""
    w = Window.partitionBy("model")
    h = seeded(17, "request_id")
    r = records(spark, sf_dir).where("completion_tokens IS NOT NULL").select("model", "request_id", (F.row_number().over(w.orderBy("completion_tokens", h, "request_id")) - 1).alias("pos"), F.count("*").over(w).alias("n"))
    s = r.withColumn("stratum", F.least(F.lit(3), F.expr("pos * 4 div n")).cast("int"))
    return s.withColumn("k", F.row_number().over(Window.partitionBy("model", "stratum").orderBy(h, "request_id"))).where("k <= 5").select("model", "stratum", "request_id")


@query("f20_repeats", f"""WITH {PAIRS}, o AS (SELECT DISTINCT blind_id, left_index, right_index FROM pairs WHERE is_first), n AS (SELECT CAST(round_even(count(*) * 0.1, 0) AS BIGINT) AS n FROM o), r AS (SELECT *, row_number() OVER (ORDER BY sha256('17' || chr(0) || blind_id), blind_id) AS k FROM o) SELECT blind_id AS repeat_of, right_index AS a, left_index AS b FROM r, n WHERE k <= n.n""")
def f20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a tenth of the originals by hash, shown again with sides swapped; the number is rounded half to even."""
    o = pairs(spark, sf_dir).where("is_first").select("blind_id", "left_index", "right_index").distinct()
    n = int(o.agg(F.bround(F.count("*") * 0.1, 0)).first()[0])
    return o.orderBy(seeded(17, "blind_id"), "blind_id").limit(n).select(F.col("blind_id").alias("repeat_of"), F.col("right_index").alias("a"), F.col("left_index").alias("b"))


@query("f16_bin_packet", f"""WITH {PAIRS}, o AS (SELECT prompt_id, blind_id, similarity FROM pairs WHERE is_first AND similarity IS NOT NULL), f AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY prompt_id ORDER BY sha256('17' || chr(0) || blind_id), blind_id) = 1), b AS (SELECT *, CASE WHEN similarity < 0.74 THEN 0.0 WHEN similarity < 0.84 THEN 0.74 WHEN similarity < 0.9 THEN 0.84 WHEN similarity < 0.94 THEN 0.9 ELSE 0.94 END AS low FROM f WHERE similarity >= 0 AND similarity < 1.001)
    SELECT CAST(low AS DOUBLE) AS low, blind_id FROM b QUALIFY row_number() OVER (PARTITION BY low ORDER BY sha256('17' || chr(0) || blind_id), blind_id) <= 10""")
def f16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 10 originals of each bin, by hash, one a prompt."""
    h, s = seeded(17, "blind_id"), F.col("similarity")
    o = pairs(spark, sf_dir).where("is_first AND similarity IS NOT NULL")
    f = o.withColumn("k", F.row_number().over(Window.partitionBy("prompt_id").orderBy(h, "blind_id"))).where("k = 1")
    low = F.coalesce(*(F.when((s >= a) & (s < b), F.lit(a)) for a, b in zip(BINS, BINS[1:])))
    b = f.withColumn("low", low).where("low IS NOT NULL")
    return b.withColumn("k", F.row_number().over(Window.partitionBy("low").orderBy(h, "blind_id"))).where("k <= 10").select("low", "blind_id")


@query(
    "e31_divergence",
    f"""WITH {RECORDS}, s AS (SELECT DISTINCT model FROM records), l AS (SELECT DISTINCT coalesce(finish_reason, 'unknown') AS x FROM records), c AS (SELECT model, coalesce(finish_reason, 'unknown') AS x, count(*) AS n FROM records GROUP BY ALL),
    p AS (SELECT s.model, l.x, coalesce(c.n, 0) * 1.0 / sum(coalesce(c.n, 0)) OVER (PARTITION BY s.model) AS p FROM s CROSS JOIN l LEFT JOIN c ON c.model = s.model AND c.x = l.x), j AS (SELECT a.model, a.p, b.p AS q, (a.p + b.p) / 2 AS m FROM p a JOIN p b USING (x) WHERE b.model = 'orla-7b-chat' AND a.model <> 'orla-7b-chat')
    SELECT model, round(sum(abs(p - q)) / 2, 6) AS tvd, round(sum((CASE WHEN p > 0 THEN p * log2(p / m) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / m) ELSE 0 END) / 2), 6) AS jsd, round(-sum(CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END), 6) AS entropy FROM j GROUP BY model""",
)
def e31(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each model's shares of finish reasons against one model's: total variation, Jensen-Shannon divergence, entropy. The categories are few and pivoted, zeros kept."""
    rows = records(spark, sf_dir).select("model", F.coalesce("finish_reason", F.lit("unknown")).alias("x"))
    names = sorted(r["x"] for r in rows.select("x").distinct().collect())  # the taxonomy
    wide = rows.groupBy("model").agg(F.count("*").alias("n"), *(F.count_if(F.col("x") == x).alias(f"n_{x}") for x in names))
    p = wide.select("model", F.array(*(F.col(f"n_{x}") / F.col("n") for x in names)).alias("p"))
    q = p.where("model = 'orla-7b-chat'").select(F.col("p").alias("q"))
    both = p.where("model <> 'orla-7b-chat'").crossJoin(F.broadcast(q))  # q is one row
    total = lambda f: F.aggregate(F.zip_with("p", "q", f), F.lit(0.0), lambda s, x: s + x)
    entropy = F.aggregate("p", F.lit(0.0), lambda s, x: s - F.when(x > 0, x * F.log2(x)).otherwise(0.0))
    return both.select("model", R(total(lambda a, b: F.abs(a - b)) / 2).alias("tvd"), R(total(divergence)).alias("jsd"), R(entropy).alias("entropy"))


@query("l15_coverage", f"WITH {LABELS}, {PAIRS} SELECT p.blind_id FROM (SELECT DISTINCT blind_id FROM pairs) p WHERE NOT EXISTS (SELECT 1 FROM said s WHERE s.blind_id = p.blind_id)")
def l15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs without any answer."""
    return pairs(spark, sf_dir).select("blind_id").distinct().join(said(spark, sf_dir), "blind_id", "left_anti")
