"""Rows for training and audit."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmill.lineage import table
from textmill.operators.views import LATEST, best_of, scored
from textmill.plans.registry import query

MONTHS = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
#: Ways in which an article is made public, in the order that counts on one day (fixed values).
PUBLIC = {"epublish": 0, "aheadofprint": 1, "ppublish": 2, "ecollection": 3}


def best_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each prompt with its best sample: id, prompt, target."""
    rows = scored(spark, sf_dir)
    best = best_of(rows, 1, "best1").select("prompt_id", "sample_index").join(rows, ["prompt_id", "sample_index"]).select(F.col("prompt_id").alias("id"), F.trim("text").alias("target"))
    p = table(spark, sf_dir, "prompts").where("text IS NOT NULL").groupBy("id").agg(F.min("text").alias("prompt"))
    return p.join(best.where("target <> ''"), "id")


def chat(rows: DataFrame) -> DataFrame:
    """The conversation of a prompt and its target."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    return rows.select("id", F.array(turn("user", "prompt"), turn("assistant", "target")).alias("messages"))


def completion(rows: DataFrame) -> DataFrame:
    """Prompt and completion apart."""
    turn = lambda role, c: F.array(F.struct(F.lit(role).alias("role"), F.col(c).alias("content")))
    return rows.select("id", turn("user", "prompt").alias("prompt"), turn("assistant", "target").alias("completion"))


BEST = f"""{LATEST}, best AS (SELECT prompt_id AS id, trim(text) AS target FROM scored QUALIFY row_number() OVER (PARTITION BY prompt_id ORDER BY quality_score DESC, sample_index) = 1),
p AS (SELECT id, min(text) AS prompt FROM prompts WHERE text IS NOT NULL GROUP BY id), rows AS (SELECT id, prompt, target FROM p JOIN best USING (id) WHERE target <> '')"""


@query("b04_chat", f"WITH {BEST} SELECT id, 'user' AS first_role, prompt AS first_content, 'assistant' AS second_role, target AS second_content FROM rows")
def b04(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = chat(best_rows(spark, sf_dir))
    return m.select("id", *(F.col("messages")[k][c].alias(f"{name}_{c}") for k, name in ((0, "first"), (1, "second")) for c in ("role", "content")))


@query("b05_completion", f"WITH {BEST} SELECT id, length(prompt) AS prompt_chars, length(target) AS target_chars FROM rows")
def b05(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = completion(best_rows(spark, sf_dir))
    return c.select("id", F.length(F.col("prompt")[0]["content"]).cast("bigint").alias("prompt_chars"), F.length(F.col("completion")[0]["content"]).cast("bigint").alias("target_chars"))


@query("b03_numbered", "WITH d AS (SELECT prompt_id, doc_id, trim(text) AS t FROM documents WHERE prompt_id IS NOT NULL AND trim(text) <> '' QUALIFY row_number() OVER (PARTITION BY prompt_id ORDER BY doc_id) <= 3) SELECT prompt_id, string_agg(k || '. ' || t, chr(10) ORDER BY k) AS list FROM (SELECT prompt_id, t, row_number() OVER (PARTITION BY prompt_id ORDER BY doc_id) AS k FROM d) GROUP BY prompt_id")
def b03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt's first three documents as a numbered list."""
    d = table(spark, sf_dir, "documents").where("prompt_id IS NOT NULL AND trim(text) <> ''").select("prompt_id", F.trim("text").alias("t"), F.row_number().over(Window.partitionBy("prompt_id").orderBy("doc_id")).alias("k")).where("k <= 3")
    items = F.array_sort(F.collect_list(F.struct("k", "t")))
    return d.groupBy("prompt_id").agg(F.array_join(F.transform(items, lambda x: F.concat(x["k"].cast("string"), F.lit(". "), x["t"])), "\n").alias("list"))


@query("b01_canonical", "SELECT DISTINCT id, task, split, sha256(text) AS prompt_hash, prompt_hash = sha256(text) AS bound FROM prompts WHERE text IS NOT NULL")
def b01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts once, their hash computed again."""
    h = F.sha2(F.col("text").cast("binary"), 256)
    return table(spark, sf_dir, "prompts").where("text IS NOT NULL").select("id", "task", "split", h.alias("prompt_hash"), (F.col("prompt_hash") == h).alias("bound")).distinct()


@query("b15_effective", "SELECT DISTINCT id, 'Instruct: Answer with one idea.' || chr(10) || 'Query: ' || trim(text) AS input FROM prompts WHERE text IS NOT NULL")
def b15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts with an instruction in front."""
    return table(spark, sf_dir, "prompts").where("text IS NOT NULL").select("id", F.concat(F.lit("Instruct: Answer with one idea.\nQuery: "), F.trim("text")).alias("input")).distinct()


@query("e46_integrity", f"""WITH {LATEST}, t AS (SELECT trim(text) AS t, len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '')) AS w FROM scored), d AS (SELECT t, count(*) AS n FROM t GROUP BY t)
    SELECT (SELECT count(*) FROM t) AS n, coalesce((SELECT CAST(sum(n) AS BIGINT) FROM d WHERE n > 1), 0) AS repeated, (SELECT count(*) FROM t WHERE w > 100) AS over_limit, (SELECT round(avg(w), 6) FROM t) AS mean_words, (SELECT quantile_cont(w, 0.5) FROM t) AS median_words""")
def e46(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets: how many are repeated, over 100 words, and their words."""
    t = scored(spark, sf_dir).select(F.trim("text").alias("t")).withColumn("w", F.size(F.filter(F.split("t", r"\s+"), lambda x: x != "")))
    by = t.groupBy(F.sha2("t", 256).alias("h")).agg(F.count("*").alias("k"), F.first("w").alias("w")).groupBy("w").agg(F.sum("k").alias("n"), F.sum(F.when(F.col("k") > 1, F.col("k")).otherwise(0)).alias("again"))
    return by.agg(F.sum("n").alias("n"), F.sum("again").alias("repeated"), F.sum(F.when(F.col("w") > 100, F.col("n")).otherwise(0)).alias("over_limit"), F.round(F.sum(F.col("w") * F.col("n")) / F.sum("n"), 6).alias("mean_words"), F.percentile("w", 0.5, F.col("n")).alias("median_words"))


def date_of(node: ET.Element) -> tuple[str, str] | None:
    """A date with its precision; a missing or unknown month or day is 1."""
    text = lambda name: (node.findtext(name) or "").strip()
    year = text("Year") or next(iter(re.findall(r"\b(?:19|20)\d{2}\b", text("MedlineDate"))), "")
    if not year.isdigit():
        return None
    month = int(text("Month")) if text("Month").isdigit() else MONTHS.get(text("Month")[:3].lower(), 1)
    day = int(text("Day")) if text("Day").isdigit() else 1
    return date(int(year), month, day).isoformat(), "day" if text("Day") else "month" if text("Month") else "year"


def public_dates(xml: str) -> list[tuple[str, str, str, str, str]]:
    """(pmid, date, status, precision, source) of each way in which each article of the text became public."""
    out = []
    for article in ET.fromstring(xml).iter("PubmedArticle"):
        pmid = (article.findtext("./MedlineCitation/PMID") or "").strip()
        if not pmid.isdigit():
            raise ValueError("an article has no numeric PMID")
        nodes = [("epublish", "ArticleDate", n) for n in article.iterfind("./MedlineCitation/Article/ArticleDate") if n.get("DateType", "").lower() == "electronic"]
        nodes += [(s, "PubMedHistory", n) for n in article.iterfind("./PubmedData/History/PubMedPubDate") if (s := n.get("PubStatus", "").lower()) in PUBLIC]
        nodes += [("ppublish", "JournalIssue", n) for n in article.iterfind("./MedlineCitation/Article/Journal/JournalIssue/PubDate")]
        out += [(pmid, d[0], status, d[1], source) for status, source, n in nodes if (d := date_of(n))]
    return out


def earliest_public(texts: DataFrame, column: str = "xml") -> DataFrame:
    """Pmid, earliest_public_date, status, precision, source: of each article the first candidate by date, way and source."""
    shape = "array<struct<pmid:string,date:string,status:string,precision:string,source:string>>"
    parsed = F.pandas_udf(lambda s: pd.Series([public_dates(x) if x else [] for x in s]), shape)
    c = texts.select(F.explode(parsed(column)).alias("c")).select("c.*").distinct()
    way = F.element_at(F.create_map(*(F.lit(x) for p in PUBLIC.items() for x in p)), F.col("status"))
    first = c.groupBy("pmid").agg(F.min(F.struct("date", way.alias("way"), "source", "status", "precision")).alias("x"))
    return first.select("pmid", F.to_date("x.date").alias("earliest_public_date"), "x.status", "x.precision", "x.source")


@query(
    "e45_availability",
    """WITH d AS (SELECT CAST(o_orderkey + 10000000 AS VARCHAR) AS pmid, o_orderstatus AS split, min(CAST(o_orderdate AS DATE)) AS first FROM orders GROUP BY ALL), c AS (SELECT unnest(['1994-01-01', '1996-01-01', '1998-01-01']::DATE[]) AS cutoff)
    SELECT split, cutoff, count(*) AS n, count(*) FILTER (first <= cutoff) AS public, round(avg(CASE WHEN first <= cutoff THEN 1.0 ELSE 0 END), 6) AS share FROM d, c GROUP BY split, cutoff""",
)
def e45(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An XML record is written for every order, parsed, and the articles public by each of three cutoffs are counted by split."""
    day = F.date_format("o_orderdate", "yyyy"), F.date_format("o_orderdate", "MM"), F.date_format("o_orderdate", "dd")
    pmid = (F.col("o_orderkey") + 10_000_000).cast("string")
    xml = F.concat(F.lit("<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>"), pmid, F.lit('</PMID><Article><ArticleDate DateType="Electronic"><Year>'), day[0], F.lit("</Year><Month>"), day[1], F.lit("</Month><Day>"), day[2], F.lit("</Day></ArticleDate></Article></MedlineCitation></PubmedArticle></PubmedArticleSet>"))
    orders = table(spark, sf_dir, "orders")
    dates = earliest_public(orders.select(xml.alias("xml")))
    rows = orders.select(pmid.alias("pmid"), F.col("o_orderstatus").alias("split")).distinct().join(dates, "pmid")
    cut = F.explode(F.array(*(F.lit(x).cast("date") for x in ("1994-01-01", "1996-01-01", "1998-01-01")))).alias("cutoff")
    ok = F.col("earliest_public_date") <= F.col("cutoff")
    return rows.select("split", "earliest_public_date", cut).groupBy("split", "cutoff").agg(F.count("*").alias("n"), F.count_if(ok).alias("public"), F.round(F.avg(ok.cast("double")), 6).alias("share"))


@query("o11_ids", "WITH h AS (SELECT sha256(id) AS h FROM (SELECT DISTINCT id FROM prompts)) SELECT count(*) AS n, CAST(sum(CAST(('0x' || substr(h, 1, 15))::BIGINT AS HUGEINT)) AS VARCHAR) AS a, CAST(sum(CAST(('0x' || substr(h, 16, 15))::BIGINT AS HUGEINT)) AS VARCHAR) AS b FROM h")
def o11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fingerprint of the set of ids: its size and two sums over parts of their hashes, so ids are never gathered in one place."""
    h = table(spark, sf_dir, "prompts").select("id").distinct().select(F.sha2("id", 256).alias("h"))
    part = lambda at: F.sum(F.conv(F.substring("h", at, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return h.agg(F.count("*").alias("n"), part(1).alias("a"), part(16).alias("b"))


@query("o06_config", "SELECT config_hash, sha256('{\"max_new_tokens\":' || max_new_tokens || ',\"model\":\"' || model || '\",\"seed\":' || seed || '}') AS fingerprint FROM generation_specs")
def o06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash of a configuration's JSON with sorted keys and without blanks."""
    body = F.to_json(F.struct("max_new_tokens", "model", "seed"))
    return table(spark, sf_dir, "generation_specs").select("config_hash", F.sha2(body, 256).alias("fingerprint"))



def normalised_quality(*dimensions: str):
    """The mean of ratings from 1 to 5, taken to 0 to 1."""
    return (sum((F.col(d) for d in dimensions[1:]), F.col(dimensions[0])) / len(dimensions) - 1) / 4
