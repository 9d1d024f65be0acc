"""JSON sources and sinks (A01 to A03, A06 to A08, A22 to A25, K01 to K03, K08): strict scans that fail closed, shards of one prompt each, and metric rows with a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.operators.constraints import Violated, must, unique


def scan(spark: SparkSession, path: str, schema: str, key: str | None = None, rows: int | None = None) -> DataFrame:
    """Lines of JSON of exactly this schema; blank lines are skipped. Malformed lines fail the job, repeated keys and a wrong number of rows raise."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if key:
        must(unique(df, key), f"{key} is unique")
    if rows is not None and (n := df.count()) != rows:
        raise Violated(f"{n} rows, not {rows}")
    return df


def first_lines(spark: SparkSession, path: str, schema: str, n: int) -> DataFrame:
    """The first n lines that aren't blank, in the order of the file; fewer raise. Reading stops at n, no other line is parsed."""
    lines = spark.read.text(path).where("trim(value) <> ''").limit(n)
    parsed = lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("x")).select("x.*")
    if parsed.count() < n:
        raise Violated(f"fewer than {n} rows")
    return parsed


RECORD = "prompt_id STRING, sample_index INT, text STRING, finish_reason STRING, model STRING, request_id STRING, config_hash STRING, prompt_tokens BIGINT, completion_tokens BIGINT"
SHARD = f"schema_version INT, prompt_id STRING, config_hash STRING, records ARRAY<STRUCT<{', '.join(f'{a}: {b}' for a, b in (f.split(' ') for f in RECORD.split(', ')))}>>"


def shards(spark: SparkSession, path: str, config_hash: str, version: int = 1) -> DataFrame:
    """The records of a folder of shards, one JSON file a prompt; another version or configuration, or sample indices that aren't 0 to n - 1, raise."""
    df = spark.read.schema(SHARD).option("mode", "FAILFAST").option("multiLine", True).json(path)
    must(df.where((F.col("schema_version") != version) | ~F.col("config_hash").eqNullSafe(config_hash)).select("prompt_id"), "version and configuration")
    indices = F.array_sort(F.transform("records", lambda r: r["sample_index"]))
    must(df.where(~indices.eqNullSafe(F.sequence(F.lit(0), F.size("records") - 1).cast("array<int>"))).select("prompt_id"), "sample indices from 0")
    must(unique(df, "prompt_id"), "a shard a prompt")
    return df.select(F.explode("records").alias("r")).select("r.*")


def prefix(records: DataFrame, k: int) -> DataFrame:
    """The first k samples of each prompt."""
    return records.where(F.col("sample_index") < k)


def write_shards(records: DataFrame, path: str, config_hash: str, version: int = 1) -> None:
    """One folder of JSON a prompt, named by the hash of its id; an existing path is never overwritten."""
    names = [f.split(" ")[0] for f in RECORD.split(", ")]
    each = records.groupBy("prompt_id").agg(F.array_sort(F.collect_list(F.struct("sample_index", *(c for c in names if c != "sample_index")))).alias("records"))
    out = each.select(F.lit(version).alias("schema_version"), "prompt_id", F.lit(config_hash).alias("config_hash"), F.transform("records", lambda r: F.struct(*(r[c].alias(c) for c in names))).alias("records"), F.sha2("prompt_id", 256).alias("shard"))
    out.write.mode("errorifexists").partitionBy("shard").json(path)


def write_metrics(rows: DataFrame, path: str) -> DataFrame:
    """Rows as JSON lines, and a manifest of rows and a fingerprint that doesn't depend on their order."""
    rows.write.mode("errorifexists").json(path)
    body = F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256)
    return rows.select(F.conv(F.substring(body, 1, 15), 16, 10).cast("decimal(38,0)").alias("h")).agg(F.count("*").alias("rows"), F.sum("h").cast("string").alias("fingerprint"))


def lookup(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The one row of this key; none or several raise."""
    found = rows.where(F.col(key) == value)
    if (n := found.limit(2).count()) != 1:
        raise Violated(f"{n or 'no'} row{'s' * (n > 1)} with {key} = {value}")
    return found


def bind(spark: SparkSession, inputs: list[str], schema: str) -> DataFrame:
    """METHOD=PATH or METHOD:SEED=PATH inputs as one table with method and seed; a name given twice raises."""
    named = [(i.partition("=")[0], i.partition("=")[2]) for i in inputs]
    if len({n for n, _ in named}) < len(named) or any(not n or not p for n, p in named):
        raise Violated("inputs must be METHOD[:SEED]=PATH, each once")
    out = None
    for name, path in named:
        method, _, seed = name.partition(":")
        df = spark.read.schema(schema).option("mode", "FAILFAST").json(path).select(F.lit(method).alias("method"), F.lit(int(seed) if seed else None).cast("int").alias("seed"), "*")
        out = df if out is None else out.unionByName(df)
    return out
