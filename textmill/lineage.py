"""Helpers that every operator shares: column choice, lineage cuts and table scans."""

from __future__ import annotations

import tempfile
import zipfile
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@cache
def ship(application: str, spark: SparkSession) -> None:
    """Gives this package's code to the executors, which need not have it installed; once for each application."""
    root, file = Path(__file__).resolve().parent, Path(tempfile.mkdtemp(prefix="code-")) / f"{__package__}.zip"
    with zipfile.ZipFile(file, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(file))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark.sparkContext.applicationId, spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone. Where others differ from them only in case, the name as written is taken (of equal names the first)."""
    cols = df.columns
    if len({c.lower() for c in cols}) == len(cols):
        return df.select(*names)
    plain = df.toDF(*(f"c{i}" for i in range(len(cols))))
    return plain.select(*(F.col(f"c{cols.index(n)}").alias(n) for n in names))


def settle(df: DataFrame) -> DataFrame:
    """df computed once and kept in the cluster's shared checkpoint folder, which outlives executors.

    The folder is the session's spark.checkpoint.dir; only where that is unset (tests on one machine) is one made here."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


def bucket(n: int | Column, *cols: str) -> Column:
    """A number under n that depends on the columns' values only."""
    return F.pmod(F.xxhash64(*cols), F.lit(n) if isinstance(n, int) else n).cast("int")
