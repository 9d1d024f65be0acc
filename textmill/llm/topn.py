"""The N best items of each group by bounded heaps, merged (problem 2)."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.lineage import only, table

#: Groups that a worker holds before it passes their heaps on as they are; heaps of one group merge later.
HELD = 200_000


def heaps(batches: Iterator[pa.RecordBatch], n: int, grouped: bool) -> Iterator[pa.RecordBatch]:
    """Rows (g, score, id) of each group's heap, which holds the n best rows seen: the higher score, then the lower id.

    grouped: the rows of a group stand together, so that a group is passed on, with its rows in order and their place, once it ends."""
    held: dict[object, list[tuple[float, object]]] = {}
    schema = None

    def passed(groups: list) -> pa.RecordBatch:
        rows = [(g, s, -i, place) for g in groups for place, (s, i) in enumerate(sorted(held.pop(g), reverse=True), 1)]
        columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, schema, strict=True)], ["g", "score", "id", "place"])

    for b in batches:
        schema = [b.column("g").type, pa.float64(), pa.int64(), pa.int32()]
        if not b.num_rows:
            continue
        code = b.column("g").dictionary_encode(null_encoding="encode")
        names, at = code.dictionary.to_pylist(), code.indices.to_numpy(zero_copy_only=False)
        score, ident = b.column("score").to_numpy(zero_copy_only=False), b.column("id").to_numpy(zero_copy_only=False)
        # Within the batch only the n best of a group can enter its heap.
        order = np.lexsort((ident, -score, at))
        own = at[order]
        first = np.r_[True, own[1:] != own[:-1]]
        rank = np.arange(len(own)) - np.maximum.accumulate(np.where(first, np.arange(len(own)), 0))
        for k in order[rank < n].tolist():
            heap, item = held.setdefault(names[at[k]], []), (float(score[k]), -int(ident[k]))
            if len(heap) < n:
                heapq.heappush(heap, item)
            elif item > heap[0]:
                heapq.heapreplace(heap, item)
        if grouped:
            last = names[at[-1]]
            yield passed([g for g in held if g != last])
        elif len(held) > HELD:
            yield passed(list(held))
    if held:
        yield passed(list(held))


def top_n(items: DataFrame, group: str, score: str, ident: str, n: int) -> DataFrame:
    """group, place (1 to n), ident, score: the n rows of highest score of each group, of equal scores those of lowest ident.

    Rows whose score or ident is null, or whose score is NaN, get no place; rows whose group is null are a group.
    ident is a whole number that is unique in its group. Smaller groups give fewer rows, an empty table none.
    Heaps are built where the rows are; at most n rows a group and task are shuffled, so a group of any size is spread over the tasks that read it."""
    kind = items.schema[group].dataType.simpleString()
    rows = items.select(F.col(group).alias("g"), F.col(score).cast("double").alias("score"), F.col(ident).cast("bigint").alias("id"))
    rows = rows.where("score IS NOT NULL AND NOT isnan(score) AND id IS NOT NULL")
    shape = f"g {kind}, score DOUBLE, id BIGINT, place INT"
    built = rows.mapInArrow(lambda b: heaps(b, n, False), shape).drop("place")
    merged = built.repartition("g").sortWithinPartitions("g").mapInArrow(lambda b: heaps(b, n, True), shape)
    return merged.select(F.col("g").alias(group), "place", F.col("id").cast(items.schema[ident].dataType).alias(ident), F.col("score").alias(score))


def latest_scores(samples: DataFrame) -> DataFrame:
    """prompt_id, sample_index, quality_score: of each sample the row with the latest scored_at; of several at one time the highest score. Shuffles on both keys, which splits a large prompt."""
    rows = only(samples, "prompt_id", "sample_index", "quality_score", "scored_at")
    return rows.groupBy("prompt_id", "sample_index").agg(F.max(F.struct("scored_at", "quality_score"))["quality_score"].alias("quality_score"))


def top_samples(samples: DataFrame, n: int = 3) -> DataFrame:
    """prompt_id, place, sample_index of the n samples of highest quality_score from 0 to 1 of each prompt."""
    valid = latest_scores(samples).where(F.col("quality_score").between(0, 1) & ~F.isnan("quality_score"))
    return top_n(valid, "prompt_id", "quality_score", "sample_index", n).select("prompt_id", "place", "sample_index")


P2_SQL = """
WITH latest AS (
  SELECT prompt_id, sample_index, quality_score
  FROM teacher_generations
  QUALIFY row_number() OVER (PARTITION BY prompt_id, sample_index ORDER BY scored_at DESC NULLS LAST, quality_score DESC NULLS LAST) = 1
), placed AS (
  SELECT prompt_id, sample_index,
         CAST(row_number() OVER (PARTITION BY prompt_id ORDER BY quality_score DESC, sample_index) AS INTEGER) AS place
  FROM latest
  WHERE quality_score IS NOT NULL AND NOT isnan(quality_score) AND quality_score BETWEEN 0 AND 1
)
SELECT prompt_id, place, sample_index FROM placed WHERE place <= 3
"""


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_samples(table(spark, sf_dir, "teacher_generations"))
