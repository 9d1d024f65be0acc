"""Items put into containers of fixed capacity, best-fit decreasing (problem 8)."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmill.lineage import bucket, settle, table
from textmill.llm.tokens import sized

ROOM = 2048


class OpenBins:
    """Open containers by remaining capacity: runs of container numbers at each capacity, and a segment tree over the capacities that finds the tightest one that holds an item in logarithmic time."""

    def __init__(self, room: int) -> None:
        self.width = 1 << room.bit_length()
        self.some = [False] * (2 * self.width)
        self.runs: list[deque[tuple[int, int]]] = [deque() for _ in range(room + 1)]

    def mark(self, capacity: int) -> None:
        at = self.width + capacity
        self.some[at] = bool(self.runs[capacity])
        while at > 1:
            at //= 2
            self.some[at] = self.some[2 * at] or self.some[2 * at + 1]

    def put(self, capacity: int, first: int, n: int) -> None:
        self.runs[capacity].append((first, n))
        self.mark(capacity)

    def tightest(self, size: int) -> int | None:
        """The least capacity of at least size that an open container has."""
        at = self.width + size
        if self.some[at]:
            return size
        while at > 1:
            if at % 2 == 0 and self.some[at + 1]:
                at += 1
                while at < self.width:
                    at = 2 * at if self.some[2 * at] else 2 * at + 1
                return at - self.width
            at //= 2
        return None

    def take(self, capacity: int, most: int) -> tuple[int, int]:
        """The first up to most containers of a run of this capacity."""
        first, n = self.runs[capacity].popleft()
        if n > most:
            self.runs[capacity].appendleft((first + most, n - most))
            n = most
        self.mark(capacity)
        return first, n


def best_fit(counts: dict[int, int], room: int = ROOM) -> list[tuple[int, int, int, int, int]]:
    """(size, rank of the first item, items, first container, items to a container) by best-fit decreasing, given how many items have each size.

    It is what best-fit decreasing does item by item: an item goes to the tightest container that holds it, and of the same size
    the next goes to the same container while it fits, since that one is tighter still. So whole runs of equal containers are filled at once:
    the work depends on the number of sizes, not of items."""
    bins, out, opened = OpenBins(room), [], 0
    for size in sorted((s for s in counts if counts[s]), reverse=True):
        left = counts[size]
        while left:
            capacity = bins.tightest(size)
            if capacity is None:
                capacity, each = room, room // size
                n = max(1, left // each)
                first, opened = opened, opened + n
            else:
                each = capacity // size
                first, n = bins.take(capacity, max(1, left // each))
            each = min(each, left)
            out.append((size, counts[size] - left, n * each, first, each))
            left -= n * each
            if rest := capacity - each * size:
                bins.put(rest, first, n)
    return out


def packed(sizes: DataFrame, room: int = ROOM) -> DataFrame:
    """doc_id, piece, n_tokens, container. sizes: doc_id, n_tokens.

    An item larger than room alone is split into pieces of room and a rest; no other is. Items without tokens, or of null size, need no container and give no row.
    Repeated rows are items of their own. Sent to the driver is one number for each of the sizes up to room.
    Items get their rank within their size from counts over slices of it, so that a size that a third of the items have is spread."""
    last = F.floor((F.col("n_tokens") - 1) / room).cast("int")
    pieces = sizes.where("n_tokens > 0").select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    pieces = pieces.withColumn("n_tokens", F.least(F.lit(room), F.col("n_tokens") - F.col("piece").cast("bigint") * room).cast("int"))
    slices = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = pieces.withColumn("slice", bucket(slices, "doc_id"))
    counted = settle(pieces.groupBy("n_tokens", "slice").agg(F.count("*").alias("n")))
    counts = {r["n_tokens"]: r["n"] for r in counted.groupBy("n_tokens").agg(F.sum("n").alias("n")).collect()}
    spark = sizes.sparkSession
    plan = spark.createDataFrame(best_fit(counts, room), "n_tokens INT, start BIGINT, n BIGINT, first BIGINT, each BIGINT")
    before = counted.withColumn("before", F.sum("n").over(Window.partitionBy("n_tokens").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))).drop("n")
    own = F.row_number().over(Window.partitionBy("n_tokens", "slice").orderBy("doc_id", "piece")) - 1
    ranked = pieces.withColumn("own", own).join(before, ["n_tokens", "slice"])  # keeps the window's partitioning
    ranked = ranked.select("doc_id", "piece", "n_tokens", (F.col("own") + F.coalesce("before", F.lit(0))).alias("rank"))
    here = ranked.join(F.broadcast(plan), "n_tokens").where("rank >= start AND rank < start + n")
    return here.select("doc_id", "piece", "n_tokens", F.expr("first + (rank - start) div each").alias("container"))


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(settle(sized(table(spark, sf_dir, "documents"))))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """containers, the least number that the tokens need (lower_bound), and the share of the containers' room in use."""
    by = p8_packed(spark, sf_dir).agg(F.count_distinct("container").alias("containers"), F.sum("n_tokens").alias("tokens"))
    return by.select("containers", F.ceil(F.col("tokens") / ROOM).alias("lower_bound"), (F.col("tokens") / (F.col("containers") * ROOM)).alias("fill"))
