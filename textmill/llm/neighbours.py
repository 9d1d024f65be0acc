"""The most similar vectors of each vector by a hierarchical k-means tree (problem 3)."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmill.lineage import bucket, only, settle, table

#: Vectors that the tree is fitted on (of lowest hash, so a fixed sample), branches of a node, vectors wished for in a leaf,
#: calibration queries (compared with all vectors), the recall they must reach, vectors of a block of base vectors in a task.
SAMPLE, BRANCHES, LEAF, ASKED, RECALL, BLOCK = 32_768, 8, 256, 512, 0.9995, 8_192
#: Queries whose distances a task holds at a time, and rows of questions that it sends at a time.
AT_ONCE, SENT = 256, 16_384
#: A cell of a large table holds up to so many blocks, as long as there are so many cells: the fewer they are, the fewer each query is sent to.
WIDE, CELLS = 4, 24


@dataclass
class Tree:
    """Nodes with their centroids; node 0 is the root, a node without children a leaf. Its size is bounded by SAMPLE."""

    centroids: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)
    leaves: int = 0

    def grow(self, x: np.ndarray, wished: float, rng: np.random.Generator) -> int:
        """Adds a node over the rows of x, split until a leaf stands for at most wished of them."""
        at = len(self.centroids)
        centre = x.mean(axis=0)
        self.centroids.append(centre / max(np.linalg.norm(centre), 1e-12))
        self.children.append([])
        self.leaf.append(-1)
        parts = []
        if len(x) > wished:
            own = spherical(x, min(BRANCHES, math.ceil(len(x) / wished)), rng)
            parts = [x[own == k] for k in np.unique(own)]
        if len(parts) > 1:
            self.children[at] = [self.grow(p, wished, rng) for p in parts]
        else:
            self.leaf[at], self.leaves = self.leaves, self.leaves + 1
        return at

    def routed(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: at each node the nearest child."""
        out, c = np.empty(len(x), np.int32), np.stack(self.centroids).astype(np.float32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node]:
                out[rows] = self.leaf[node]
                continue
            kids = self.children[node]
            best = (x[rows].astype(np.float32) @ c[kids].T).argmax(axis=1)
            todo += [(kid, rows[best == k]) for k, kid in enumerate(kids) if (best == k).any()]
        return out

    def visited(self, x: np.ndarray, most: int) -> Iterator[list[int]]:
        """For each row the first most leaves of a best-bin-first walk: a priority queue holds the nodes not yet entered, the nearest goes first."""
        c = np.stack(self.centroids).astype(np.float32).T
        # Distances to all nodes are held for few rows at a time: a batch times the nodes of a large tree is gigabytes of numbers in Python.
        for i in range(0, len(x), AT_ONCE):
            for row in -(x[i : i + AT_ONCE].astype(np.float32) @ c):
                d, queue, leaves = row.tolist(), [(0.0, 0)], []
                while queue and len(leaves) < most:
                    _, node = heapq.heappop(queue)
                    if kids := self.children[node]:
                        for k in kids:
                            heapq.heappush(queue, (d[k], k))
                    else:
                        leaves.append(self.leaf[node])
                yield leaves


def spherical(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """k-means by cosine: the cluster of each row."""
    c = x[rng.choice(len(x), k, replace=False)]
    own = np.zeros(len(x), int)
    for _ in range(rounds):
        new = (x @ c.T).argmax(axis=1)
        if (new == own).all():
            break
        own = new
        for j in range(k):
            if (own == j).any():
                c[j] = x[own == j].mean(axis=0)
                c[j] /= max(np.linalg.norm(c[j]), 1e-12)
    return own


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of unit length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def best(q: np.ndarray, base: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and cosines of the k rows of base most similar to each row of q; of equal cosines the lower id.

    A few more are chosen in single precision, then compared in double precision; copies of one vector are k at most here."""
    s = q.astype(np.float32) @ base.astype(np.float32).T
    k, m = min(k, len(base)), min(2 * k + 2, len(base))
    top = np.argpartition(-s, m - 1, axis=1)[:, :m] if m < len(base) else np.broadcast_to(np.arange(m), (len(q), m))
    exact = np.round(np.einsum("qd,qmd->qm", q, base[top]), 12)
    order = np.lexsort((ids[top], -exact), axis=1)[:, :k]
    return np.take_along_axis(ids[top], order, 1), np.take_along_axis(exact, order, 1)


def valid(vectors: DataFrame, size: int) -> DataFrame:
    e = F.col("embedding")
    rows = only(vectors, "vec_id", "embedding")
    return rows.where(e.isNotNull() & (F.size(e) == size) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x)) & F.exists(e, lambda x: x != 0) & F.col("vec_id").isNotNull())


NEAR = "q BIGINT, near ARRAY<STRUCT<far: DOUBLE, id: BIGINT, leaf: INT>>"


def merged(near: DataFrame, k: int) -> DataFrame:
    """q, near: the k nearest of all lists of each query; a list has k at most and there is one for each task that a query visits."""
    return near.groupBy("q").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k).alias("near"))


def near_column(ids: np.ndarray, cosines: np.ndarray, leaf: np.ndarray | None) -> pa.Array:
    flat = pa.StructArray.from_arrays([pa.array(-cosines.ravel().astype(np.float64)), pa.array(ids.ravel().astype(np.int64)), pa.array((np.zeros(ids.size) if leaf is None else leaf.ravel()).astype(np.int32))], ["far", "id", "leaf"])
    return pa.ListArray.from_arrays(pa.array(np.arange(0, ids.size + 1, max(1, ids.shape[1])).astype(np.int32)), flat)


def calibrated(tree: Tree, placed: DataFrame, k: int, asked: int, recall: float) -> int:
    """How many leaves a query must visit so that the share of true neighbours found reaches recall.

    asked queries (those of lowest hash) are compared with every vector, task by task; the visits are widened leaf by leaf until enough of their true neighbours lie in the leaves visited."""
    sample = placed.orderBy(F.xxhash64(F.lit(7), "vec_id"), "vec_id").limit(asked).select("vec_id", "embedding").toArrow()
    if sample.num_rows < 2:
        return 1
    q, own = matrix(sample.column("embedding")), sample.column("vec_id").to_numpy()

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ids = b.column("vec_id").to_numpy()
                leaf = dict(zip(ids.tolist(), b.column("leaf").to_pylist(), strict=True))
                near, cosine = best(q, matrix(b.column("embedding")), ids, k + 1)
                where = np.vectorize(leaf.__getitem__)(near)
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64)), near_column(near, cosine, where)], ["q", "near"])

    true = merged(placed.select("vec_id", "embedding", "leaf").mapInArrow(compared, NEAR), k + 1).toArrow().to_pylist()
    leaves = {r["q"]: [x["leaf"] for x in r["near"] if x["id"] != r["q"]][:k] for r in true}
    ranks = [order.index(leaf) for i, order in zip(own.tolist(), tree.visited(q, tree.leaves), strict=True) for leaf in leaves[i]]
    ranks.sort()
    return ranks[max(0, math.ceil(recall * len(ranks)) - 1)] + 1


def answered(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """q, near for each query: of rows in the order of cell and asks, those of a cell that don't ask are held, and the queries after them are answered as they come."""
    at, held, base = None, [], None
    for b in batches:
        cells, asks = b.column("cell").to_numpy(), b.column("asks").to_numpy(zero_copy_only=False)
        edges = [0, *(np.nonzero((np.diff(cells) != 0) | (asks[1:] != asks[:-1]))[0] + 1).tolist(), len(cells)]
        for lo, hi in zip(edges, edges[1:]):
            if lo == hi:
                continue
            if cells[lo] != at:
                at, held, base = cells[lo], [], None
            if not asks[lo]:
                held.append(b.slice(lo, hi - lo))
            elif held:
                base = base or block(held)
                yield pa.RecordBatch.from_arrays([b.column("vec_id").slice(lo, hi - lo), nearest(b.slice(lo, hi - lo), *base, k)], ["q", "near"])


def block(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """The vectors and ids of a cell, and its rows by leaf."""
    base = pa.Table.from_batches(held).sort_by("vec_id")
    leaf = base.column("leaves").combine_chunks().flatten().to_numpy()  # one each
    order = np.argsort(leaf, kind="stable")
    names, at = np.unique(leaf[order], return_index=True)
    return matrix(base.column("embedding")), base.column("vec_id").to_numpy(), dict(zip(names.tolist(), np.split(order, at[1:]), strict=True))


def nearest(ask: pa.RecordBatch, x: np.ndarray, ids: np.ndarray, rows_of: dict[int, np.ndarray], k: int) -> pa.Array:
    """The k nearest of each query in the leaves that it asks for; places without one have a distance of 9."""
    q = matrix(ask.column("embedding"))
    wanted: dict[int, list[int]] = {}
    for r, leaves in enumerate(ask.column("leaves").to_pylist()):
        for leaf in leaves:
            wanted.setdefault(leaf, []).append(r)
    kept_id, kept_far = np.full((len(q), k), np.iinfo(np.int64).max), np.full((len(q), k), 9.0)
    for leaf, asking in wanted.items():
        rows = rows_of.get(leaf)
        if rows is None:
            continue
        base, step = x[rows], max(1, 1024 * BLOCK // max(BLOCK, len(rows)))
        for i in range(0, len(asking), step):
            own = np.array(asking[i : i + step])
            a, c = best(q[own], base, ids[rows], k)
            both_id, both_far = np.concatenate([kept_id[own], a], 1), np.concatenate([kept_far[own], -c.astype(np.float64)], 1)
            first_k = np.lexsort((both_id, both_far), axis=1)[:, :k]
            kept_id[own], kept_far[own] = np.take_along_axis(both_id, first_k, 1), np.take_along_axis(both_far, first_k, 1)
    return near_column(kept_id, -kept_far, None)


def neighbours(vectors: DataFrame, k: int = 5, size: int = 64, sample: int = SAMPLE, leaf_size: int = LEAF, asked: int = ASKED, recall: float = RECALL) -> DataFrame:
    """vec_a, vec_b, cosine: for each valid vector the k others of highest cosine, of equal ones those of lowest vec_id, within the recall that was calibrated.

    A vector is valid if it and its vec_id aren't null, it has size elements, none null or NaN, and isn't all zeros. Fewer than k others give fewer rows, an empty table none.
    The driver fits a tree on a bounded sample; every vector is put in its leaf. Queries go to the leaves of a best-bin-first walk. A leaf of more vectors than a cell
    holds is compared in parts. A task holds one cell and one batch of the queries that ask for it, however many there are. Equal vectors are searched once, with the k + 1 of lowest vec_id standing for all, so that a vector with many copies costs no more than others."""
    v = valid(vectors, size).withColumn("copy", F.array(F.xxhash64("embedding"), F.xxhash64(F.lit(1), "embedding")))
    v = settle(v.withColumn("nth", F.row_number().over(Window.partitionBy("copy").orderBy("vec_id"))).where(F.col("nth") <= k + 1))
    members = valid(vectors, size).select("vec_id", F.array(F.xxhash64("embedding"), F.xxhash64(F.lit(1), "embedding")).alias("copy"))
    n = v.count()
    if n < 2:
        return v.sparkSession.createDataFrame([], "vec_a BIGINT, vec_b BIGINT, cosine DOUBLE")
    fitted = matrix(v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toArrow().column("embedding"))
    tree = Tree()
    tree.grow(fitted, max(16, leaf_size * len(fitted) / n), np.random.default_rng(7))

    def placing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = tree.routed(matrix(b.column("embedding"))) if b.num_rows else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf, pa.int32())], ["vec_id", "embedding", "nth", "leaf"])

    placed = settle(v.select("vec_id", "embedding", "nth").mapInArrow(placing, "vec_id BIGINT, embedding ARRAY<FLOAT>, nth INT, leaf INT"))
    visits = calibrated(tree, placed, k, asked, recall)
    counts = {r["leaf"]: r["count"] for r in placed.groupBy("leaf").count().collect()}  # a number for each leaf of the bounded tree
    # Leaves that lie side by side in the tree share a cell, a large one has several; a query visits each cell once, with the leaves it asks for.
    most = max(BLOCK, min(WIDE * BLOCK, n // CELLS))
    first, parts, cells, room = {}, {}, 0, 0
    for leaf in range(tree.leaves):
        c = counts.get(leaf, 0)
        if c > most:
            cells, room = cells + (room > 0), 0
            first[leaf], parts[leaf] = cells, math.ceil(c / most)
            cells += parts[leaf]
        else:
            if room + c > most:
                cells, room = cells + 1, 0
            first[leaf], parts[leaf] = cells, 1
            room += c
    start, many = np.array([first[x] for x in range(tree.leaves)]), np.array([parts[x] for x in range(tree.leaves)])

    def mix(ids: np.ndarray) -> np.ndarray:
        return (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)

    names = ["cell", "vec_id", "embedding", "leaves", "asks"]

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids, leaf = b.column("vec_id").to_numpy(), b.column("leaf").to_numpy()
            cell = start[leaf] + (mix(ids) % many[leaf].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(ids), b.column("embedding"), pa.array([[x] for x in leaf.tolist()], pa.list_(pa.int32())), pa.array([False] * len(ids))], names)
            asking = np.nonzero(b.column("nth").to_numpy() == 1)[0]
            if len(asking):
                q, out = matrix(b.column("embedding"))[asking], []
                for r, leaves in zip(asking.tolist(), tree.visited(q, visits), strict=True):
                    to: dict[int, list[int]] = {}
                    for x in leaves:
                        for j in range(int(many[x])):
                            to.setdefault(int(start[x]) + j, []).append(x)
                    out += [(c, r, xs) for c, xs in to.items()]
                    if len(out) >= SENT:
                        yield questions(b, ids, out)
                        out = []
                if out:
                    yield questions(b, ids, out)

    def questions(b: pa.RecordBatch, ids: np.ndarray, out: list[tuple[int, int, list[int]]]) -> pa.RecordBatch:
        c, r, xs = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(ids[list(r)]), b.column("embedding").take(pa.array(r)), pa.array(xs, pa.list_(pa.int32())), pa.array([True] * len(r))], names)

    rows = placed.mapInArrow(sent, "cell INT, vec_id BIGINT, embedding ARRAY<FLOAT>, leaves ARRAY<INT>, asks BOOLEAN")
    near = rows.repartition("cell").sortWithinPartitions("cell", "asks").mapInArrow(lambda batches: answered(batches, k + 1), NEAR)
    near = merged(near.withColumn("near", F.filter("near", lambda x: x["far"] < 5)), k + 1)
    lists = near.join(v.where("nth = 1").select(F.col("vec_id").alias("q"), "copy"), "q").select("copy", "near")
    each = members.join(lists, "copy").select(F.col("vec_id").alias("vec_a"), F.explode(F.slice(F.filter("near", lambda x: x["id"] != F.col("vec_id")), 1, k)).alias("x"))
    return each.select("vec_a", F.col("x.id").alias("vec_b"), (-F.col("x.far")).alias("cosine"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = neighbours(table(spark, sf_dir, "text_vectors"))
    return near.select(F.least("vec_a", "vec_b").alias("vec_a"), F.greatest("vec_a", "vec_b").alias("vec_b")).distinct()


def p3_recall(spark: SparkSession, sf_dir: str, k: int = 5, size: int = 64) -> DataFrame:
    """queries, recall: of the vectors whose vec_id is divisible by 100, the share of their true neighbours (all vectors compared, in blocks) that the search finds."""
    vectors = valid(table(spark, sf_dir, "text_vectors"), size)
    found = neighbours(table(spark, sf_dir, "text_vectors"), k, size).where("vec_a % 100 = 0").select("vec_a", "vec_b")
    asked, blocks = vectors.where("vec_id % 100 = 0"), 16
    q = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("asks", F.lit(True)).withColumn("slice", bucket(4, "vec_id"))
    b = vectors.withColumn("block", bucket(blocks, "vec_id")).withColumn("asks", F.lit(False)).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(3))))

    def compared(t: pa.Table) -> pa.Table:
        base, ask = t.filter(pc.invert(t.column("asks"))).sort_by("vec_id"), t.filter(t.column("asks"))
        if not base.num_rows or not ask.num_rows:
            return pa.table({"q": pa.array([], pa.int64()), "near": near_column(np.empty((0, 1)), np.empty((0, 1)), None)})
        ids, cosine = best(matrix(ask.column("embedding")), matrix(base.column("embedding")), base.column("vec_id").to_numpy(), k + 1)
        return pa.table({"q": ask.column("vec_id"), "near": near_column(ids, cosine, None)})

    true = merged(q.union(b.select(q.columns)).groupBy("block", "slice").applyInArrow(compared, NEAR), k + 1)
    true = true.select(F.col("q").alias("vec_a"), F.explode(F.slice(F.filter("near", lambda x: x["id"] != F.col("q")), 1, k)).alias("x")).select("vec_a", F.col("x.id").alias("vec_b"))
    hit = true.join(found.withColumn("hit", F.lit(1)), ["vec_a", "vec_b"], "left")
    return hit.agg(F.count_distinct("vec_a").alias("queries"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
