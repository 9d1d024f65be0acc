"""Vectors and modes: cosines within and between sets, complete linkage, anchored assignment, coverage, distinct subsets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmill.functions.columns import divergence, jaccard_distance, words_of
from textmill.lineage import bucket, settle, table
from textmill.operators.views import LATEST, RECORDS, latest, records, scored
from textmill.plans.registry import query

R = lambda c: F.round(c, 6)
SIZE = 64
#: Rows of a block where a large group is compared with itself block by block.
BLOCK = 512
VALID = """vectors AS (SELECT vec_id, text_sha256, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM text_vectors
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
units AS (SELECT vec_id, text_sha256, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM vectors)"""
PLACED = f"""{LATEST}, {VALID}, placed AS (SELECT l.prompt_id, l.sample_index, l.quality_score, min(u.vec_id) AS vec_id, arg_min(u.e, u.vec_id) AS e FROM latest l JOIN units u ON u.text_sha256 = sha256(l.text) GROUP BY ALL)"""


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def units(vectors: DataFrame, size: int = SIZE) -> DataFrame:
    """Vectors of unit length; null, of other size, with null or NaN, or all zeros they are rejected."""
    e = F.col("embedding")
    ok = vectors.where(e.isNotNull() & (F.size(e) == size) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x)) & F.exists(e, lambda x: x != 0))
    wide = ok.withColumn("e", e.cast("array<double>")).withColumn("norm", F.sqrt(dot(F.col("e"), F.col("e"))))
    return wide.select("vec_id", "text_sha256", F.transform("e", lambda x: x / F.col("norm")).alias("e"))


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each latest sample that has a vector, with it (of several the least vec_id, chosen before the join, so that many vectors of a text that many samples have make no product)."""
    u = units(table(spark, sf_dir, "text_vectors")).groupBy("text_sha256").agg(F.min("vec_id").alias("vec_id"), F.min_by("e", "vec_id").alias("e"))
    rows = latest(table(spark, sf_dir, "teacher_generations")).withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256))
    return rows.join(u, "text_sha256").select("prompt_id", "sample_index", "quality_score", "vec_id", "e")


@query("i01_rejected", f"WITH {VALID} SELECT (SELECT count(*) FROM text_vectors) - (SELECT count(*) FROM units) AS rejected, (SELECT count(*) FROM units) AS valid")
def i01(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "text_vectors")
    a, b = v.agg(F.count("*").alias("total")), units(v).agg(F.count("*").alias("valid"))
    return a.crossJoin(b).select((F.col("total") - F.col("valid")).alias("rejected"), "valid")  # one row by one


@query("i04_cohesion", f"WITH {PLACED}, s AS (SELECT prompt_id, count(DISTINCT sample_index) AS n, avg(list_dot_product(e, e)) AS o FROM placed GROUP BY prompt_id) SELECT a.prompt_id, round(avg(list_dot_product(a.e, b.e)), 5) AS mean_cosine, count(*) AS pairs FROM placed a JOIN placed b ON a.prompt_id = b.prompt_id AND a.sample_index < b.sample_index GROUP BY a.prompt_id")
def i04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean cosine of the pairs of each prompt, from the length of the summed vector: (|sum|^2 - n) / (n (n - 1)), so no pair is made."""
    each = placed(spark, sf_dir).select("prompt_id", F.posexplode("e").alias("k", "x"))
    sums = each.groupBy("prompt_id", "k").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))
    by = sums.groupBy("prompt_id").agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum("q").alias("qq"), F.max("n").alias("n")).where("n > 1")
    return by.select("prompt_id", F.round((F.col("ss") - F.col("qq")) / (F.col("n") * (F.col("n") - 1)), 5).alias("mean_cosine"), F.expr("n * (n - 1) div 2").alias("pairs"))


def blocked(rows: DataFrame, group: str, ident: str) -> DataFrame:
    """left and right rows of each group's blocks, each two blocks once: a group of any size is spread over (blocks squared) / 2 tasks."""
    sizes = rows.groupBy(group).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = rows.join(sizes, group).withColumn("block", bucket(F.col("blocks"), ident))
    each = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return each.select(group, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", *(c for c in rows.columns if c != group))


@query("e49_extremes", f"WITH {PLACED} SELECT a.prompt_id, count(*) AS pairs, round(min(list_dot_product(a.e, b.e)), 5) AS least, round(max(list_dot_product(a.e, b.e)), 5) AS most FROM placed a JOIN placed b ON a.prompt_id = b.prompt_id AND a.sample_index < b.sample_index GROUP BY a.prompt_id")
def e49(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least and greatest cosine within each prompt, by matrix products of blocks."""
    rows = blocked(placed(spark, sf_dir).where("sample_index IS NOT NULL").select("prompt_id", "sample_index", "e"), "prompt_id", "sample_index")

    def compared(t: pa.Table) -> pa.Table:
        i, j, block = t["i"][0].as_py(), t["j"][0].as_py(), t["block"].to_numpy()
        x = np.array(t["e"].to_pylist())
        a, b = x[block == i], x[block == j]
        s = a @ b.T if len(a) and len(b) else np.empty((0, 0))
        s = s[np.triu_indices(len(s), 1)] if i == j else s.ravel()
        least, most = (float(s.min()), float(s.max())) if len(s) else (None, None)
        return pa.table({"prompt_id": t["prompt_id"][:1], "pairs": [len(s)], "least": pa.array([least], pa.float64()), "most": pa.array([most], pa.float64())})

    by = rows.groupBy("prompt_id", "i", "j").applyInArrow(compared, "prompt_id STRING, pairs BIGINT, least DOUBLE, most DOUBLE")
    return by.groupBy("prompt_id").agg(F.sum("pairs").alias("pairs"), F.round(F.min("least"), 5).alias("least"), F.round(F.max("most"), 5).alias("most")).where("pairs > 0")


@query("d12_between", f"WITH {PLACED}, c AS (SELECT *, sample_index % 2 AS side FROM placed) SELECT a.prompt_id, round(avg(list_dot_product(a.e, b.e)), 5) AS mean_cosine FROM c a JOIN c b USING (prompt_id) WHERE a.side = 0 AND b.side = 1 GROUP BY a.prompt_id")
def d12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean cosine between two sets of a prompt (even and odd samples) is the product of their mean vectors."""
    each = placed(spark, sf_dir).select("prompt_id", F.pmod("sample_index", F.lit(2)).alias("side"), F.posexplode("e").alias("k", "x"))
    means = each.groupBy("prompt_id", "k").agg(F.avg(F.when(F.col("side") == 0, F.col("x"))).alias("a"), F.avg(F.when(F.col("side") == 1, F.col("x"))).alias("b"))
    return means.groupBy("prompt_id").agg(F.sum(F.col("a") * F.col("b")).alias("s")).where("s IS NOT NULL").select("prompt_id", F.round("s", 5).alias("mean_cosine"))


def linked(x: np.ndarray, least: float) -> list[int]:
    """Complete linkage: the two clusters whose least similar members are most similar merge while that cosine is at least least. Labels go by the smallest member; of equal pairs the first in order merges."""
    n = len(x)
    s = np.round(x @ x.T, 9)
    np.fill_diagonal(s, -9)
    own = [[i] for i in range(n)]
    live = np.ones(n, bool)
    while live.sum() > 1:
        k = int(s.argmax())
        i, j = sorted((k // n, k % n))
        if s[i, j] < least:
            break
        own[i] += own[j]
        live[j] = False
        s[i] = np.minimum(s[i], s[j])
        s[:, i] = s[i]
        s[i, i] = -9
        s[j] = s[:, j] = -9
    out = [0] * n
    for label, members in enumerate(sorted((m for m, ok in zip(own, live) if ok), key=min)):
        for m in members:
            out[m] = label
    return out


def parts_above(rows: DataFrame, least: float) -> DataFrame:
    """rows with part: the connected component of the graph of cosines of at least least in each prompt. Complete linkage never joins two parts, so each is one task's work."""
    blocks = blocked(rows, "prompt_id", "sample_index")

    def near(t: pa.Table) -> pa.Table:
        i, j, block, ids = t["i"][0].as_py(), t["j"][0].as_py(), t["block"].to_numpy(), t["sample_index"].to_numpy()
        x = np.array(t["e"].to_pylist())
        a, b = np.nonzero(block == i)[0], np.nonzero(block == j)[0]
        p, q = np.nonzero(np.round(x[a] @ x[b].T, 9) >= least) if len(a) and len(b) else (np.empty(0, int),) * 2
        u, v = ids[a[p]], ids[b[q]]
        # Within two blocks a forest says as much as all pairs.
        root: dict[int, int] = {}

        def find(z: int) -> int:
            while root.setdefault(z, z) != z:
                root[z] = z = root[root[z]]
            return z

        for m, o in zip(u.tolist(), v.tolist()):
            root[max(find(m), find(o))] = min(find(m), find(o))
        nodes = sorted(root)
        return pa.table({"prompt_id": pa.array([t["prompt_id"][0].as_py()] * len(nodes), pa.string()), "a": pa.array(nodes, pa.int32()), "b": pa.array([find(z) for z in nodes], pa.int32())})

    edges = settle(blocks.groupBy("prompt_id", "i", "j").applyInArrow(near, "prompt_id STRING, a INT, b INT").distinct())
    both = settle(edges.union(edges.select("prompt_id", F.col("b"), F.col("a"))).distinct())
    part = settle(rows.select("prompt_id", "sample_index", F.col("sample_index").alias("part")))
    while True:
        lower = both.join(part.select("prompt_id", F.col("sample_index").alias("b"), "part"), ["prompt_id", "b"]).groupBy("prompt_id", F.col("a").alias("sample_index")).agg(F.min("part").alias("low"))
        new = settle(part.join(lower, ["prompt_id", "sample_index"], "left").select("prompt_id", "sample_index", F.least("part", F.coalesce("low", "part")).alias("new"), "part"))
        jump = new.select("prompt_id", F.col("sample_index").alias("new"), F.col("new").alias("further"))
        moved = new.where("new < part").isEmpty()
        part = settle(new.join(jump, ["prompt_id", "new"]).select("prompt_id", "sample_index", F.least("new", "further").alias("part")))
        if moved:
            break
    return rows.join(part, ["prompt_id", "sample_index"])


def complete_linkage(rows: DataFrame, least: float) -> DataFrame:
    """prompt_id, sample_index, cluster (the smallest sample_index of its cluster)."""

    def merged(t: pa.Table) -> pa.Table:
        t = t.sort_by("sample_index")
        ids = t["sample_index"].to_pylist()
        labels = linked(np.array(t["e"].to_pylist()), least)
        first: dict[int, int] = {}
        for i, label in zip(ids, labels):
            first.setdefault(label, i)
        return pa.table({"prompt_id": t["prompt_id"], "sample_index": pa.array(ids, pa.int32()), "cluster": pa.array([first[x] for x in labels], pa.int32())})

    return parts_above(rows, least).groupBy("prompt_id", "part").applyInArrow(merged, "prompt_id STRING, sample_index INT, cluster INT")


@query("i05_clusters")
def i05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of each prompt's vectors at cosine 0.9. Without SQL: it is tested against its two invariants and brute force."""
    return complete_linkage(settle(placed(spark, sf_dir).select("prompt_id", "sample_index", "e")), 0.9)


@query("i05_violations", "SELECT '' AS prompt_id, 0 AS pairs WHERE false")
def i05v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs within a cluster under the threshold: none."""
    rows = settle(placed(spark, sf_dir).select("prompt_id", "sample_index", "e"))
    own = complete_linkage(rows, 0.9).join(rows, ["prompt_id", "sample_index"])
    a, b = (own.select("prompt_id", "cluster", F.col("sample_index").alias(f"s_{k}"), F.col("e").alias(f"e_{k}")) for k in "ab")
    bad = a.join(b, ["prompt_id", "cluster"]).where((F.col("s_a") < F.col("s_b")) & (dot(F.col("e_a"), F.col("e_b")) < 0.9 - 1e-6))
    return bad.groupBy("prompt_id").agg(F.count("*").cast("int").alias("pairs"))


@query(
    "e21_modes",
    f"""WITH {LATEST}, c AS (SELECT prompt_id, coalesce(cluster_id, '') AS k, count(*) FILTER (sample_index % 2 = 0) AS a, count(*) FILTER (sample_index % 2 = 1) AS b FROM scored GROUP BY ALL),
    s AS (SELECT *, sum(a) OVER (PARTITION BY prompt_id) AS ta, sum(b) OVER (PARTITION BY prompt_id) AS tb FROM c), p AS (SELECT *, a * 1.0 / ta AS p, b * 1.0 / tb AS q FROM s WHERE ta > 0 AND tb > 0)
    SELECT prompt_id, round(count(*) FILTER (a > 0 AND b > 0) * 1.0 / count(*) FILTER (a > 0), 6) AS recall, round(count(*) FILTER (a > 0 AND b > 0) * 1.0 / count(*) FILTER (b > 0), 6) AS precision,
    round(sum((CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2), 6) AS jsd FROM p GROUP BY prompt_id""",
)
def e21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modes of one set (even samples) that the other has, the other way round, and the divergence of their counts."""
    c = scored(spark, sf_dir).groupBy("prompt_id", F.coalesce("cluster_id", F.lit("")).alias("k")).agg(F.count_if(F.pmod("sample_index", F.lit(2)) == 0).alias("a"), F.count_if(F.pmod("sample_index", F.lit(2)) == 1).alias("b"))
    t = c.groupBy("prompt_id").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb")).where("ta > 0 AND tb > 0")
    p = c.join(t, "prompt_id").withColumns({"p": F.col("a") / F.col("ta"), "q": F.col("b") / F.col("tb")})
    both = F.count_if((F.col("a") > 0) & (F.col("b") > 0))
    return p.groupBy("prompt_id").agg(R(both / F.count_if(F.col("a") > 0)).alias("recall"), R(both / F.count_if(F.col("b") > 0)).alias("precision"), R(F.sum(divergence(F.col("p"), F.col("q")))).alias("jsd"))


@query("e22_coverage", f"WITH {LATEST}, c AS (SELECT prompt_id, coalesce(cluster_id, '') AS k, max(quality_score) AS q FROM scored GROUP BY ALL) SELECT prompt_id, round(sum(q), 6) AS coverage, count(*) AS modes FROM c GROUP BY prompt_id")
def e22(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = scored(spark, sf_dir).groupBy("prompt_id", F.coalesce("cluster_id", F.lit("")).alias("k")).agg(F.max("quality_score").alias("q"))
    return c.groupBy("prompt_id").agg(R(F.sum("q")).alias("coverage"), F.count("*").alias("modes"))


def distinct_most(apart: np.ndarray) -> int:
    """The size of the largest set of which each two are apart: branch and bound over bit sets."""
    n = len(apart)
    masks = [sum(1 << j for j in range(n) if apart[i, j] and i != j) for i in range(n)]
    best = 0

    def grow(size: int, free: int) -> None:
        nonlocal best
        best = max(best, size)
        while free and size + free.bit_count() > best:
            v = (free & -free).bit_length() - 1
            free &= free - 1
            grow(size + 1, free & masks[v])

    grow(0, (1 << n) - 1)
    return best


@query("i09_distinct")
def i09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each prompt's parts of cosine 0.9 the largest sets of mutually distinct samples, added up: samples of different parts are always distinct. Tested against enumeration."""
    rows = parts_above(settle(placed(spark, sf_dir).select("prompt_id", "sample_index", "e")), 0.9)

    def most(t: pa.Table) -> pa.Table:
        x = np.array(t["e"].to_pylist())
        return pa.table({"prompt_id": t["prompt_id"][:1], "distinct": [distinct_most(np.round(x @ x.T, 9) < 0.9)]})

    return rows.groupBy("prompt_id", "part").applyInArrow(most, "prompt_id STRING, distinct BIGINT").groupBy("prompt_id").agg(F.sum("distinct").alias("distinct"))


@query("i07_nearest", f"WITH {PLACED}, g AS ({'SELECT DISTINCT u.vec_id, u.e FROM units u JOIN (SELECT DISTINCT sha256(text) AS h FROM generation_records WHERE text IS NOT NULL) r ON r.h = u.text_sha256'}), t AS (SELECT DISTINCT vec_id, e FROM placed) SELECT g.vec_id, round(max(list_dot_product(g.e, t.e)), 5) AS cosine FROM g, t GROUP BY g.vec_id")
def i07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each vector of a generation record the greatest cosine with any training sample's vector: blocks of queries against blocks of targets, a maximum each."""
    u = units(table(spark, sf_dir, "text_vectors"))
    texts = table(spark, sf_dir, "generation_records").where("text IS NOT NULL").select(F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")).distinct()
    g = u.join(texts, "text_sha256", "left_semi").select("vec_id", "e")
    t = placed(spark, sf_dir).select("vec_id", "e").distinct()
    n = max(1, t.count() // 20_000 + 1)
    q = g.withColumn("asks", F.lit(True)).withColumn("qb", bucket(4, "vec_id")).withColumn("tb", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    b = t.withColumn("asks", F.lit(False)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("tb", bucket(n, "vec_id"))

    def compared(x: pa.Table) -> pa.Table:
        asks = np.array(x["asks"].to_pylist())
        e, ids = np.array(x["e"].to_pylist()), x["vec_id"].to_numpy()
        if not asks.any() or asks.all():
            return pa.table({"vec_id": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64())})
        best = np.concatenate([(e[asks][i : i + 1024] @ e[~asks].T).max(axis=1) for i in range(0, int(asks.sum()), 1024)])
        return pa.table({"vec_id": ids[asks], "cosine": best})

    found = q.unionByName(b).groupBy("qb", "tb").applyInArrow(compared, "vec_id BIGINT, cosine DOUBLE")
    return found.groupBy("vec_id").agg(F.round(F.max("cosine"), 5).alias("cosine"))


@query("i14_pair_distance", f"WITH {RECORDS}, w AS (SELECT prompt_id, config_hash, sample_index, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '')) AS w FROM records WHERE text IS NOT NULL) SELECT a.prompt_id, a.config_hash, round(CASE WHEN len(list_distinct(a.w || b.w)) = 0 THEN 0 ELSE 1 - len(list_intersect(a.w, b.w)) * 1.0 / len(list_distinct(a.w || b.w)) END, 6) AS distance FROM w a JOIN w b USING (prompt_id, config_hash) WHERE a.sample_index = 0 AND b.sample_index = 1")
def i14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One minus the Jaccard similarity of the words of the first two samples."""
    w = records(spark, sf_dir).where("text IS NOT NULL AND sample_index < 2").select("prompt_id", "config_hash", "sample_index", words_of(F.col("text")).alias("w"))
    a, b = (w.where(F.col("sample_index") == k).select("prompt_id", "config_hash", F.col("w").alias(f"w{k}")) for k in (0, 1))
    return a.join(b, ["prompt_id", "config_hash"]).select("prompt_id", "config_hash", R(jaccard_distance(F.col("w0"), F.col("w1"))).alias("distance"))


def passages(documents: DataFrame, n: int = 12, least: int = 3) -> DataFrame:
    """Word n-grams that least documents or more have, one for each set of documents: gram, documents. Grams are keyed by hash; the set of a gram's documents is known by its count and two sums of hashes, so no list of ids is ever gathered."""
    w = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"), lambda x: x != "")
    words = documents.where("text IS NOT NULL").select("doc_id", w.alias("w")).where(F.size("w") >= n)
    grams = words.select("doc_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " ")))).alias("gram"))
    one, two = F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")), F.sum(F.xxhash64(F.lit(1), "doc_id").cast("decimal(38,0)"))
    by = grams.groupBy(F.sha2("gram", 256).alias("h")).agg(F.min("gram").alias("gram"), F.count("*").alias("documents"), one.alias("one"), two.alias("two")).where(F.col("documents") >= least)
    return by.groupBy("documents", "one", "two").agg(F.min("gram").alias("gram")).select("gram", "documents")


@query("i13_passages", """WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
    g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 11], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM w WHERE len(w) >= 12)),
    s AS (SELECT gram, list(doc_id ORDER BY doc_id) AS ids FROM g GROUP BY gram HAVING count(*) >= 3) SELECT min(gram) AS gram, len(ids) AS documents FROM s GROUP BY ids""")
def i13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(table(spark, sf_dir, "documents"))


@query("i06_anchored")
def i06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even samples' modes at 0.9 are anchors; each odd sample goes to the mode whose least similar member is most similar (of equal ones the lower), if that is 0.9 or more, else to none. Tested against brute force."""
    rows = settle(placed(spark, sf_dir).select("prompt_id", "sample_index", "e"))
    modes = complete_linkage(rows.where("sample_index % 2 = 0"), 0.9).join(rows, ["prompt_id", "sample_index"])
    a = rows.where("sample_index % 2 = 1").select("prompt_id", "sample_index", F.col("e").alias("x"))
    near = a.join(modes.select("prompt_id", "cluster", "e"), "prompt_id").groupBy("prompt_id", "sample_index", "cluster").agg(F.min(F.round(dot(F.col("x"), F.col("e")), 9)).alias("c"))
    best = near.where("c >= 0.9").groupBy("prompt_id", "sample_index").agg(F.max(F.struct("c", -F.col("cluster")))["c"].alias("cosine"), (-F.max(F.struct("c", (-F.col("cluster")).alias("k")))["k"]).alias("mode"))
    return a.select("prompt_id", "sample_index").join(best, ["prompt_id", "sample_index"], "left").select("prompt_id", "sample_index", "mode", F.round("cosine", 5).alias("cosine"))
