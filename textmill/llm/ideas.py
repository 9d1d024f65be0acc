"""Samples of a prompt divided by the idea they state (problem 5): MinHash banding, exact Jaccard, connected components, loose ones split around medoids."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmill.lineage import only, settle, table
from textmill.llm.texts import has_content, language, sentences

#: Stems in at least this share of a language's prompts are phrasing, not idea; their number is bounded by the stems of a prompt divided by it.
PHRASING = 0.2
#: A word is a name if it occurs in at most this share of its language's prompts and of all (or in two); a name weighs as much as so many stems.
RARE, NAME_WEIGHT = 0.01, 3
#: Stems in over this share of a prompt's samples are its subject and divide nothing.
SUBJECT = 0.6
#: Edits within which two names may be one, misspelt.
MISSPELT = 2
#: Bands and rows of the MinHash signature, the Jaccard similarity of a link, and the share of links under which a component is loose.
BANDS, ROWS, LINKED, LOOSE = 32, 2, 0.3, 0.7

TOKEN = re.compile(r"[^\W_]+(?:-[^\W_]+)*")
CODE = re.compile(r"(?=(?:.*[a-z]){2})(?=(?:.*\d){2})[a-z][a-z0-9]+$")


def tokens(sentence: str) -> list[str]:
    """Words in small letters without hyphens; numbers and doses left out."""
    out = (t.replace("-", "").lower() for t in TOKEN.findall(sentence))
    return [t for t in out if CODE.match(t) or (len(t) > 3 and t.isalpha())]


def stem(token: str) -> str:
    return token[:5] if token.isalpha() else token


def chosen(by: list[list[str]], phrasing: frozenset[str]) -> list[tuple[str, int]]:
    """(token, sentences it stands in): what may belong to the idea. Tokens of the sentence with most stems beside phrasing, of stems in several sentences, and of sentences with such a stem.

    So names that are only set aside ("the account that rests on X") go: their sentence has nothing else of the idea."""
    count: dict[str, int] = {}
    stems = [frozenset(map(stem, ts)) for ts in by]
    for sts in stems:
        for st in sts - phrasing:
            count[st] = count.get(st, 0) + 1
    strong = {st for st, n in count.items() if n > 1}
    core = max(stems, key=lambda sts: len(sts & count.keys()), default=frozenset())
    return sorted({(t, count[stem(t)]) for ts, sts in zip(by, stems, strict=True) for t in ts if stem(t) in strong or (stem(t) in count and (sts is core or sts & strong))})


def samples_of(generations: DataFrame) -> DataFrame:
    """prompt_id, sample_index, text: each sample once; of different texts the greatest in order."""
    rows = only(generations, "prompt_id", "sample_index", "text").where("prompt_id IS NOT NULL AND sample_index IS NOT NULL")
    return rows.groupBy("prompt_id", "sample_index").agg(F.max("text").alias("text"))


def features(samples: DataFrame) -> DataFrame:
    """prompt_id, sample_index, f (array of hashes of weighted features, sorted), g (those of names alone), codes and names (those of each kind that most sentences have): samples without features have no row."""

    def read_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["prompt_id", "sample_index", "lang", "by"]
        for b in batches:
            rows = [(p, i, language(t) or "", [sorted(set(tokens(s))) for s in sentences(t)]) for p, i, t in zip(*(b.column(c).to_pylist() for c in names[:2] + ["text"]), strict=True) if has_content(t)]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.list_(pa.list_(pa.string()))), strict=True)], names)

    read = settle(samples.select("prompt_id", "sample_index", "text").mapInArrow(read_in, "prompt_id STRING, sample_index INT, lang STRING, by ARRAY<ARRAY<STRING>>"))
    prompts = read.groupBy("lang").agg(F.count_distinct("prompt_id").alias("prompts"))
    stems = F.array_distinct(F.transform(F.flatten("by"), lambda t: F.when(t.rlike("[0-9]"), t).otherwise(F.substring(t, 1, 5))))
    by = read.select("prompt_id", "lang", F.explode(stems).alias("stem")).distinct().groupBy("lang", "stem").count()
    common = by.join(F.broadcast(prompts), "lang").where(F.col("count") >= F.greatest(PHRASING * F.col("prompts"), F.lit(2))).select("lang", "stem").collect()
    phrasing: dict[str, set[str]] = {}
    for r in common:
        phrasing.setdefault(r["lang"], set()).add(r["stem"])
    phrasing = {k: frozenset(v) for k, v in phrasing.items()}

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["prompt_id", "sample_index", "lang", "token", "stem", "n"]
        for b in batches:
            rows = [(p, i, lang, t, stem(t), n) for p, i, lang, by in zip(*(b.column(c).to_pylist() for c in ("prompt_id", "sample_index", "lang", "by")), strict=True) for t, n in chosen(by, phrasing.get(lang, frozenset()))]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32()), strict=True)], names)

    words = settle(read.mapInArrow(picked, "prompt_id STRING, sample_index INT, lang STRING, token STRING, stem STRING, n INT"))
    # A word must be rare in its language and in all, since the language of a short text may be mistaken.
    spread = words.select("lang", "token", "prompt_id").distinct().groupBy("lang", "token").agg(F.count("*").alias("n"))
    anywhere = spread.groupBy("token").agg(F.sum("n").alias("all_n")).crossJoin(F.broadcast(prompts.agg(F.sum("prompts").alias("all_prompts"))))  # one row
    spread = spread.join(anywhere, "token").join(F.broadcast(prompts), "lang")  # a row a language
    few = lambda n, of: F.col(n) <= F.greatest(RARE * F.col(of), F.lit(2))
    rare = spread.where(few("n", "prompts") & few("all_n", "all_prompts") & (F.length("token") > 5)).select("lang", "token", F.lit(True).alias("rare"))
    sizes = samples.groupBy("prompt_id").agg(F.count("*").alias("samples"))
    subject = words.groupBy("prompt_id", "stem").agg(F.count_distinct("sample_index").alias("n")).join(sizes, "prompt_id").where(F.col("n") > SUBJECT * F.col("samples")).select("prompt_id", "stem", F.lit(True).alias("subject"))
    full = words.join(rare, ["lang", "token"], "left").join(subject, ["prompt_id", "stem"], "left")
    name = F.coalesce("rare", F.lit(False))
    kept = full.where(name | F.col("subject").isNull()).withColumn("name", name)
    # A stem counts twice if it stands in several sentences, so that the process and the outcome weigh more than the plan of a test.
    hashed = lambda of, k: F.transform(F.sequence(F.lit(1), k), lambda x: F.xxhash64(of, x))
    feature = F.when(F.col("name"), hashed("token", F.lit(NAME_WEIGHT))).otherwise(hashed("stem", F.least("n", F.lit(2))))
    by = kept.groupBy("prompt_id", "sample_index").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(feature)))).alias("f"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("name"), feature))))).alias("g"),
        *(F.collect_set(F.when(F.col("name") & (F.col("token").rlike("[0-9]") == coded), F.struct("n", "token"))).alias(c) for c, coded in (("codes", True), ("names", False))),
    )
    main = lambda c: F.array_sort(F.transform(F.filter(c, lambda x: x["n"] == F.array_max(c)["n"]), lambda x: x["token"])).alias(c)
    return by.select("prompt_id", "sample_index", "f", "g", main("codes"), main("names"))


def alike(a: Column, b: Column) -> Column:
    """Whether both name one thing, perhaps misspelt."""
    return F.exists(a, lambda x: F.exists(b, lambda y: (x == y) | ((F.length(x) > 8) & ~x.rlike("[0-9]") & (F.levenshtein(x, y) <= MISSPELT))))


def compatible(codes_a: Column, codes_b: Column, names_a: Column, names_b: Column) -> Column:
    """Whether two samples name one thing exactly, or both name nothing, and neither kind is at odds: named by both, and differently. A misspelt name isn't at odds, but it takes more than likeness to be one."""
    same_code, same_name = F.arrays_overlap(codes_a, codes_b), F.arrays_overlap(names_a, names_b)
    odd = lambda a, b, same: (F.size(a) > 0) & (F.size(b) > 0) & ~same
    silent = F.size(codes_a) + F.size(names_a) + F.size(codes_b) + F.size(names_b) == 0
    return ~odd(codes_a, codes_b, same_code) & ~odd(names_a, names_b, alike(names_a, names_b)) & (same_code | same_name | silent)


def links(sets: DataFrame, at_least: float = LINKED) -> DataFrame:
    """prompt_id, a, b (a < b), similarity: the sets of a prompt whose exact Jaccard similarity is at_least, among those that share a band of their MinHash signatures, and that don't name different things. sets: prompt_id, rep, f, codes, names, each once a prompt.

    With a column g, the features of names, samples with names meet by signatures of these, since a link needs a name in common: so a bucket holds what names one thing, not what shares a subject.
    Samples without names meet each other by signatures of all features; with others they have nothing to be told apart by, so they would bridge ideas."""

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(11)
        times, plus = (rng.integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64) | np.uint64(1) for _ in range(2))
        for b in batches:
            f = b.column("f")
            if not b.num_rows:
                continue
            flat, starts = f.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.r_[0, np.cumsum(pc.list_value_length(f).to_numpy(zero_copy_only=False))[:-1]]
            keys = []
            for k in range(BANDS):
                key = np.full(b.num_rows, k, np.uint64)
                for h in range(k * ROWS, (k + 1) * ROWS):
                    x = flat * times[h] + plus[h]
                    low = np.minimum.reduceat(x ^ (x >> np.uint64(31)), starts)
                    key = (key ^ low) * np.uint64(0x9E3779B97F4A7C15)
                keys.append(key.view(np.int64))
            table = np.stack(keys, axis=1).ravel()
            yield pa.RecordBatch.from_arrays([b.column("prompt_id"), b.column("rep"), pa.ListArray.from_arrays(pa.array(np.arange(0, len(table) + 1, BANDS), pa.int32()), pa.array(table))], ["prompt_id", "rep", "bands"])

    def signed(rows: DataFrame, f: str, name: str) -> DataFrame:
        bands = rows.select("prompt_id", "rep", F.col(f).alias("f")).mapInArrow(banded, "prompt_id STRING, rep INT, bands ARRAY<BIGINT>")
        return bands.select("prompt_id", F.col("rep").alias(name), F.explode("bands").alias("key"))

    # Buckets hold ids alone; a pair that shares several is compared once.
    if "g" in sets.columns:
        own = signed(sets.where(F.size("g") > 0), "g", "a").union(signed(sets.where(F.size("g") == 0), "f", "a"))
    else:
        own = signed(sets, "f", "a")
    met = own.join(own.withColumnRenamed("a", "b"), ["prompt_id", "key"]).where("a < b").select("prompt_id", "a", "b").distinct()
    for side in "ab":
        met = met.join(sets.select("prompt_id", F.col("rep").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("f", "codes", "names"))), ["prompt_id", side])
    scored = met.withColumn("both", F.size(F.array_intersect("f_a", "f_b"))).withColumn("similarity", F.col("both") / (F.size("f_a") + F.size("f_b") - F.col("both")))
    one = compatible(*(F.col(f"{c}_{side}") for c in ("codes", "names") for side in "ab"))
    return scored.where((F.col("similarity") >= at_least) & one).select("prompt_id", "a", "b", "similarity")


def components(edges: DataFrame) -> DataFrame:
    """prompt_id, node, root: the least node of each node's component, by large and small stars in turn, a number of rounds that grows with the logarithm of the component. edges: prompt_id, a, b."""
    key, now, before = ["prompt_id", "u"], settle(edges.select("prompt_id", F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()), None
    while True:
        both = now.union(now.select("prompt_id", F.col("v").alias("u"), F.col("u").alias("v")))
        low = F.least(F.min("v").over(Window.partitionBy(*key)), F.col("u"))
        large = both.withColumn("m", low).where("v > u").select("prompt_id", F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.withColumn("m", F.min("v").over(Window.partitionBy(*key)))
        now = settle(small.where("v <> m").select("prompt_id", F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("prompt_id", "u", F.col("m").alias("v"))).distinct())
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("prompt_id", "u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    own = now.groupBy("prompt_id", F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return own.union(now.select("prompt_id", F.col("v").alias("node"), F.col("v").alias("root")).distinct()).groupBy("prompt_id", "node").agg(F.min("root").alias("root"))


def split(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """prompt_id, node, root: as roots, but components with fewer than LOOSE of their possible links are divided around medoids.

    A node whose (links, similarity) is highest among the nodes it is linked to takes these with it; what is left goes on, until none is."""
    both = edges.union(edges.select("prompt_id", F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    inside = both.join(roots.withColumnRenamed("node", "a"), ["prompt_id", "a"])
    sizes = roots.groupBy("prompt_id", "root").agg(F.count("*").alias("n"))
    dense = inside.groupBy("prompt_id", "root").agg(F.count("*").alias("links")).join(sizes, ["prompt_id", "root"])
    loose = dense.where(F.col("links") < LOOSE * F.col("n") * (F.col("n") - 1)).select("prompt_id", "root")
    left = settle(inside.join(loose, ["prompt_id", "root"], "left_semi").select("prompt_id", "a", "b", "similarity"))
    nodes = settle(roots.join(loose, ["prompt_id", "root"], "left_semi").select("prompt_id", "node"))
    done = None
    while not nodes.isEmpty():
        # (links, summed similarity, -node): no two nodes have the same.
        rank = left.groupBy("prompt_id", F.col("a").alias("node")).agg(F.struct(F.count("*").alias("n"), F.round(F.sum("similarity"), 9).alias("s"), (-F.first("a")).alias("id")).alias("rank"))
        near = left.join(rank.select("prompt_id", F.col("node").alias("b"), F.col("rank").alias("other")), ["prompt_id", "b"])
        best = near.groupBy("prompt_id", F.col("a").alias("node")).agg(F.max("other").alias("other"))
        ranked = nodes.join(rank, ["prompt_id", "node"], "left").join(best, ["prompt_id", "node"], "left")
        medoids = ranked.where("rank IS NULL OR rank > other").select("prompt_id", F.col("node").alias("root"), "rank")
        taken = left.join(medoids.select("prompt_id", F.col("root").alias("a"), "rank"), ["prompt_id", "a"]).groupBy("prompt_id", F.col("b").alias("node")).agg(F.max(F.struct("rank", F.col("a").alias("root")))["root"].alias("root"))
        own = settle(medoids.select("prompt_id", F.col("root").alias("node"), "root").union(taken.select("prompt_id", "node", "root")).groupBy("prompt_id", "node").agg(F.min_by("root", F.when(F.col("node") == F.col("root"), 0).otherwise(1)).alias("root")))
        done = own if done is None else done.union(own)
        nodes = settle(nodes.join(own, ["prompt_id", "node"], "left_anti"))
        for side in "ab":
            left = left.join(own.select("prompt_id", F.col("node").alias(side)), ["prompt_id", side], "left_anti")
        left = settle(left)
    return roots if done is None else roots.join(loose, ["prompt_id", "root"], "left_anti").select("prompt_id", "node", "root").union(done)


def clustered(generations: DataFrame) -> DataFrame:
    """prompt_id, sample_index, cluster (the least sample_index of the idea's first set of features), degree: each sample once.

    Samples of null, blank or placeholder text, and those without features, are an idea of their own each. Rows whose prompt_id or sample_index is null take no part. Equal sets of features are
    compared once, so copies cost nothing; a large prompt is spread by bands and sets. An empty table gives none."""
    samples = settle(samples_of(generations))
    f = settle(features(samples).where(F.size("f") > 0))
    sets = settle(f.groupBy("prompt_id", "f", "codes", "names").agg(F.min("sample_index").alias("rep"), F.min("g").alias("g")))
    edges = settle(links(sets))
    roots = split(edges, settle(components(edges)))
    degree = edges.select("prompt_id", F.col("a").alias("rep")).union(edges.select("prompt_id", "b")).groupBy("prompt_id", "rep").agg(F.count("*").alias("degree"))
    of = sets.join(roots.withColumnRenamed("node", "rep"), ["prompt_id", "rep"], "left").join(degree, ["prompt_id", "rep"], "left")
    own = f.join(of, ["prompt_id", "f", "codes", "names"]).select("prompt_id", "sample_index", F.coalesce("root", "rep").alias("cluster"), F.coalesce("degree", F.lit(0)).alias("degree"))
    rest = samples.select("prompt_id", "sample_index").join(own, ["prompt_id", "sample_index"], "left_anti")
    return own.union(rest.select("prompt_id", "sample_index", F.col("sample_index").alias("cluster"), F.lit(0).cast("bigint").alias("degree")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = settle(clustered(table(spark, sf_dir, "teacher_generations")))
    a, b = (own.select("prompt_id", "cluster", F.col("sample_index").alias(f"sample_{s}")) for s in "ab")
    return a.join(b, ["prompt_id", "cluster"]).where("sample_a < sample_b").select("prompt_id", "sample_a", "sample_b")


def p5_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prompt_id, cluster, size, typical: up to 3 samples of each idea with the most links, of equal ones the lowest index."""
    own = clustered(table(spark, sf_dir, "teacher_generations"))
    order = Window.partitionBy("prompt_id", "cluster").orderBy(F.desc("degree"), "sample_index")
    typical = F.array_sort(F.collect_list(F.when(F.col("place") <= 3, F.struct("place", "sample_index"))))
    return own.withColumn("place", F.row_number().over(order)).groupBy("prompt_id", "cluster").agg(F.count("*").alias("size"), F.transform(typical, lambda x: x["sample_index"]).alias("typical"))
