import hashlib
import itertools

import duckdb
import numpy as np
import pytest

from textmill.operators import vectors
from textmill.operators.rows import earliest_public, public_dates
from textmill.plans.catalogue import ORACLES, QUERIES


def unit(rows):
    x = np.array(rows, float)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_complete_linkage_does_not_chain():
    assert vectors.linked(unit([(1, 0), (0.99, 0.1), (0, 1), (-1, 0)]), 0.9) == [0, 0, 1, 2]
    assert vectors.linked(unit([(1, 0), (0.9, 0.435889894), (0.6, 0.8)]), 0.8) == [0, 0, 1]


def plain(x, least):
    own = [[i] for i in range(len(x))]
    while True:
        pairs = [(min(round(float(x[a] @ x[b]), 9) for a in p for b in q), p, q) for p, q in itertools.combinations(own, 2)]
        best = max((c for c, _, _ in pairs), default=-2)
        if best < least:
            return {frozenset(c) for c in own}
        _, p, q = next(z for z in pairs if z[0] == best)
        own = sorted([c for c in own if c not in (p, q)] + [sorted(p + q)])


def test_distributed_linkage_is_that_of_brute_force(spark):
    rng = np.random.default_rng(2)
    x = unit(rng.normal(size=(40, 3)))
    df = spark.createDataFrame([("p", i, v.tolist()) for i, v in enumerate(x)], "prompt_id STRING, sample_index INT, e ARRAY<DOUBLE>")
    got = {}
    for r in vectors.complete_linkage(df, 0.8).collect():
        got.setdefault(r["cluster"], set()).add(r["sample_index"])
    assert {frozenset(v) for v in got.values()} == plain(x, 0.8)


def test_most_distinct_is_that_of_enumeration():
    rng = np.random.default_rng(4)
    for _ in range(20):
        a = rng.random((8, 8)) < 0.5
        a = a | a.T
        best = max(k for k in range(9) for s in itertools.combinations(range(8), k) if all(a[i, j] for i, j in itertools.combinations(s, 2)))
        assert vectors.distinct_most(a) == best


def test_invalid_vectors_are_rejected(spark):
    rows = [(1, "a", [1.0] * 64), (2, "b", [0.0] * 64), (3, "c", None), (4, "d", [1.0]), (5, "e", [float("nan")] * 64), (6, "f", [None] * 64)]
    df = spark.createDataFrame(rows, "vec_id BIGINT, text_sha256 STRING, embedding ARRAY<FLOAT>")
    assert [r["vec_id"] for r in vectors.units(df).collect()] == [1]


def test_passages_of_the_same_documents_come_once(spark):
    shared = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(i, f"x{i} {shared}") for i in range(3)] + [(9, "short"), (10, None)], "doc_id BIGINT, text STRING")
    assert [r["documents"] for r in vectors.passages(df).collect()] == [3]


XML = '<S><PubmedArticle><MedlineCitation><PMID>12345678</PMID><Article><Journal><JournalIssue><PubDate><Year>2024</Year><Month>Feb</Month></PubDate></JournalIssue></Journal><ArticleDate DateType="Electronic"><Year>2024</Year><Month>01</Month><Day>15</Day></ArticleDate></Article></MedlineCitation><PubmedData><History><PubMedPubDate PubStatus="received"><Year>2023</Year></PubMedPubDate></History></PubmedData></PubmedArticle></S>'


def test_public_dates(spark):
    assert ("12345678", "2024-02-01", "ppublish", "month", "JournalIssue") in public_dates(XML)
    r = earliest_public(spark.createDataFrame([(XML,), (XML,), (None,)], "xml STRING")).collect()
    assert [(x["pmid"], str(x["earliest_public_date"]), x["status"], x["precision"]) for x in r] == [("12345678", "2024-01-15", "epublish", "day")]
    with pytest.raises(ValueError):
        public_dates(XML.replace("12345678", "x"))


def odd(spark, folder):
    """Prompts with one sample, without a name, with a sample without an index; many vectors of one text that many samples have."""
    samples = [("p", i, f"t{i}") for i in range(3)] + [("q", 0, "t9")] + [(None, i, f"t{i}") for i in range(2)] + [("r", None, "t1"), ("r", 1, "t2"), ("r", 2, "t3")] + [("s", i, "many") for i in range(30)]
    shape = "prompt_id STRING, sample_index INT, text STRING, quality_score DOUBLE, cluster_id STRING, scored_at TIMESTAMP_NTZ"
    spark.createDataFrame([(p, i, t, 0.5, "c", None) for p, i, t in samples], shape).write.parquet(f"{folder}/teacher_generations.parquet")
    rng, names = np.random.default_rng(6), [f"t{k % 10}" for k in range(20)] + ["many"] * 40
    rows = [(k, hashlib.sha256(t.encode()).hexdigest(), rng.normal(size=64).tolist()) for k, t in enumerate(names)]
    spark.createDataFrame(rows, "vec_id BIGINT, text_sha256 STRING, embedding ARRAY<FLOAT>").write.parquet(f"{folder}/text_vectors.parquet")


def test_extremes_of_prompts_with_one_sample(spark, tmp_path):
    odd(spark, tmp_path)
    with duckdb.connect() as c:
        for t in ("teacher_generations", "text_vectors"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        want = sorted(c.sql(ORACLES["e49_extremes"]).fetchall())
    got = sorted(map(tuple, QUERIES["e49_extremes"](spark, str(tmp_path)).collect()))
    assert [r[0] for r in want] == ["p", "r", "s"] and got == want


def test_many_vectors_of_one_text_make_no_product(spark, tmp_path):
    odd(spark, tmp_path)
    rows = vectors.placed(spark, str(tmp_path))
    assert rows.where("prompt_id = 's'").select("vec_id").distinct().collect() == [(20,)] and rows.count() == 39
    text = rows._jdf.queryExecution().optimizedPlan().toString()
    join = next(i for i, x in enumerate(text.splitlines()) if "Join Inner" in x)
    assert any("min_by" in x for x in text.splitlines()[join:]) and not any("min_by" in x for x in text.splitlines()[:join])
