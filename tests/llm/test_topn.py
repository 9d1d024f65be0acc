import random
from datetime import datetime

import pytest

from textmill.llm import topn


@pytest.mark.parametrize("parts", [1, 7])
def test_places_are_those_of_a_plain_sort(spark, parts):
    rng = random.Random(1)
    items = [(rng.choice(["a", "b", "c", None]), rng.choice([0.1, 0.5, 0.5, 0.9, None, float("nan")]), i) for i in range(500)]
    got = topn.top_n(spark.createDataFrame(items, "g STRING, s DOUBLE, i INT").repartition(parts), "g", "s", "i", 3)
    want = []
    for g in ("a", "b", "c", None):
        own = sorted((-s, i) for x, s, i in items if x == g and s is not None and s == s)[:3]
        want += [(g, k, i, -s) for k, (s, i) in enumerate(own, 1)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_heaps_passed_on_early_merge_to_the_same(spark, monkeypatch):
    monkeypatch.setattr(topn, "HELD", 0)
    rows = spark.createDataFrame([(f"g{i % 5}", float(i % 7), i) for i in range(200)], "g STRING, s DOUBLE, i INT")
    got = {(r["g"], r["place"]): r["i"] for r in topn.top_n(rows, "g", "s", "i", 2).collect()}
    for g in range(5):
        best = sorted(((-(i % 7), i) for i in range(g, 200, 5)))[:2]
        assert [got[f"g{g}", k] for k in (1, 2)] == [i for _, i in best]


def test_latest_score_counts_and_bad_ones_get_no_place(spark):
    shape = "prompt_id STRING, sample_index INT, quality_score DOUBLE, scored_at TIMESTAMP_NTZ, QUALITY_SCORE STRING, place INT"
    t = [datetime(2024, 1, d) for d in range(1, 5)]
    rows = [("p", 0, 0.9, t[0], "x", 1), ("p", 0, None, t[1], "x", 1), ("p", 1, 0.4, t[0], "x", 1), ("p", 1, 0.4, t[0], "x", 1), ("p", 2, 1.5, t[0], "x", 1), ("p", 3, float("nan"), t[0], "x", 1), ("p", 4, 0.4, t[2], "x", 1)]
    df = spark.createDataFrame(rows, shape)
    assert sorted(map(tuple, topn.top_samples(df).collect())) == [("p", 1, 1), ("p", 2, 4)]
    assert topn.top_samples(df.where("false")).count() == 0
