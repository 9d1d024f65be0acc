import random

import pytest

from textmill.llm import truth

PAIRS = "blind_id STRING, repeat_of STRING"
LABELS = "blind_id STRING, rater_id STRING, label STRING, confidence INT, submitted_at INT, Label STRING"


def test_chi_squared_against_published_values():
    for p, n, x in ((0.025, 1, 0.000982), (0.025, 10, 3.247), (0.025, 100, 74.222), (0.05, 5, 1.1455), (0.975, 10, 20.483)):
        assert truth.chi_squared(p, n) == pytest.approx(x, rel=1e-3)


def test_consensus_follows_the_reliable(spark):
    rng = random.Random(3)
    right = {f"b{i}": rng.random() < 0.5 for i in range(200)}
    says = {"good1": 0.95, "good2": 0.93, "poor": 0.55, "spam": 0.5, "against": 0.05}
    rows = [(b, r, "equivalent" if (rng.random() < a) == yes else "Not-Equivalent ", rng.choice([1, 2, 3, None, 9]), 1, "x") for b, yes in right.items() for r, a in says.items() if rng.random() < 0.8]
    pairs = spark.createDataFrame([(b, None) for b in right], PAIRS)
    labels = spark.createDataFrame(rows, LABELS)
    got = {r["blind_id"]: r["label"] == "equivalent" for r in truth.consensus(pairs, labels).collect()}
    assert sum(got[b] == yes for b, yes in right.items()) >= 190
    raters = {r["rater_id"]: r for r in truth.discovered(truth.votes(pairs, labels))[1].collect()}
    assert raters["good1"]["weight"] > 3 * raters["spam"]["weight"] and raters["against"]["against"] and not raters["good2"]["against"]


def test_repeats_last_answers_and_missing(spark):
    pairs = spark.createDataFrame([("a", None), ("a", None), ("b", " "), ("r", "a"), ("c", "")], PAIRS)
    rows = [("a", "x", "equivalent", 3, 1, ""), ("a", "x", "not equivalent", 3, 2, ""), ("r", "y", "NOT_EQUIVALENT", 2, 1, ""), ("b", "x", "uncertain", 1, 1, ""), ("b", "y", None, None, 1, ""), ("zz", "x", "equivalent", 3, 1, ""), ("c", None, "equivalent", 3, 1, "")]
    labels = spark.createDataFrame(rows + rows, LABELS)
    got = {r["blind_id"]: r for r in truth.consensus(pairs, labels).collect()}
    assert set(got) == {"a", "b", "c"} and got["a"]["label"] == "not_equivalent" and got["a"]["n_votes"] == 2
    assert got["b"]["n_votes"] == 0 and got["b"]["agreement"] is None
    assert truth.consensus(pairs.where("false"), labels).count() == 0
    assert truth.consensus(pairs, labels.where("false")).count() == 3
