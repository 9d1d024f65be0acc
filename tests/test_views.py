import pytest

from textmill.operators import views

SHAPE = "prompt_id STRING, sample_index INT, text STRING, quality_score DOUBLE, cluster_id STRING"
ROWS = [("paper-1", i, f"t{i}", q, c) for i, (c, q) in enumerate(zip("aaabbcde", (0.2, 0.9, 0.5, 0.8, 0.7, 0.6, 0.4, 0.3)))]


def taken(df, view):
    return [r["sample_index"] for r in df.where(f"view = '{view}'").orderBy("place").collect()]


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_views_do_not_depend_on_partitions(spark, parts):
    v = views.views(spark.createDataFrame(ROWS, SHAPE).repartition(parts)).cache()
    assert taken(v, "best1") == [1] and taken(v, "mode1") == [1]
    assert taken(v, "diverse4") == [1, 3, 5, 6]
    assert taken(v, "all") == list(range(8))
    assert set(taken(v, "random1")) < set(taken(v, "random4")) and len(taken(v, "random4")) == 4


def test_seeds_differ(spark):
    rows = spark.createDataFrame([(f"p{k}", i, "t", 0.5, None) for k in range(20) for i in range(8)], SHAPE)
    pick = lambda seed: {r["prompt_id"]: r["sample_index"] for r in views.random_k(rows, 1, "random1", seed).collect()}
    assert pick(17) != pick(29)


def test_latest_row_counts_whatever_it_holds(spark):
    shape = "prompt_id STRING, sample_index INT, text STRING, quality_score DOUBLE, cluster_id STRING, scored_at TIMESTAMP_NTZ"
    from datetime import datetime

    rows = spark.createDataFrame([("p", 0, "t", 0.9, "a", datetime(2024, 1, 1)), ("p", 0, "t", None, None, datetime(2024, 2, 1))], shape)
    assert [r["quality_score"] for r in views.latest(rows).collect()] == [None]


def test_positions_are_those_of_the_order(spark):
    rows = spark.createDataFrame([(i * 7 % 100,) for i in range(100)], "v INT").repartition(9)
    assert all(r["v"] == r["pos"] for r in views.positions(rows, "v").collect())
