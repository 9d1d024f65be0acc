import pytest

from textmill.operators.constraints import Violated
from textmill.sources import jsonl
from textmill.streaming import incremental


def records(spark, n=3):
    rows = [("p", i, f"t{i}", "stop", "m", f"r{i}", "c", 1, 2) for i in range(n)]
    return spark.createDataFrame(rows, jsonl.RECORD)


def test_shards_come_back(spark, tmp_path):
    path = str(tmp_path / "shards")
    jsonl.write_shards(records(spark), path, "c")
    back = jsonl.shards(spark, path, "c")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, records(spark).collect()))
    assert jsonl.prefix(back, 2).count() == 2
    with pytest.raises(Violated):
        jsonl.shards(spark, path, "other")
    with pytest.raises(Exception):
        jsonl.write_shards(records(spark), path, "c")  # never overwritten


def test_gaps_in_shards_are_refused(spark, tmp_path):
    path = str(tmp_path / "gaps")
    jsonl.write_shards(records(spark).where("sample_index <> 1"), path, "c")
    with pytest.raises(Violated):
        jsonl.shards(spark, path, "c")


def test_strict_scan(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "a"}\n\n{"id": "b"}\n')
    assert jsonl.scan(spark, str(tmp_path / "a.jsonl"), "id STRING", "id", 2).count() == 2
    with pytest.raises(Violated):
        jsonl.scan(spark, str(tmp_path / "a.jsonl"), "id STRING", "id", 3)
    assert jsonl.lookup(jsonl.scan(spark, str(tmp_path / "a.jsonl"), "id STRING"), "id", "b").count() == 1
    assert [r["id"] for r in jsonl.first_lines(spark, str(tmp_path / "a.jsonl"), "id STRING", 1).collect()] == ["a"]
    both = jsonl.bind(spark, [f"x:1={tmp_path}/a.jsonl", f"y={tmp_path}/a.jsonl"], "id STRING")
    assert {(r["method"], r["seed"]) for r in both.collect()} == {("x", 1), ("y", None)}


def test_manifest_does_not_depend_on_order(spark, tmp_path):
    a = jsonl.write_metrics(records(spark), str(tmp_path / "m1")).first()
    b = jsonl.write_metrics(records(spark).orderBy("sample_index", ascending=False), str(tmp_path / "m2")).first()
    assert a == b and a["rows"] == 3


def test_stream_takes_what_is_new_once(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    rows = records(spark).selectExpr("*", "timestamp'2024-01-01 00:00:00' AS arrived_at")
    rows.write.json(source)
    incremental.once_each(spark, source, target, state).awaitTermination()
    rows.write.mode("append").json(source)
    incremental.once_each(spark, source, target, state).awaitTermination()
    assert spark.read.parquet(target).count() == 3


def test_pending(spark):
    p = spark.createDataFrame([("a", "1"), ("b", "2")], "prompt_id STRING, text_sha256 STRING")
    done = spark.createDataFrame([("a", "1"), ("b", "x")], "prompt_id STRING, text_sha256 STRING")
    assert [r["prompt_id"] for r in incremental.pending(p, done).collect()] == ["b"]
