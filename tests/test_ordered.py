"""Block scans give what whole-key windows give, whatever the block size."""

import random

import pytest
from pyspark.sql import functions as F

from talktable.operators import ordered
from talktable.operators.intervals import merge_blocks
from talktable.operators.ordered import (
    after, before, following, key_max, key_sum, max_before, number_rows, previous, row_block,
    running_sum, scan, sum_before,
)

SPECS = {
    "b": before, "a": after, "p1": previous, "f1": following, "s": running_sum,
    "sb": sum_before, "m": max_before, "ks": key_sum, "km": key_max,
}


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = [
        (k, i, rng.choice([None, 1, 2, 3, 4]))
        for k, n in enumerate([1, 2, 3, 40, 150])
        for i in range(n)
    ]
    return spark.createDataFrame(data, "k int, i int, v int").cache()


def specs():
    out = {n: f(F.col("v")) for n, f in SPECS.items()}
    return out | {"p2": previous(F.col("v"), 2), "f2": following(F.col("v"), 2)}


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_blocks_equal_windows(rows, size):
    whole = scan(rows, ["k"], ["i"], specs(), None)
    blocks = scan(rows, ["k"], ["i"], specs(), row_block("i", size))
    assert sorted(map(str, whole.collect())) == sorted(map(str, blocks.collect()))


def test_number_rows(rows):
    out = number_rows(rows, ["k"], ["i"], row_block("i", 5)).collect()
    assert all(r.idx == r.i for r in out)


@pytest.mark.parametrize("most", [1, 4, 25, 100, 1000])
def test_cut_keys_equal_windows(rows, monkeypatch, most):
    monkeypatch.setattr(ordered, "KEY_ROWS", most)
    whole = scan(rows, ["k"], ["i"], specs(), None)
    cut = ordered.cut_keys(rows, ["k"], "i")
    assert (cut.hot is None) == (most >= 150)
    assert sorted(map(str, whole.collect())) == sorted(map(str, scan(rows, ["k"], ["i"], specs(), cut).collect()))


def test_blocks_follow_the_rows_and_not_the_scale(spark, monkeypatch):
    """A sparse index over many calls, and one call with all its rows in 300 s: no block exceeds the limit."""
    monkeypatch.setattr(ordered, "KEY_ROWS", 4096)
    sparse = spark.range(30_000).selectExpr("cast(0 as long) AS call_id", "id * 1000003 AS idx", "id * 1000.0D AS start_s")
    dense = spark.range(40_000).selectExpr("cast(1 as long) AS call_id", "id AS idx", "id * 0.0075D AS start_s")
    small = spark.range(900).selectExpr("2 + id % 9 AS call_id", "id AS idx", "cast(id as double) AS start_s")
    both = sparse.unionByName(dense).unionByName(small)
    for position in ("idx", "start_s"):
        cut = ordered.cut_keys(both, ["call_id"], position)
        assert {r.call_id for r in cut.hot.collect()} == {0, 1}
        sizes = both.join(cut.hot, "call_id").groupBy("call_id", F.size(F.filter("__bounds", lambda b: b < F.col(position)))).count()
        assert sizes.agg(F.max("count")).first()[0] <= 4096
        numbered = number_rows(both, ["call_id"], ["idx"], cut, "n")
        assert numbered.groupBy("call_id").agg((F.max("n") + 1 == F.count("*")).alias("ok")).where("not ok").count() == 0
    merged = merge_blocks(both.withColumn("end_s", F.col("start_s") + 0.005), 0.003)
    assert {r.call_id: r.n for r in merged.groupBy("call_id").agg(F.count("*").alias("n")).collect() if r.call_id < 2} == {0: 30_000, 1: 1}


def test_ordinary_keys_are_read_once(spark, tmp_path):
    spark.range(1000).selectExpr("id % 7 AS call_id", "id * 1.0D AS start_s", "id + 0.5D AS end_s").write.parquet(str(tmp_path / "t"))
    merged = merge_blocks(spark.read.parquet(str(tmp_path / "t")), 0.1)
    assert merged._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Scan parquet") == 1
