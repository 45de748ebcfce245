"""Several starts of k-means, in a task and across tasks."""

import itertools
import math
import random

import pytest

from talktable.operators import cluster

SCHEMA = "g int, i long, embedding array<double>"


def unit(*v):
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v]


def labels(df):
    """Partition of each group, whatever the clusters are called."""
    parts = {}
    for r in df.collect():
        parts.setdefault((r.g, r.cluster), set()).add(r.i)
    return {frozenset((g, i) for i in p) for (g, _), p in parts.items()}


def cost(points, part):
    total = 0.0
    for group in part:
        rows = [points[i] for i in group]
        mean = [sum(c) / len(rows) for c in zip(*rows)]
        total += sum(sum((a - b) ** 2 for a, b in zip(r, mean)) for r in rows)
    return total


def test_an_outlier_does_not_take_a_cluster(spark):
    rng = random.Random(1)
    left = [unit(1, 0.9 + rng.uniform(-0.05, 0.05), 0, 0) for _ in range(40)]
    right = [unit(1, 0, 0.9 + rng.uniform(-0.05, 0.05), 0) for _ in range(40)]
    rows = [(0, i, v) for i, v in enumerate([*left, *right, unit(-1, 0.1, 0.1, 0.2)])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    fixed = labels(cluster.cluster_groups(df, ["g"], 2, "i"))
    assert frozenset({(0, 80)}) in fixed
    for group_rows in (0, 1000):
        best = labels(cluster.cluster_groups(df, ["g"], 2, "i", group_rows, starts=6))
        assert any(frozenset((0, i) for i in range(40)) <= part <= frozenset((0, i) for i in [*range(40), 80]) for part in best)


@pytest.mark.parametrize("k", [2, 3])
def test_both_paths_find_the_same_and_no_worse_than_one_start(spark, k):
    rng = random.Random(k)
    rows = [(g, 100 * g + i, unit(*[rng.gauss(0, 1) + 2 * (i % 3 == j) for j in range(4)])) for g in range(4) for i in range((1, k, 12, 40)[g])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    small = labels(cluster.cluster_groups(df, ["g"], k, "i", starts=5))
    assert small == labels(cluster.cluster_groups(df, ["g"], k, "i", 0, starts=5))
    one = labels(cluster.cluster_groups(df, ["g"], k, "i"))
    points = {(g, i): v for g, i, v in rows}
    assert cost(points, small) <= cost(points, one) + 1e-9


def test_few_points_reach_the_best_partition(spark):
    rng = random.Random(4)
    rows = [(0, i, unit(rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1))) for i in range(9)]
    points = {(0, i): v for _, i, v in rows}
    best = min(
        cost(points, [a, set(points) - set(a)]) for n in range(1, 5) for a in itertools.combinations(points, n)
    )
    found = labels(cluster.cluster_groups(spark.createDataFrame(rows, SCHEMA), ["g"], 2, "i", starts=20))
    assert cost(points, found) == pytest.approx(best)
