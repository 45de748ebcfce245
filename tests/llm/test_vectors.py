"""Operators on vectors and the pipeline, against plain versions and on odd rows."""

import math
import random

import numpy as np
import pytest

from talktable.llm import partitions, pivots, vectors

VECTORS = "vec_id long, embedding array<float>"
ODD = [(900, None), (901, []), (902, [0.0] * 8), (903, [float("nan")] + [1.0] * 7), (904, [float("inf")] + [1.0] * 7),
       (905, [None] + [1.0] * 7), (906, [1.0] * 5), (None, [1.0] * 8), (907, [3.0] * 8), (908, [3.0] * 8)]


def grouped(rng, groups, size, noise, dim=8):
    rows = []
    for g in range(groups):
        centre = rng.normal(size=dim)
        rows += [centre + noise * rng.normal(size=dim) for _ in range(size)]
    return [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]


def brute_links(rows, threshold):
    ids = sorted(i for i, _ in rows)
    x = np.array([dict(rows)[i] for i in ids])
    u = x / np.sqrt((x * x).sum(1))[:, None]
    linked = u @ u.T >= threshold
    np.fill_diagonal(linked, False)
    root = np.arange(len(ids))
    while True:
        new = np.array([min([root[k], *root[linked[k]]]) for k in range(len(ids))])
        if (new == root).all():
            return ids, linked.sum(1), [ids[r] for r in root]
        root = new


@pytest.mark.parametrize("block", [7, 1024])
def test_pivot_index_is_exact_on_groups(spark, monkeypatch, block):
    monkeypatch.setattr(pivots, "BLOCK", block)
    rows = grouped(np.random.default_rng(1), 12, 15, 0.05, dim=24)
    rows += [(1000 + i, rows[3][1]) for i in range(5)]
    got = {r._key: r for r in pivots.near_duplicates(spark.createDataFrame(rows, VECTORS).repartition(3)).collect()}
    ids, degree, roots = brute_links(rows, 0.9)
    assert [got[i].n_links for i in ids] == degree.tolist()
    assert [got[i].component_id for i in ids] == roots


def test_pivot_index_of_one_tight_group(spark):
    """Vectors that are all close to the first: two alone, and forty."""
    two = [(1, [1.0, 0.0]), (2, [0.95, math.sqrt(1 - 0.95**2)])]
    for rows in (two, grouped(np.random.default_rng(3), 1, 40, 0.12, dim=16)):
        got = {r._key: r for r in pivots.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()}
        ids, degree, roots = brute_links(rows, 0.9)
        assert degree.sum() > 0
        assert [got[i].n_links for i in ids] == degree.tolist()
        assert [got[i].component_id for i in ids] == roots


def test_recall_holds_with_thousands_of_pivots():
    """Pairs that the layout was not chosen on, at the threshold, as many pivots as a large table has."""
    rng = np.random.default_rng(4)
    x = vectors.unit(rng.normal(size=(16_384, 64)))
    chosen = pivots.choose_pivots(x, 4096)
    n, lists, length, shared = pivots.layout(chosen, pivots.near_pairs(x, 0.9), 4, 8, 2)
    a = vectors.unit(rng.normal(size=(2000, 64)))
    away = rng.normal(size=a.shape)
    b = 0.9 * a + math.sqrt(0.19) * vectors.unit(away - (away * a).sum(1, keepdims=True) * a)
    recall = lambda n, k, m, s: pivots._met(*(pivots.nearest_pivots(v, chosen[:n], m) for v in (a, b)), k, m, s)
    print(len(chosen), (n, lists, length, shared), recall(n, lists, length, shared), recall(len(chosen), 4, 8, 2))
    assert recall(n, lists, length, shared) >= 0.98


def test_pivot_index_odd_rows(spark):
    frame = spark.createDataFrame([(i, v, "x") for i, v in ODD], VECTORS + ", n_links string")
    got = pivots.near_duplicates(frame).collect()
    assert len(got) == len(ODD)
    by = {r._key: r for r in got}
    assert by[907].n_links == by[908].n_links == 1 and by[908].component_id == 907 and not by[908].kept
    for i in (900, 901, 902, 903, 904, 905, 906):
        assert (by[i].n_links, by[i].component_id, by[i].kept) == (0, i, True)
    assert by[None].component_id is None and not by[None].kept
    assert pivots.near_duplicates(frame.limit(0)).count() == 0


@pytest.mark.parametrize("block", [16, 1024])
def test_learned_partitions(spark, monkeypatch, block):
    monkeypatch.setattr(partitions, "BLOCK", block)
    monkeypatch.setattr(partitions, "ROWS", 2 * block)
    rng = np.random.default_rng(2)
    rows = grouped(rng, 30, 40, 0.4, dim=16) + [(5000 + i, [1.0] * 16) for i in range(40)]
    base = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = partitions.nearest(base, base.where("vec_id % 20 = 0"), k=10, parts=16).collect()
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows])
    found, right = {}, 0
    for r in got:
        found.setdefault(r.query_id, []).append(r)
    assert set(found) == {i for i in ids if i % 20 == 0}
    for q, hits in found.items():
        k = int(np.flatnonzero(ids == q)[0])
        score = (x * x[k]).sum(axis=1)
        hits.sort(key=lambda r: r.rank)
        assert [r.rank for r in hits] == list(range(1, 11))
        assert all(r.vec_id != q and math.isclose(r.score, score[ids == r.vec_id][0], rel_tol=1e-12) for r in hits)
        assert [(-r.score, r.vec_id) for r in hits] == sorted((-r.score, r.vec_id) for r in hits)
        order = [ids[i] for i in np.lexsort((ids, -score)) if ids[i] != q][:10]
        right += len({r.vec_id for r in hits} & set(order))
    assert right >= 0.9 * 10 * len(found)
    assert [r.vec_id for r in found[5000]] == list(range(5001, 5011))


def test_learned_partitions_odd_rows(spark):
    frame = spark.createDataFrame(ODD, VECTORS)
    got = {(r.query_id, r.rank, r.vec_id) for r in partitions.nearest(frame, frame, k=3).collect()}
    assert got == {(907, 1, 908), (908, 1, 907)}
    assert partitions.nearest(frame.limit(0), frame.limit(0)).count() == 0


def test_unit_vectors_of_extreme_length():
    x = vectors.unit(np.array([[1e300, 1e300], [1e-300, 0.0]]))
    assert np.allclose((x * x).sum(axis=1), 1)
