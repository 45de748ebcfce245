"""Near duplicates among vectors by a pivot-permutation index."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talktable.llm.common import components, smallest_linked
from talktable.llm.vectors import BLOCK, matrix, sample, unit, usable
from talktable.storage import materialize

LINKS = "rep long, n_links long, low long"


def choose_pivots(x: np.ndarray, n: int, apart: float = 0.8) -> np.ndarray:
    """Up to ``n`` of the unit vectors ``x``, in order, none closer than ``apart`` to an earlier one; then those least close."""
    chosen: list[np.ndarray] = []
    for v in x:
        if not chosen or (np.array(chosen) @ v).max() < apart:
            chosen.append(v)
            if len(chosen) == n:
                break
    if chosen and len(chosen) < n:
        near = (x @ np.array(chosen).T).max(axis=1)
        while len(chosen) < n and near.min() < 1 - 1e-12:
            chosen.append(x[near.argmin()])
            near = np.maximum(near, x @ chosen[-1])
    return np.array(chosen)


def near_pairs(x: np.ndarray, threshold: float, most: int = 2000) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs to measure recall on: of unit vectors ``x`` those just above ``threshold``, and made ones right at it."""
    if not len(x):
        return []
    x = x[-most:]  # pivots are taken from the front and meet themselves
    i, j = np.nonzero(np.triu(x @ x.T >= threshold, 1))
    last = np.argsort((x[i] * x[j]).sum(axis=1), kind="stable")[:most]
    found = [(x[i[last]], x[j[last]])] if len(i) else []
    if len(x) and x.shape[1] > 1:
        away = np.random.default_rng(7).normal(size=x.shape)
        away = unit(away - (away * x).sum(axis=1, keepdims=True) * x)
        found.append((x, threshold * x + math.sqrt(max(0.0, 1 - threshold * threshold)) * away))
    return found


def layout(pivots: np.ndarray, pairs: list, lists: int, length: int, shared: int, recall: float = 0.99) -> tuple[int, int, int, int]:
    """(pivots, lists, length, shared) with fewest comparisons that finds ``recall`` of each kind of ``pairs``.

    Comparisons grow with lists * lists / pivots. Fewer pivots or more lists than given are taken as far as recall needs
    them; one pivot compares all with all and misses none. ``shared`` cannot be above the number of pivots.
    """
    best, n = None, len(pivots)
    while n:
        orders = [tuple(nearest_pivots(v, pivots[:n], max(length, 16 * lists)) for v in pair) for pair in pairs]
        for k in sorted({min(n, int(lists * f)) for f in (1, 1.5, 2, 3, 4, 6, 8)}):
            wide = min(n, max(length, 2 * k))
            least = min(shared, wide)
            if best is None or k * k / n < best[0]:
                if all(_met(a, b, k, wide, least) >= recall for a, b in orders):
                    best = k * k / n, (n, k, wide, least)
                    break
        n //= 2
    return best[1] if best else (0, lists, length, shared)


def _met(a: np.ndarray, b: np.ndarray, lists: int, length: int, shared: int) -> float:
    """Share of the pairs of orders that are candidates."""
    common = np.zeros(len(a), np.int64)
    listed = np.zeros(len(a), bool)
    for k in range(length):
        common += (a[:, k, None] == b[:, :length]).any(axis=1)
        if k < lists:
            listed |= (a[:, k, None] == b[:, :lists]).any(axis=1)
    return float((listed & (common >= shared)).mean())


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, n: int) -> np.ndarray:
    """Indexes of the ``n`` nearest pivots of each unit vector, nearest first, ties to the smaller index."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :n].astype(np.int32)


def _block_links(a: dict, b: dict, pivot: int, lists: int, shared: int, threshold: float, same: bool):
    """Per row of both blocks: copies linked, and the smallest id linked through this pair of blocks."""
    ids = np.concatenate([a["rep"], b["rep"]])
    if same:
        b, ids = a, a["rep"]
    used, at = np.unique(np.concatenate([a["order"].ravel(), b["order"].ravel()]), return_inverse=True)
    at_a, at_b = at[:a["order"].size].reshape(a["order"].shape), at[a["order"].size:].reshape(b["order"].shape)
    has_a, has_b = (np.zeros((len(x), len(used)), np.float32) for x in (at_a, at_b))
    np.put_along_axis(has_a, at_a, 1, axis=1)
    np.put_along_axis(has_b, at_b, 1, axis=1)
    linked = (a["unit"] @ b["unit"].T >= threshold) & (has_a @ has_b.T >= shared)
    if same:
        np.fill_diagonal(linked, False)
    i, j = np.nonzero(linked)
    counts = np.zeros(len(ids), np.int64)
    low = ids
    shift = 0 if same else len(a["rep"])
    if len(i):
        # a pair that shares several lists is counted in that of the smallest pivot
        common = np.full(len(i), np.iinfo(np.int32).max)
        for k in range(lists):
            pair_a = a["order"][i, k]
            met = np.zeros(len(i), bool)
            for other in range(lists):
                met |= pair_a == b["order"][j, other]
            common[met] = np.minimum(common[met], pair_a[met])
        mine = common == pivot
        np.add.at(counts, i[mine], b["n"][j[mine]])
        if not same:
            np.add.at(counts, j[mine] + shift, a["n"][i[mine]])
        low = smallest_linked(ids, i, j + shift)
    return ids, counts, low


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9,
                    lists: int = 4, length: int = 8, shared: int = 2, max_pivots: int = 4096) -> DataFrame:
    """One row per row: ``_key`` (its id), ``n_links``, ``component_id`` and ``kept``.

    Equal vectors are one node with a count. About the square root of their number of pivots, at most
    ``max_pivots`` and none close to another, are taken from a sample of four times as many. A vector is
    described by its ``length`` nearest pivots in order and stands in the lists of the first ``lists``; with the
    pivots at hand both are raised until 99 of 100 pairs at the threshold are found on the sample (see ``layout``). Two
    vectors of a list that share at least ``shared`` described pivots are candidates; those with a cosine of
    ``threshold`` or more, in double precision, link. A list is compared block against block of 1,024 rows:
    a long one is many small tasks, and what comes out is a count and one link per row and pair of blocks.

    ``n_links`` counts the other rows linked directly, copies included; ``component_id`` is the smallest id
    reachable; ``kept`` marks its row. Vectors that cannot be compared (see ``vectors.usable``) have no links
    and are their own component; a null id gives a null component and is not kept. Rows that repeat are
    copies of each other. Other columns are not read; an empty table gives an empty one.
    """
    spark = rows.sparkSession
    vectors = materialize(usable(rows, id_col, vector_col))
    reps = materialize(vectors.groupBy("vector").agg(F.min("_key").alias("rep"), F.count("*").alias("n")))
    goal = min(max_pivots, max(64, math.isqrt(reps.count())))
    _, drawn = sample(reps.select(F.col("rep").alias("_key"), "vector"), 4 * goal)
    drawn = unit(drawn)
    chosen = choose_pivots(drawn, goal)
    n, lists, length, shared = layout(chosen, near_pairs(drawn, threshold), lists, length, shared)
    pivots = spark.sparkContext.broadcast(chosen[:n])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = nearest_pivots(unit(matrix(batch.column("vector"))), pivots.value, length)
            offsets = pa.array(np.arange(len(order) + 1, dtype=np.int32) * order.shape[1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(order.ravel()))], [*batch.schema.names, "ordered"]
            )

    described = materialize(reps.mapInArrow(describe, "vector array<double>, rep long, n long, ordered array<int>"))
    listed = described.select("*", F.explode(F.slice("ordered", 1, lists)).alias("pivot"))
    sizes = described.select(F.explode(F.slice("ordered", 1, lists)).alias("pivot")).groupBy("pivot").agg(
        F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")
    )
    mine = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    # at most max_pivots rows
    placed = listed.join(F.broadcast(sizes), "pivot").withColumn("block", mine)
    paired = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "rep", "n", "vector", "ordered", "pivot", "block",
        F.least("block", "other").alias("low_block"), F.greatest("block", "other").alias("high_block"),
    )

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("rep")
        order, x = matrix(group.column("ordered")), unit(matrix(group.column("vector")))
        rep, n, block = (group.column(c).to_numpy() for c in ("rep", "n", "block"))
        low, high = group.column("low_block")[0].as_py(), group.column("high_block")[0].as_py()
        sides = [{"rep": rep[m], "n": n[m], "order": order[m], "unit": x[m]} for m in (block == low, block == high)]
        found, counts, least = _block_links(*sides, group.column("pivot")[0].as_py(), lists, shared, threshold, low == high)
        some = (counts > 0) | (least != found)
        return pa.table({"rep": found[some], "n_links": counts[some], "low": least[some]})

    links = materialize(paired.groupBy("pivot", "low_block", "high_block").applyInArrow(compare, LINKS))
    roots = components(links.select(F.col("rep").alias("a"), F.col("low").alias("b")))
    counts = links.groupBy("rep").agg(F.sum("n_links").alias("linked"))
    facts = (
        reps.join(counts, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left")
        .select("vector", "rep", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("root"))
    )
    facts = materialize(facts)
    least = facts.groupBy("root").agg(F.min("rep").alias("component_id"))
    facts = materialize(facts.join(least, "root").select("vector", "n_links", "component_id"))
    found = vectors.join(facts, "vector").select("_key", "n_links", "component_id")
    # rows without a comparable vector; ids may repeat, so the vector itself decides
    rest = _rest(rows, vectors, id_col)
    out = found.unionByName(rest.select("_key", F.lit(0).cast("long").alias("n_links"), F.col("_key").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("_key") == F.col("component_id"), F.lit(False)))


def _rest(rows: DataFrame, vectors: DataFrame, id_col: str) -> DataFrame:
    """Ids that ``vectors`` has less often than ``rows``, as often as they lack."""
    ids = rows.select(F.col(id_col).cast("long").alias("_key")).withColumn("_n", F.lit(1))
    have = vectors.select("_key").withColumn("_n", F.lit(-1))
    lacking = ids.unionByName(have).groupBy("_key").agg(F.sum("_n").alias("_n")).where("_n > 0")
    return lacking.select("_key", F.explode(F.sequence(F.lit(1), F.col("_n")))).select("_key")
