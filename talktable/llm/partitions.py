"""Approximate nearest neighbours by learned partitions."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talktable.llm.vectors import BLOCK, matrix, sample, usable
from talktable.storage import materialize

#: rows of the table in one block; a query returns ``k`` rows from each block it meets, so blocks are large
ROWS = 8 * BLOCK
HITS = "query_id long, vec_id long, score double"


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the ``k`` rows of largest inner product with each row, itself left out."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 1024):
        s = x[at:at + 1024] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out[at:at + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else out[at:at + 1024]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 15, slack: float = 0.1) -> np.ndarray:
    """Part of each row: few graph edges between parts, none larger than its share and ``slack``.

    Halving at the median of the main direction gives even parts; then rows move to the part most of their
    neighbours are in, those that gain most first, while it has room.
    """
    part = np.zeros(len(x), np.int64)
    pending = [(np.arange(len(x)), parts, 0)]
    while pending:
        rows, n, first = pending.pop()
        if n == 1 or len(rows) < 2:
            part[rows] = first
            continue
        y = x[rows] - x[rows].mean(0)
        direction = np.linalg.eigh(y.T @ y)[1][:, -1]
        order = np.argsort(y @ direction, kind="stable")
        half = n // 2
        cut = round(len(rows) * half / n)
        pending += [(rows[order[:cut]], half, first), (rows[order[cut:]], n - half, first + half)]
    room = math.ceil(len(x) / parts * (1 + slack))
    back = np.concatenate([graph.ravel(), np.repeat(np.arange(len(x)), graph.shape[1])])
    ahead = np.concatenate([np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()])
    for _ in range(rounds):
        votes = np.zeros((len(x), parts), np.int32)
        np.add.at(votes, (ahead, part[back]), 1)
        best = votes.argmax(1)
        gain = votes[np.arange(len(x)), best] - votes[np.arange(len(x)), part]
        size = np.bincount(part, minlength=parts)
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[best[i]] < room:
                size[part[i]] -= 1
                size[best[i]] += 1
                part[i] = best[i]
                moved += 1
        if not moved:
            break
    return part


@dataclass
class Router:
    """Softmax classifier from a vector to its part, and how many parts a query visits."""

    weights: np.ndarray
    bias: np.ndarray
    scale: float
    probes: int = 1

    def logits(self, x: np.ndarray) -> np.ndarray:
        return (x / self.scale) @ self.weights + self.bias

    def top(self, x: np.ndarray, n: int) -> np.ndarray:
        return np.argsort(-self.logits(x), axis=1, kind="stable")[:, :n].astype(np.int32)


def fit_router(x: np.ndarray, part: np.ndarray, parts: int, steps: int = 300, rate: float = 0.05, decay: float = 1e-4) -> Router:
    """Softmax regression with Adam on all rows of the sample; starts from zero, so it is repeatable."""
    scale = float(np.sqrt((x * x).mean())) or 1.0
    z = np.concatenate([x / scale, np.ones((len(x), 1))], axis=1)
    w, m, v = (np.zeros((z.shape[1], parts)) for _ in range(3))
    for t in range(1, steps + 1):
        s = z @ w
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(z)), part] -= 1
        g = z.T @ p / len(z) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-9)
    return Router(w[:-1], w[-1], scale)


def fit(x: np.ndarray, parts: int, k: int, recall: float, graph_k: int = 10) -> Router:
    """Router of a sample: its neighbour graph is cut into balanced parts, the classifier learns them.

    ``probes`` is the smallest number of parts at which every 8th row of the sample finds ``recall`` of its
    ``k`` neighbours in the sample. Neighbours in the whole table are closer than those in a sample of it.
    """
    parts = max(1, min(parts, len(x) // 16))
    if parts == 1:
        return Router(np.zeros((x.shape[1] if x.ndim == 2 else 0, 1)), np.zeros(1), 1.0, 1)
    router = fit_router(x, balanced_parts(x, neighbour_graph(x, graph_k), parts), parts)
    home = router.top(x, 1)[:, 0]
    asked = np.arange(0, len(x), 8)
    near = neighbour_graph(x, k)[asked]
    visited = router.top(x[asked], parts)
    rank = np.empty_like(visited)
    np.put_along_axis(rank, visited, np.arange(parts, dtype=np.int32)[None, :].repeat(len(asked), 0), axis=1)
    needed = np.sort(np.take_along_axis(rank, home[near], axis=1).ravel())
    router.probes = int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)))]) + 1
    return router


def best_of_block(queries: np.ndarray, query_ids: np.ndarray, base: np.ndarray, base_ids: np.ndarray, k: int):
    """The ``k`` best rows of ``base`` for each query: larger inner product first, then smaller id.

    The matrix product finds who may be among them; scores are then summed row by row, so that equal vectors
    have equal scores wherever they stand.
    """
    rough = queries @ base.T
    take = min(k + 1, base.shape[0])
    edge = np.partition(rough, base.shape[0] - take, axis=1)[:, base.shape[0] - take]
    slack = 1e-9 * (1 + np.abs(edge))
    out = []
    for q in range(len(queries)):
        may = np.flatnonzero(rough[q] >= edge[q] - slack[q])
        may = may[base_ids[may] != query_ids[q]]
        exact = (base[may] * queries[q]).sum(axis=1)
        order = np.lexsort((base_ids[may], -exact))[:k]
        out.append((np.full(len(order), query_ids[q]), base_ids[may][order], exact[order]))
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]


def nearest(base: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
            parts: int | None = None, recall: float = 0.95, sampled: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query up to ``k`` rows of ``base`` of largest inner product found.

    The router is fitted on the ``sampled`` rows of smallest hashed id (see ``fit``); ``parts`` defaults to an
    eighth of the square root of the number of rows, at least 16 and at most 1,024. Every row of ``base`` is
    indexed in the part the classifier gives it most; a query goes to its ``probes`` most probable parts and
    is compared with all their rows, 1,024 queries against blocks of 8,192: a large part is many small tasks. Each
    block returns ``k`` rows a query at most.

    Scores are sums in double precision of the vectors as they are; the first rank is 1, ties go to the
    smaller id, and a query is never its own answer. Vectors that cannot be compared (see ``vectors.usable``)
    take no part as query or row. Rows that repeat with one id are one candidate. Other columns are not read;
    an empty table gives an empty one.
    """
    spark = base.sparkSession
    table = materialize(usable(base, id_col, vector_col).dropDuplicates(["_key"]))
    asked = usable(queries, id_col, vector_col).dropDuplicates(["_key"])
    n = table.count()
    _, drawn = sample(table, sampled)
    router = fit(drawn, parts or min(1024, max(16, math.isqrt(n) // 8)), k, recall) if n else Router(np.zeros((0, 1)), np.zeros(1), 1.0)
    model = spark.sparkContext.broadcast(router)

    def route(probes: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                top = model.value.top(matrix(batch.column("vector")), probes)
                offsets = pa.array(np.arange(len(top) + 1, dtype=np.int32) * top.shape[1] if len(top) else np.zeros(1, np.int32))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(top.ravel()))], ["_key", "vector", "parts"])
        return run

    ddl = "_key long, vector array<double>, parts array<int>"
    homes = materialize(table.mapInArrow(route(1), ddl).select("_key", "vector", F.col("parts")[0].alias("part")))
    visits = materialize(asked.mapInArrow(route(router.probes), ddl).select("_key", "vector", F.explode("parts").alias("part")))
    blocks = lambda rows, size, name: rows.groupBy("part").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    # one row per part
    sizes = F.broadcast(blocks(homes, ROWS, "n_base").join(blocks(visits, BLOCK, "n_query"), "part"))
    own = lambda n: F.pmod(F.xxhash64("_key"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = homes.join(sizes, "part").select("_key", "vector", "part", own("n_base").alias("b"), every("n_query").alias("q"))
    right = visits.join(sizes, "part").select("_key", "vector", "part", own("n_query").alias("q"), every("n_base").alias("b"))

    def search(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        if not len(rows) or not len(wanted):
            found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        else:
            found = best_of_block(matrix(wanted.column("vector")), wanted.column("_key").to_numpy(),
                                  matrix(rows.column("vector")), rows.column("_key").to_numpy(), k)
        return pa.table({"query_id": found[0], "vec_id": found[1], "score": found[2]})

    keys = ("part", "b", "q")
    hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, HITS)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
