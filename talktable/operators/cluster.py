"""k-means per call or per (agent, bucket), small groups in one task, large ones across the cluster.

One model per group is needed, so a single global model does not fit. Groups up to
``GROUP_ROWS`` vectors are clustered inside a task; larger ones by Lloyd steps written as joins
and partial aggregates, with the same starting points, the same draws and the same rules.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import dot, l2_normalize
from ..storage import materialize
from .intervals import nearest_in_time, number_customers
from .vectors import centroids, mean_vector, unit_vectors

GROUP_ROWS = 20_000


# --- one group inside a task ---------------------------------------------------------------------


def _start_points(x: np.ndarray, k: int) -> np.ndarray:
    """Row least like the mean, then rows least like the points chosen so far."""
    nearest = x @ x.mean(axis=0)
    chosen = [int(np.argmin(nearest))]
    nearest = x @ x[chosen[0]]
    while len(chosen) < k:
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, x @ x[chosen[-1]])
    return x[chosen].copy()


def _drawn_points(x: np.ndarray, k: int, races: np.ndarray) -> np.ndarray:
    """k-means++: each further row is drawn with its squared distance from the points chosen so far as weight.

    ``races`` has an exponential number per row and point; the row of the smallest number over weight wins, which is a draw
    by weight that needs only a minimum.
    """
    chosen = [int(np.argmin(races[:, 0]))]
    for c in range(1, k):
        weight = np.maximum(2 - 2 * (x @ x[chosen].T).max(axis=1), 0.0)
        with np.errstate(divide="ignore"):
            chosen.append(int(np.argmin(races[:, c] / np.where(weight > 1e-12, weight, 0.0))))
    return x[chosen].copy()


def _lloyd(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, float]:
    """Labels when none changes any more, and the sum of squared distances; an emptied cluster keeps its centre."""
    labels = None
    while True:
        costs = (centres**2).sum(axis=1) - 2 * (x @ centres.T)
        new = np.argmin(costs, axis=1)
        if labels is not None and (new == labels).all():
            return labels, float((1 + costs[np.arange(len(x)), new]).sum())
        labels = new
        for c in range(len(centres)):
            if (labels == c).any():
                centres[c] = x[labels == c].mean(axis=0)


def kmeans_labels(x: np.ndarray, k: int, races: np.ndarray | None = None) -> np.ndarray:
    """Best labels of unit rows in their given order over the fixed start and one start for each ``k`` columns of ``races``.

    The smallest sum of squared distances wins, to nine digits, the earlier start on a tie.
    """
    if k <= 1 or len(x) <= k:
        return np.zeros(len(x), dtype=np.int64)
    labels, cost = _lloyd(x, _start_points(x, k))
    for at in range(0, 0 if races is None else races.shape[1], k):
        tried, found = _lloyd(x, _drawn_points(x, k, races[:, at:at + k]))
        if round(found, 9) < round(cost, 9):
            labels, cost = tried, found
    return labels


def cosine_silhouette(x: np.ndarray, labels: np.ndarray) -> float:
    """Mean silhouette of unit rows from cluster sums; no pair of rows is formed."""
    ids = np.unique(labels)
    if len(ids) < 2:
        return -1.0
    sums = np.stack([x[labels == c].sum(axis=0) for c in ids])
    sizes = np.array([(labels == c).sum() for c in ids], dtype=float)
    total = sizes - x @ sums.T
    own = np.searchsorted(ids, labels)
    rows = np.arange(len(x))
    size = sizes[own]
    a = total[rows, own] / np.maximum(size - 1, 1)
    other = total / sizes
    other[rows, own] = np.inf
    b = other.min(axis=1)
    s = np.where(size > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-12), 0.0)
    return float(s.mean())


def choose_labels(x: np.ndarray, most: int = 3, gain: float = 0.05) -> np.ndarray:
    """Labels of the k whose silhouette beats the best so far by ``gain``; few rows are one cluster."""
    best, labels = -1.0, np.zeros(len(x), dtype=np.int64)
    if len(x) < 6:
        return labels
    for k in range(2, min(most, max(1, len(x) // 4)) + 1):
        tried = kmeans_labels(x, k)
        if len(np.unique(tried)) < 2:
            continue
        score = cosine_silhouette(x, tried)
        if score > best + gain:
            best, labels = score, tried
    return labels


def _race(order: str, start: int, point: int) -> Column:
    """Exponential number of a row for one point of one start, from a hash of its order value."""
    h = F.xxhash64(F.col(order).cast("bigint"), F.lit(start).cast("bigint"), F.lit(point).cast("bigint"))
    return -F.log((F.shiftrightunsigned(h, 11).cast("double") + 1) / float(1 << 53))


def _in_tasks(vectors: DataFrame, by: list[str], order: str, label, starts: int = 0, k: int = 0) -> DataFrame:
    schema = T.StructType(vectors.schema.fields + [T.StructField("cluster", T.LongType())])
    names, drawn = schema.names, starts * k > 0

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order, kind="stable")
        x = np.stack([np.asarray(v, dtype=np.float64) for v in group["embedding"]])
        length = np.linalg.norm(x, axis=1, keepdims=True)
        x = x / np.where(length > 0, length, 1.0)
        found = label(x, np.stack(group["__races"].tolist())) if drawn else label(x)
        return group.assign(cluster=found)[names]

    races = [_race(order, s, c) for s in range(starts) for c in range(k)]
    rows = vectors.withColumn("__races", F.array(*races)) if drawn else vectors
    return rows.groupBy(*by).applyInPandas(run, schema)


# --- large groups across the cluster -------------------------------------------------------------


def _centre_table(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row per group with its centres as a short array ordered by cluster."""
    return materialize(
        rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("cluster", "centre"))).alias("centres"))
    )


def _assign(unit: DataFrame, centres: DataFrame, by: list[str]) -> DataFrame:
    v = F.col("embedding")
    cost = lambda c: dot(c["centre"], c["centre"]) - 2 * dot(v, c["centre"])
    costs = F.transform("centres", lambda c: F.struct(cost(c).alias("cost"), c["cluster"].alias("cluster")))
    return unit.join(centres, by).withColumn("cluster", F.array_min(costs)["cluster"]).drop("centres")


def _grown(centres: DataFrame, more: DataFrame, by: list[str], number: int) -> DataFrame:
    held = centres.select(*by, F.explode("centres").alias("c")).select(*by, "c.*")
    return _centre_table(held.unionByName(more.withColumn("cluster", F.lit(number).cast("bigint"))), by)


def _fixed_start(unit: DataFrame, by: list[str], order: str, k: int) -> DataFrame:
    v = F.col("embedding")
    mean = materialize(unit.groupBy(*by).agg(mean_vector(v).alias("__mean")))
    pick = F.min_by("embedding", F.struct("__like", order))
    first = unit.join(mean, by).withColumn("__like", dot(v, F.col("__mean"))).groupBy(*by).agg(
        pick.alias("centre")
    )
    centres = _centre_table(first.withColumn("cluster", F.lit(0).cast("bigint")), by)
    for c in range(1, k):
        like = F.array_max(F.transform("centres", lambda x: dot(v, x["centre"])))
        centres = _grown(centres, unit.join(centres, by).withColumn("__like", like).groupBy(*by).agg(pick.alias("centre")), by, c)
    return centres


def _drawn_start(unit: DataFrame, by: list[str], order: str, k: int, start: int) -> DataFrame:
    """The same draws as in a task: a minimum for each point, with partial results."""
    v = F.col("embedding")
    pick = F.min_by("embedding", F.struct("__race", order)).alias("centre")
    first = unit.withColumn("__race", _race(order, start, 0)).groupBy(*by).agg(pick)
    centres = _centre_table(first.withColumn("cluster", F.lit(0).cast("bigint")), by)
    for c in range(1, k):
        weight = 2 - 2 * F.array_max(F.transform("centres", lambda x: dot(v, x["centre"])))
        race = F.when(weight > 1e-12, _race(order, start, c) / weight).otherwise(F.lit(float("inf")))
        centres = _grown(centres, unit.join(centres, by).withColumn("__race", race).groupBy(*by).agg(pick), by, c)
    return centres


def _settled(unit: DataFrame, by: list[str], centres: DataFrame) -> DataFrame:
    """Centres after Lloyd steps until none moves."""
    v = F.col("embedding")
    while True:
        means = _assign(unit, centres, by).groupBy(*by, "cluster").agg(mean_vector(v).alias("__new"))
        old = centres.select(*by, F.explode("centres").alias("c")).select(*by, "c.*")
        moved = old.join(means, [*by, "cluster"], "left").select(
            *by, "cluster", F.coalesce("__new", "centre").alias("centre")
        )
        new = _centre_table(moved, by)
        still = centres.join(new.withColumnRenamed("centres", "__c"), by).where(
            F.exists(
                F.zip_with("centres", "__c", lambda a, b: F.exists(
                    F.zip_with(a["centre"], b["centre"], lambda p, q: F.abs(p - q)), lambda d: d > 1e-12)),
                lambda changed: changed,
            )
        ).isEmpty()
        centres = new
        if still:
            return centres


def _lloyd_across(unit: DataFrame, by: list[str], order: str, k: int, starts: int = 0) -> DataFrame:
    tried = [_settled(unit, by, _fixed_start(unit, by, order, k))]
    tried += [_settled(unit, by, _drawn_start(unit, by, order, k, s)) for s in range(starts)]
    if not starts:
        return _assign(unit, tried[0], by)
    v, every = F.col("embedding"), None
    for s, centres in enumerate(tried):
        near = F.array_min(F.transform("centres", lambda c: 1 + dot(c["centre"], c["centre"]) - 2 * dot(v, c["centre"])))
        costs = unit.join(centres, by).groupBy(*by).agg(F.round(F.sum(near), 9).alias("__cost")).join(centres, by).withColumn("__start", F.lit(s))
        every = costs if every is None else every.unionByName(costs)
    best = materialize(every.groupBy(*by).agg(F.min_by("centres", F.struct("__cost", "__start")).alias("centres")))
    return _assign(unit, best, by)


def _silhouette_across(labelled: DataFrame, by: list[str]) -> DataFrame:
    v = F.col("embedding")
    sums = materialize(
        labelled.groupBy(*by, "cluster").agg(mean_vector(v).alias("m"), F.count("*").alias("n"))
        .groupBy(*by).agg(F.collect_list(F.struct("cluster", "m", "n")).alias("parts"))
    )
    distance = lambda p: p["n"] * (1.0 - dot(v, p["m"]))
    own = F.filter("parts", lambda p: p["cluster"] == F.col("cluster"))
    a = F.array_max(F.transform(own, lambda p: distance(p) / F.greatest(p["n"] - 1, F.lit(1))))
    size = F.array_max(F.transform(own, lambda p: p["n"]))
    b = F.array_min(
        F.transform(F.filter("parts", lambda p: p["cluster"] != F.col("cluster")), lambda p: distance(p) / p["n"])
    )
    s = F.when(size > 1, (b - a) / F.greatest(a, b, F.lit(1e-12))).otherwise(0.0)
    return labelled.join(sums, by).where(F.size("parts") > 1).groupBy(*by).agg(F.avg(s).alias("score"))


def _choose_across(unit: DataFrame, by: list[str], order: str, most: int = 3, gain: float = 0.05) -> DataFrame:
    sizes = unit.groupBy(*by).agg(F.count("*").alias("__n"))
    best = None
    for k in range(2, most + 1):
        wide = sizes.where((F.col("__n") >= 6) & (F.floor(F.col("__n") / 4) >= k)).select(*by)
        tried = materialize(_lloyd_across(unit.join(wide, by, "left_semi"), by, order, k))
        scores = materialize(_silhouette_across(tried, by))
        labels = tried.select(*by, order, F.col("cluster").alias("__new"))
        if best is None:
            good = scores.where(F.col("score") > -1.0 + gain)
            best, held = labels.join(good.select(*by), by, "left_semi").withColumnRenamed("__new", "__best"), scores
        else:
            better = materialize(
                scores.join(held.withColumnRenamed("score", "__held"), by, "left")
                .where(F.col("score") > F.coalesce(F.col("__held"), F.lit(-1.0)) + gain).select(*by)
            )
            best = best.join(better, by, "left_anti").unionByName(
                labels.join(better, by, "left_semi").withColumnRenamed("__new", "__best")
            )
    return unit.join(best, [*by, order], "left").withColumn(
        "cluster", F.coalesce("__best", F.lit(0).cast("bigint"))
    ).drop("__best")


def _by_size(vectors: DataFrame, by: list[str], group_rows: int, small, large) -> DataFrame:
    rows = vectors.where(F.col("embedding").isNotNull())
    big = rows.groupBy(*by).agg(F.count("*").alias("__n")).where(F.col("__n") > group_rows).select(*by)
    if big.isEmpty():
        return small(rows)
    big = materialize(big)
    apart = large(unit_vectors(rows.join(big, by, "left_semi")))
    return small(rows.join(big, by, "left_anti")).unionByName(
        apart.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in rows.schema.fields], "cluster")
    )


def cluster_groups(vectors: DataFrame, by: list[str], k: int = 2, order: str = "seg_idx",
                   group_rows: int = GROUP_ROWS, starts: int = 0) -> DataFrame:
    """Add ``cluster`` 0…k-1 per group; rows without a vector are left out.

    ``order``, a whole number, must be unique within a group: it breaks ties and seeds the draws, so results do not depend
    on how the rows are partitioned. Besides the fixed start ``starts`` k-means++ starts are tried, and the smallest sum of squared
    distances is kept.
    """
    # a group of at most k vectors is one cluster, which a task sees
    return _by_size(
        vectors, by, max(group_rows, k),
        lambda rows: _in_tasks(rows, by, order, lambda x, races=None: kmeans_labels(x, k, races), starts, k),
        lambda rows: _lloyd_across(rows, by, order, k, starts),
    )


def choose_customer_k(vectors: DataFrame, by: list[str], order: str = "seg_idx", most: int = 3,
                      group_rows: int = GROUP_ROWS) -> DataFrame:
    """Add ``cluster`` with the number of clusters chosen per group by cosine silhouette."""
    return _by_size(
        vectors, by, group_rows,
        lambda rows: _in_tasks(rows, by, order, lambda x: choose_labels(x, most)),
        lambda rows: _choose_across(rows, by, order, most),
    )


def two_speaker_split(segments: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Two clusters per call; segments without a vector take that of the nearest one in time.

    Calls with fewer than two vectors are one speaker.
    """
    labelled = cluster_groups(segments, ["call_id"], 2, "seg_idx", group_rows)
    few = (
        segments.groupBy("call_id").agg(F.count("embedding").alias("n")).where(F.col("n") < 2).select("call_id")
    )
    rest = segments.where(F.col("embedding").isNull()).withColumn("cluster", F.lit(None).cast("bigint"))
    split = nearest_in_time(
        labelled.select("call_id", "seg_idx", "start_s", "end_s", "cluster").unionByName(
            rest.select("call_id", "seg_idx", "start_s", "end_s", "cluster")
        ), "cluster",
    ).join(few.withColumn("__few", F.lit(True)), "call_id", "left")
    cluster = F.when(F.col("__few").isNotNull(), F.lit(0)).otherwise(F.col("cluster")).cast("bigint")
    return split.select("call_id", "seg_idx", "start_s", "end_s", cluster.alias("cluster")).withColumn(
        "speaker", F.concat(F.lit("SPEAKER_"), F.lpad(F.col("cluster").cast("string"), 2, "0"))
    )


def voiceprint_centroids(vectors: DataFrame, by: list[str], order: str, most: int = 2,
                         per_cluster: int = 30, unit: bool = True,
                         group_rows: int = GROUP_ROWS, starts: int = 4) -> DataFrame:
    """Voiceprints per group: ``max(1, min(most, n / per_cluster))`` clusters, the best of several starts, one centroid each."""
    sizes = materialize(
        vectors.where(F.col("embedding").isNotNull()).groupBy(*by).agg(F.count("*").alias("__n"))
        .withColumn("__k", F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.col("__n") / per_cluster))).cast("int"))
        .select(*by, "__k")
    )
    parts = [
        vectors.where(F.col("embedding").isNotNull())
        .join(sizes.where(F.col("__k") == 1).select(*by), by, "left_semi")
        .withColumn("cluster", F.lit(0).cast("bigint"))
    ]
    for k in range(2, most + 1):
        wide = vectors.join(sizes.where(F.col("__k") == k).select(*by), by, "left_semi")
        parts.append(cluster_groups(wide, by, k, order, group_rows, starts))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    found = centroids(rows, [*by, "cluster"], unit=unit)
    first = rows.groupBy(*by, "cluster").agg(F.min(order).alias("__first"))
    return found.join(first, [*by, "cluster"]).select(
        *by, F.col("cluster").alias("vp_idx"), F.col("n").alias("n_clips"),
        F.col("centroid").alias("embedding"),
    )


def larger_cluster(vectors: DataFrame, by: list[str], order: str, least: int = 6,
                   group_rows: int = GROUP_ROWS) -> DataFrame:
    """Recordings without labels: of two clusters the larger one (0 on a tie) is the agent.

    Returns the agent's unit centroid per recording with at least ``least`` windows.
    """
    enough = vectors.where(F.col("embedding").isNotNull()).groupBy(*by).agg(F.count("*").alias("__n")).where(
        F.col("__n") >= least
    ).select(*by)
    rows = cluster_groups(vectors.join(enough, by, "left_semi"), by, 2, order, group_rows)
    parts = rows.groupBy(*by, "cluster").agg(
        mean_vector(F.col("embedding")).alias("m"), F.count("*").alias("n")
    )
    return parts.groupBy(*by).agg(
        F.max_by(F.struct("cluster", "m", "n"), F.struct(F.col("n"), -F.col("cluster"))).alias("w"),
        F.sum("n").alias("n_windows"),
    ).select(*by, "n_windows", F.col("w.n").alias("n_agent"), l2_normalize(F.col("w.m")).alias("centroid"))


def cluster_first_roles(segments: DataFrame, floor: float = 0.20, margin: float = 0.05,
                        sure: float = 0.50, likely: float = 0.42,
                        group_rows: int = GROUP_ROWS) -> DataFrame:
    """Roles of whole calls from two clusters, corrected by similarity to the agent.

    ``segments`` has ``call_id, seg_idx, start_s, end_s, embedding, sim``. The cluster with the
    higher mean similarity is the agent's. Adds ``is_agent``, ``customer_idx`` (1-based) and ``clustered``: calls with fewer than
    two vectors are not clustered, and a similarity of ``likely`` makes a segment the agent's.
    """
    v = F.col("embedding")
    small = segments.groupBy("call_id").agg(F.count("embedding").alias("__n")).where("__n < 2").select("call_id")
    alone = segments.join(small, "call_id", "left_semi").withColumn("is_agent", F.coalesce(F.col("sim") >= likely, F.lit(False)))
    segments = segments.join(small, "call_id", "left_anti")
    clustered = materialize(
        cluster_groups(segments.select("call_id", "seg_idx", "start_s", "end_s", "embedding", "sim"),
                       ["call_id"], 2, "seg_idx", group_rows)
    )
    # the first cluster met wins a tie, so order by mean, then by first segment
    stats = clustered.groupBy("call_id", "cluster").agg(
        F.avg("sim").alias("mean_sim"), F.min("seg_idx").alias("first_idx"),
        F.min("start_s").alias("start_s"), l2_normalize(mean_vector(v)).alias("centre"),
    )
    rank = F.struct(F.round("mean_sim", 9), -F.col("first_idx"))
    calls = materialize(
        stats.groupBy("call_id").agg(
            F.max_by("cluster", rank).alias("agent_cluster"),
            F.collect_list(F.struct("cluster", "centre")).alias("centres"),
        )
    )
    placed = nearest_in_time(
        clustered.select("call_id", "seg_idx", "start_s", "end_s", "cluster").unionByName(
            segments.where(v.isNull()).select(
                "call_id", "seg_idx", "start_s", "end_s", F.lit(None).cast("bigint").alias("cluster")
            )
        ), "cluster",
    ).select("call_id", "seg_idx", "cluster")
    toward = lambda c: F.get(
        F.transform(F.filter("centres", lambda x: x["cluster"] == c), lambda x: dot(F.col("unit"), x["centre"])), F.lit(0)
    )
    agent, mine = F.col("agent_cluster"), F.col("cluster")
    # two clusters: the only customer one is the other
    other = F.get(F.transform(F.filter("centres", lambda x: x["cluster"] != agent), lambda x: x["cluster"]), F.lit(0))
    has = F.col("unit").isNotNull()
    demote = (mine == agent) & (F.col("sim") < floor) & has & (toward(other) > toward(agent) + margin)
    promote = (mine != agent) & (
        (F.col("sim") >= sure) | ((F.col("sim") >= likely) & has & (F.col("sim") > toward(mine)))
    )
    mixed = (
        segments.join(placed, ["call_id", "seg_idx"])
        .join(calls, "call_id")
        .withColumn("unit", l2_normalize(v))
        .withColumn(
            "is_agent",
            F.when(demote, False).when(promote, True).otherwise(mine == agent),
        )
        .drop("unit", "centres", "agent_cluster", "cluster")
    )
    both = mixed.withColumn("clustered", F.lit(True)).unionByName(alone.withColumn("clustered", F.lit(False)))
    return both.withColumn("customer_idx", F.when(~F.col("is_agent"), F.lit(1)))
