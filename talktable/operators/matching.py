"""Vectors against the voiceprint registry: best cosine per agent, best agent per vector."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..storage import materialize

REGISTRY_BYTES = 64 << 20
CHUNK_PRINTS = 2048
#: products held at once in a worker
TILE_BYTES = 64 << 20
SALT_ROWS = 50_000

_SCORES = T.ArrayType(
    T.StructType([T.StructField("agent_slug", T.StringType()), T.StructField("sim", T.DoubleType())])
)


class PackedRegistry:
    """Unit voiceprints grouped by dimension, agents in slug order."""

    def __init__(self, prints):
        by_dim: dict[int, dict[str, list]] = {}
        for slug, vector in prints:
            v = np.asarray(vector, dtype=np.float64)
            length = np.linalg.norm(v)
            by_dim.setdefault(len(v), {}).setdefault(slug, []).append(v / length if length > 0 else v)
        self.by_dim = {}
        for dim, agents in by_dim.items():
            slugs = sorted(agents)
            starts = np.cumsum([0] + [len(agents[s]) for s in slugs[:-1]])
            matrix = np.vstack([np.vstack(agents[s]) for s in slugs])
            self.by_dim[dim] = (slugs, starts, matrix)

    def similarities(self, dim: int, matrix: np.ndarray) -> np.ndarray:
        """Rows × agents: best cosine over each agent's voiceprints."""
        _, starts, prints = self.by_dim[dim]
        lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
        unit = matrix / np.where(lengths > 0, lengths, 1.0)
        tile = max(1, TILE_BYTES // (8 * len(prints)))
        parts = [
            np.maximum.reduceat(unit[at:at + tile] @ prints.T, starts, axis=1) for at in range(0, len(unit), tile)
        ]
        return np.concatenate(parts) if parts else np.zeros((0, len(starts)))


def _score_batch(registry: PackedRegistry, column, best_only: bool) -> pa.ListArray:
    """Score one Arrow list column; vectors that are null or of unknown dimension get null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    dims = np.asarray(column.value_lengths().fill_null(-1))
    first = np.asarray(column.offsets)
    flat = np.asarray(column.values.cast(pa.float64()))
    width = np.zeros(len(column), dtype=np.int64)
    names: list[str] = []
    found = []
    for dim, (slugs, _, _) in registry.by_dim.items():
        rows = np.flatnonzero(dims == dim)
        if not len(rows):
            continue
        sims = registry.similarities(dim, flat[first[rows][:, None] + np.arange(dim)])
        picks = np.broadcast_to(np.arange(len(slugs)), sims.shape)
        if best_only:
            best = sims.argmax(axis=1)[:, None]
            sims, picks = np.take_along_axis(sims, best, 1), best
        width[rows] = sims.shape[1]
        found.append((rows, sims, picks + len(names)))
        names.extend(slugs)
    ends = np.concatenate([[0], np.cumsum(width)])
    sim = np.zeros(ends[-1])
    pick = np.zeros(ends[-1], dtype=np.int64)
    for rows, sims, picks in found:
        at = ends[rows][:, None] + np.arange(sims.shape[1])
        sim[at], pick[at] = sims, picks
    entries = pa.StructArray.from_arrays(
        [pa.array(names, pa.string()).take(pa.array(pick)), pa.array(sim)], names=["agent_slug", "sim"]
    )
    return pa.ListArray.from_arrays(
        pa.array(ends, pa.int32()), entries, mask=pa.array(width == 0)
    )


def _scored_schema(vectors: DataFrame) -> T.StructType:
    return T.StructType(vectors.schema.fields + [T.StructField("scores", _SCORES)])


def _score_with(vectors: DataFrame, registry: PackedRegistry, embedding: str, best_only: bool):
    schema = _scored_schema(vectors)
    arrow = to_arrow_schema(schema)
    shared = vectors.sparkSession.sparkContext.broadcast(registry)

    def score(batches):
        for batch in batches:
            scores = _score_batch(
                shared.value, batch.column(batch.schema.get_field_index(embedding)), best_only
            )
            arrays = list(batch.columns) + [scores.cast(arrow.field("scores").type)]
            yield pa.RecordBatch.from_arrays(arrays, names=arrow.names)

    return vectors.mapInArrow(score, schema)


def _score_in_chunks(vectors: DataFrame, registry: DataFrame, prints: int, embedding: str,
                     best_only: bool) -> DataFrame:
    """For registries too large to send everywhere.

    The registry is hashed by agent into chunks, the vectors into salted slices; each (chunk,
    slice) pair meets in one task as a matrix product and only per-agent maxima leave it.
    """
    chunks = max(1, math.ceil(prints / CHUNK_PRINTS))
    slices = max(1, math.ceil(vectors.count() / SALT_ROWS))
    columns = [F.col(c) for c in vectors.columns]
    copies = vectors.groupBy(*columns).agg(F.count("*").alias("__copies"))
    left = (
        copies.withColumn("__slice", F.pmod(F.xxhash64(*columns), F.lit(slices)))
        .withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    )
    right = (
        registry.select("agent_slug", "embedding")
        .withColumn("__chunk", F.pmod(F.hash("agent_slug"), F.lit(chunks)))
        .withColumn("__slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)).cast("array<bigint>")))
    )
    schema = _scored_schema(copies)
    arrow = to_arrow_schema(schema)

    def score(vecs: pa.Table, prints_: pa.Table) -> pa.Table:
        packed = PackedRegistry(
            zip(prints_.column("agent_slug").to_pylist(), prints_.column("embedding").to_pylist())
        )
        scores = _score_batch(packed, vecs.column(embedding), best_only)
        keep = [vecs.column(c) for c in schema.names[:-1]]
        return pa.table(keep + [scores.cast(arrow.field("scores").type)], names=arrow.names)

    parts = (
        left.groupBy("__chunk", "__slice")
        .cogroup(right.groupBy("__chunk", "__slice"))
        .applyInArrow(score, schema)
    )
    # one row per (vector, chunk): the concatenation holds at most one entry per agent or chunk
    merged = parts.groupBy(*columns, "__copies").agg(
        F.flatten(F.collect_list(F.coalesce("scores", F.array().cast(_SCORES)))).alias("scores")
    )
    ordered = F.sort_array("scores")
    return (
        merged.withColumn("scores", F.when(F.size("scores") > 0, ordered))
        .withColumn("__copies", F.explode(F.array_repeat(F.lit(1), F.col("__copies").cast("int"))))
        .select(*vectors.columns, "scores")
    )


def score_vectors(
    vectors: DataFrame,
    registry: DataFrame,
    embedding: str = "embedding",
    best_only: bool = False,
    registry_bytes: int = REGISTRY_BYTES,
) -> DataFrame:
    """Add ``scores``: one (agent_slug, sim) per agent of the vector's dimension, in slug order.

    ``registry`` has ``agent_slug`` and ``embedding``. Its size is read first: up to
    ``registry_bytes`` it is packed once and sent to every executor, beyond that it is shuffled
    in chunks. ``best_only`` keeps just the best entry (per chunk for large registries; use
    :func:`best_match`).
    """
    sized = materialize(registry.select("agent_slug", "embedding").where(F.col("embedding").isNotNull()))
    prints, numbers = sized.agg(
        F.count("*"), F.coalesce(F.sum(F.size("embedding")), F.lit(0))
    ).first()
    if prints == 0:
        return vectors.withColumn("scores", F.lit(None).cast(_SCORES))
    if numbers * 8 <= registry_bytes:
        packed = PackedRegistry((r.agent_slug, r.embedding) for r in sized.collect())
        return _score_with(vectors, packed, embedding, best_only)
    return _score_in_chunks(vectors, sized, prints, embedding, best_only)


def best_match(
    vectors: DataFrame,
    registry: DataFrame,
    threshold: float | None = None,
    embedding: str = "embedding",
    registry_bytes: int = REGISTRY_BYTES,
) -> DataFrame:
    """Best agent and cosine per vector; ``identity`` is ``Customer`` below the threshold.

    Ties go to the first slug. Vectors that cannot be compared get null.
    """
    scored = score_vectors(vectors, registry, embedding, True, registry_bytes)
    best = F.aggregate(
        F.col("scores"),
        F.struct(F.lit(None).cast("string").alias("agent_slug"), F.lit(None).cast("double").alias("sim")),
        lambda acc, x: F.when(acc["sim"].isNull() | (x["sim"] > acc["sim"]), x).otherwise(acc),
    )
    out = scored.withColumn("__best", best).select(
        *vectors.columns,
        F.col("__best.agent_slug").alias("best_match"),
        F.col("__best.sim").alias("best_sim"),
    )
    if threshold is None:
        return out
    return out.withColumn(
        "identity",
        F.when(F.col("best_sim") >= threshold, F.col("best_match")).otherwise("Customer"),
    )


def agent_scores(vectors: DataFrame, registry: DataFrame, embedding: str = "embedding",
                 registry_bytes: int = REGISTRY_BYTES) -> DataFrame:
    """Long form: one row per vector and agent."""
    return (
        score_vectors(vectors, registry, embedding, False, registry_bytes)
        .withColumn("__score", F.explode("scores"))
        .select(*vectors.columns, "__score.agent_slug", "__score.sim")
    )
