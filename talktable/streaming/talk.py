"""Segments and vectors that arrive over time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.matching import REGISTRY_BYTES, best_match


def stream_talk_time(segments: DataFrame, window: str = "10 minutes", late: str | None = "5 minutes") -> DataFrame:
    """Agent and customer seconds per call and tumbling window of ``arrived_at``.

    Segments later than ``late`` are dropped. The same plan runs on a batch table.
    """
    length = F.col("end_s") - F.col("start_s")
    agent = F.col("identified_speaker") == "AGENT"
    timed = segments.withWatermark("arrived_at", late) if late and segments.isStreaming else segments
    return (
        timed.groupBy(F.window("arrived_at", window).alias("w"), "call_id")
        .agg(
            F.sum(F.when(agent, length).otherwise(0.0)).alias("agent_s"),
            F.sum(F.when(~agent, length).otherwise(0.0)).alias("customer_s"),
            F.count("*").alias("turns"),
        )
        .select(F.col("w.start").alias("window_start"), "call_id", "agent_s", "customer_s", "turns")
    )


def identify_batches(vectors: DataFrame, registry: DataFrame, threshold: float, sink: Callable[[DataFrame, int], None],
                     registry_bytes: int = REGISTRY_BYTES) -> DataStreamWriter:
    """Writer of a stream that gives ``sink`` each micro-batch matched, whatever the registry's size.

    A micro-batch is a table, so a large registry meets it in chunks as it meets any other table. ``sink`` gets
    the batch's number and may get a batch again after a failure.
    """
    def match(batch: DataFrame, number: int) -> None:
        sink(best_match(batch, registry, threshold, registry_bytes=registry_bytes), number)

    return vectors.writeStream.foreachBatch(match)


def stream_identify(vectors: DataFrame, registry: DataFrame, threshold: float,
                    registry_bytes: int = REGISTRY_BYTES) -> DataFrame:
    """Arriving vectors against a static registry that every executor holds; for others see ``identify_batches``."""
    return best_match(vectors, registry, threshold, registry_bytes=registry_bytes)
