"""Evaluation of whole registries on held-out calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.evaluate import (
    THRESHOLDS,
    call_evaluation,
    head_to_head,
    held_out,
    summarise_calls,
    threshold_sweep,
)
from ..operators.frames import estimate_snr
from ..functions.vectors import snr_bucket
from ..operators.matching import best_match
from ..storage import materialize


def score_phrases(calls: DataFrame, phrases: DataFrame, registry: DataFrame) -> DataFrame:
    """Phrases of the calls with best agent and similarity, written out once for all reports.

    ``phrases``: ``call_id, seg_idx, is_agent, embedding``.
    """
    rows = phrases.join(calls.select("call_id", F.col("agent_slug").alias("expected_slug")), "call_id")
    return materialize(best_match(rows, registry).drop("embedding"))


def evaluate_registries(
    calls: DataFrame,
    enrolled: DataFrame,
    phrases: DataFrame,
    frames: DataFrame,
    first: DataFrame,
    second: DataFrame,
    threshold: float,
    thresholds: list[float] = THRESHOLDS,
    limit: int | None = None,
    least_phrases: int = 3,
) -> dict[str, DataFrame]:
    """Two registries on the same held-out calls: per call, summary, sweep and head to head."""
    agents = first.select("agent_slug").distinct()
    held = materialize(held_out(calls, enrolled, agents, least_phrases, limit))
    level = materialize(
        estimate_snr(frames.join(held.select("call_id"), "call_id", "left_semi"))
        .select("call_id", F.round("snr_db", 1).alias("snr_db"), snr_bucket(F.col("snr_db")).alias("bucket"))
    )
    out = {}
    for name, registry in (("first", first), ("second", second)):
        scored = score_phrases(held, phrases, registry)
        per_call = call_evaluation(scored, threshold).join(level, "call_id", "left")
        out[f"{name}_calls"] = per_call
        out[f"{name}_summary"] = summarise_calls(per_call, [[], ["bucket"], ["expected_slug"]])
        out[f"{name}_sweep"] = threshold_sweep(scored, thresholds)
    out["head_to_head"] = head_to_head(out["first_calls"], out["second_calls"])
    return out


def eval_report(sections: dict[str, DataFrame]) -> DataFrame:
    """One JSON line per row of every result table, labelled with its section."""
    out = None
    for name, table in sections.items():
        rows = table.select(F.lit(name).alias("section"), F.to_json(F.struct(*table.columns)).alias("body"))
        out = rows if out is None else out.unionByName(rows)
    return out
