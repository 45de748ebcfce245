"""Desk recordings: which agent is speaking, and for what share of the time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.frames import speech_windows
from ..operators.matching import best_match
from ..operators.topk import top_fraction_mean
from ..storage import materialize


def rank_winners(best: DataFrame, by: str = "call_id", most: int = 3) -> DataFrame:
    """Agents by the top mean over the windows they won (``by, agent_slug, sim``).

    Adds each agent's share of the windows. There is one row per agent and recording before the
    ranks are taken.
    """
    top = top_fraction_mean(best, [by, "agent_slug"], "sim", 0.30, 3)
    total = F.sum("n").over(Window.partitionBy(by))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(F.round("top_mean", 6)), "agent_slug"))
    return (
        top.withColumn("share", F.col("n") / total).withColumn("rank", rank.cast("bigint"))
        .where(F.col("rank") <= most)
    )


def desk_report(frames: DataFrame, windows: DataFrame, registry: DataFrame, threshold: float,
                low: float = 0.20, high: float = 0.80, **grid) -> DataFrame:
    """Per recording the identified agent, its share of agent windows and whether that is plausible.

    ``windows`` has ``call_id, win_idx, embedding``; only windows that ``frames`` call speech count.
    """
    speech = speech_windows(frames, **grid).where("is_speech").select("call_id", "win_idx")
    scored = materialize(
        best_match(windows.join(speech, ["call_id", "win_idx"], "left_semi"), registry)
        .where(F.col("best_sim").isNotNull())
        .select("call_id", "win_idx", F.col("best_match").alias("agent_slug"), F.round("best_sim", 3).alias("sim"))
    )
    first = rank_winners(scored, most=1).select("call_id", F.col("agent_slug").alias("identified_slug"), "top_mean")
    hit = (F.col("agent_slug") == F.col("identified_slug")) & (F.col("sim") >= threshold)
    return (
        scored.join(first, "call_id")
        .groupBy("call_id", "identified_slug")
        .agg(
            F.max("top_mean").alias("score"), F.count("*").alias("n_speech_windows"),
            F.avg(hit.cast("double")).alias("share"),
        )
        .select(
            "call_id", "identified_slug", F.round("score", 3).alias("score"), "n_speech_windows",
            F.round("share", 3).alias("agent_time_share"), (~F.col("share").between(low, high)).alias("flagged"),
        )
    )
