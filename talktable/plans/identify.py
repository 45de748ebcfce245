"""Whole calls: find the agent, label every segment, clean the labels up, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import agent_threshold, dot, l2_normalize
from ..operators.cluster import GROUP_ROWS, choose_customer_k, cluster_first_roles
from ..operators.intervals import number_customers
from ..operators.matching import REGISTRY_BYTES, score_vectors
from ..operators.ordered import BLOCK_ROWS
from ..operators.passes import (
    LABEL,
    correct_roles,
    demote_backchannel,
    demote_zero_sim,
    fill_unlabelled,
    smooth_sandwich,
)
from ..operators.topk import top_fraction_mean
from ..operators.vectors import mean_vector
from ..storage import materialize

WINDOW_ROWS = 100_000


@dataclass(frozen=True)
class Settings:
    """Thresholds of the labelling; the defaults are the usual ones for real voiceprints."""

    threshold: float = 0.30
    margin: float = 0.05
    threshold_cap: float = 0.42
    least_matches: int = 3
    reclaim_sim: float = 0.28
    reclaim_slack: float = 0.07
    most_customers: int = 3
    gate_seconds: float = 60.0
    gate_vectors: int = 15
    gate_share: float = 0.55
    floor: float = 0.20
    sure: float = 0.50
    likely: float = 0.42
    warn_below: float = 0.50


def rank_agents(scored: DataFrame) -> DataFrame:
    """Agents per call by the mean of their best similarities (``call_id, agent_slug, score``)."""
    long = scored.select("call_id", F.explode("scores").alias("s")).select("call_id", "s.*")
    return top_fraction_mean(long, ["call_id", "agent_slug"], "sim", 0.30, 5).select(
        "call_id", "agent_slug", F.col("top_mean").alias("score"), "n", "k"
    )


def choose_dimension(segments: DataFrame, registry: DataFrame, registry_bytes: int = REGISTRY_BYTES) -> DataFrame:
    """(call_id, agent_slug, matched_dim, score): the best agent of each call over vectors of several dimensions.

    ``embeddings`` of a segment maps a dimension to its vector of that length; null, missing and wrongly long ones do not
    count. An agent is scored on the segments that have a vector of its voiceprints' dimension, so the dimension of the best agent is
    the call's. Ties go to the first slug, then to the smaller dimension. Calls without any comparable vector get no row.
    """
    vectors = segments.select("call_id", "seg_idx", F.explode("embeddings").alias("matched_dim", "embedding")).where(
        F.col("embedding").isNotNull() & (F.size("embedding") == F.col("matched_dim"))
    )
    scored = score_vectors(vectors, registry, registry_bytes=registry_bytes)
    long = scored.select("call_id", "matched_dim", F.explode("scores").alias("s")).select("call_id", "matched_dim", "s.*")
    ranked = top_fraction_mean(long, ["call_id", "agent_slug", "matched_dim"], "sim", 0.30, 5)
    order = F.struct(F.round("top_mean", 9) * -1, "agent_slug", "matched_dim")
    best = F.min_by(F.struct("agent_slug", "matched_dim", F.col("top_mean").alias("score")), order).alias("b")
    return ranked.groupBy("call_id").agg(best).select("call_id", "b.*")


def soft_reclaim(unmatched: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Add ``reclaimed``: unmatched rows close enough to the agent after all.

    Needs ``call_id, cluster, embedding, sim, agent_slug, agent_threshold``. Enough is a basic
    floor plus either being nearer the agent than the row's own customer centroid, or nearly
    reaching the threshold.
    """
    unit = l2_normalize(F.col("embedding"))
    centres = materialize(
        unmatched.groupBy("call_id", "cluster").agg(l2_normalize(mean_vector(unit)).alias("__centre"))
    )
    nearer = F.col("sim") >= dot(unit, F.col("__centre"))
    close = F.col("sim") >= F.greatest(F.col("agent_threshold") - settings.reclaim_slack, F.lit(settings.reclaim_sim))
    found = (F.col("agent_slug") != "") & (F.col("sim") >= settings.reclaim_sim) & (nearer | close)
    return unmatched.join(centres, ["call_id", "cluster"]).withColumn("reclaimed", found).drop("__centre")


def _passes(labelled: DataFrame, block_rows: int | None) -> DataFrame:
    """All label passes, in windows without ``block_rows``, else in blocks."""
    cut = (lambda df: df) if block_rows is None else materialize
    passed = cut(fill_unlabelled(labelled, block_rows=block_rows))
    passed = cut(smooth_sandwich(passed, block_rows=block_rows))
    passed = cut(demote_zero_sim(demote_backchannel(passed), block_rows=block_rows))
    return cut(correct_roles(passed, block_rows=block_rows))


def identify_calls(
    segments: DataFrame,
    registry: DataFrame,
    settings: Settings = Settings(),
    block_rows: int = BLOCK_ROWS,
    window_rows: int = WINDOW_ROWS,
    group_rows: int = GROUP_ROWS,
    registry_bytes: int = REGISTRY_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """Label segments and summarise calls.

    ``segments``: ``call_id, seg_idx`` (from 0 without gaps), ``start_s, end_s, text, embedding``
    (null where there is none). ``registry``: ``agent_slug, agent_name, embedding,
    max_outside_sim``. Returns the labelled segments and one row per call. Instead of ``embedding`` segments may have
    ``embeddings``, a map from dimension to vector: the dimension of the best agent decides for the whole call.

    Stages that more than one later stage needs are written out once. The label passes use plain
    windows for calls of up to ``window_rows`` segments; longer calls run on blocks of
    ``block_rows`` and are written out between passes. Each call is decided by its own length.
    """
    s = settings
    matched = None
    if "embeddings" in segments.columns:
        matched = materialize(choose_dimension(segments, registry, registry_bytes).select("call_id", "matched_dim"))
        own = F.try_element_at("embeddings", F.col("matched_dim"))
        segments = segments.drop("embedding").join(matched, "call_id", "left").withColumn(
            "embedding", F.when(F.size(own) == F.col("matched_dim"), own)
        ).drop("embeddings", "matched_dim")
    scored = materialize(
        score_vectors(segments.select("call_id", "seg_idx", "embedding"), registry, registry_bytes=registry_bytes)
        .select("call_id", "seg_idx", F.when(F.col("embedding").isNotNull(), F.col("scores")).alias("scores"))
    )
    order = F.struct(F.round("score", 9) * -1, F.col("agent_slug"))
    best = rank_agents(scored).groupBy("call_id").agg(F.min_by("agent_slug", order).alias("top_slug"))
    people = registry.groupBy("agent_slug").agg(
        F.min("agent_name").alias("top_name"), F.max("max_outside_sim").alias("max_outside")
    )
    top = best.join(people.withColumnRenamed("agent_slug", "top_slug"), "top_slug").withColumn(
        "agent_threshold", agent_threshold(s.threshold, F.col("max_outside"), s.margin, s.threshold_cap)
    )
    own = F.get(F.transform(F.filter("scores", lambda x: x["agent_slug"] == F.col("top_slug")), lambda x: x["sim"]), F.lit(0))
    rows = (
        segments.join(scored, ["call_id", "seg_idx"])
        .join(top.select("call_id", "top_slug", "top_name", "agent_threshold"), "call_id", "left")
        .withColumn("sim", F.coalesce(own, F.lit(0.0)))
        .withColumn("valid", F.col("scores").isNotNull())
        .withColumn("hit", F.coalesce(F.col("valid") & (F.col("sim") >= F.col("agent_threshold")), F.lit(False)))
        .drop("scores")
    )
    rows = materialize(rows)
    hits = rows.groupBy("call_id").agg(F.sum(F.col("hit").cast("bigint")).alias("hits"))
    named = F.col("hits") >= s.least_matches
    rows = (
        rows.join(hits, "call_id")
        .withColumn("agent_slug", F.when(named, F.col("top_slug")).otherwise(""))
        .withColumn("call_agent", F.when(named, F.col("top_name")).otherwise("Unknown Agent"))
        .withColumn("hit", F.col("hit") & named)
    )

    customers = materialize(
        choose_customer_k(
            rows.where(~F.col("hit") & F.col("valid")).select(
                "call_id", "seg_idx", "start_s", "embedding", "sim", "agent_slug", "agent_threshold"
            ),
            ["call_id"], "seg_idx", s.most_customers, group_rows,
        )
    )
    first = customers.groupBy("call_id", "cluster").agg(F.min_by("start_s", "seg_idx").alias("start_s"))
    names = number_customers(first).select(
        "call_id", "cluster", F.col("display_speaker").alias("c_display"), F.col("speaker").alias("c_speaker")
    )
    reclaimed = soft_reclaim(customers, s).join(names, ["call_id", "cluster"]).select(
        "call_id", "seg_idx", "reclaimed", "c_display", "c_speaker"
    )
    agent = F.col("hit") | F.coalesce(F.col("reclaimed"), F.lit(False))
    base = rows.join(reclaimed, ["call_id", "seg_idx"], "left").select(
        "call_id", "seg_idx", "start_s", "end_s", "text", "embedding", "sim", "valid", "agent_slug",
        "call_agent", "agent_threshold", "hit",
        F.when(agent, "SPEAKER_00").otherwise(F.col("c_speaker")).alias("speaker"),
        F.when(agent, "AGENT").otherwise("CUSTOMER").alias("role"),
        F.when(agent, F.col("call_agent")).otherwise(F.col("c_display")).alias("display"),
        F.when(agent, F.col("call_agent")).alias("agent_name"),
    )
    base = materialize(base)

    length = F.greatest(F.lit(0.0), F.col("end_s") - F.col("start_s"))
    calls = materialize(
        base.groupBy("call_id").agg(
            F.sum(length).alias("total_s"),
            F.sum(F.when(F.col("role") == "AGENT", length).otherwise(0.0)).alias("agent_s"),
            F.sum(F.col("valid").cast("bigint")).alias("n_valid"),
            F.count("*").alias("n_segments"),
            F.max("agent_slug").alias("agent_slug"),
            F.max("call_agent").alias("call_agent"),
            F.max("agent_threshold").alias("agent_threshold"),
            F.avg(F.when(F.col("hit"), F.col("sim"))).alias("hit_sim"),
            F.sum(F.col("hit").cast("bigint")).alias("n_matches"),
            F.max(F.size("embedding")).alias("dim"),
        )
    )
    gated = calls.where(
        (F.col("agent_slug") != "")
        & (F.col("total_s") >= s.gate_seconds)
        & (F.col("n_valid") >= s.gate_vectors)
        & (F.col("agent_s") / F.greatest(F.col("total_s"), F.lit(1e-6)) >= s.gate_share)
    ).select("call_id")
    labelled = base.drop("hit")
    if gated.isEmpty():
        clustered = None
        calls = calls.withColumn("speaker_mode", F.lit("per_segment_similarity"))
    else:
        gated = materialize(gated)
        roles = cluster_first_roles(
            base.join(gated, "call_id", "left_semi"), s.floor, 0.05, s.sure, s.likely, group_rows
        ).select("call_id", "seg_idx", "is_agent")
        is_agent = F.col("is_agent")
        clustered = materialize(
            base.join(gated, "call_id", "left_semi").drop("hit").join(roles, ["call_id", "seg_idx"])
            .withColumn("speaker", F.when(is_agent, "SPEAKER_00").otherwise("SPEAKER_01"))
            .withColumn("role", F.when(is_agent, "AGENT").otherwise("CUSTOMER"))
            .withColumn("display", F.when(is_agent, F.col("call_agent")).otherwise("Customer 1"))
            .withColumn("agent_name", F.when(is_agent, F.col("call_agent")))
        )
        labelled = labelled.join(gated, "call_id", "left_anti").unionByName(clustered.drop("is_agent"))
        sims = clustered.groupBy("call_id").agg(
            F.coalesce(F.avg(F.when(F.col("is_agent"), F.col("sim"))), F.lit(0.0)).alias("cluster_sim")
        )
        mode = F.when(F.col("cluster_sim").isNotNull(), "cluster_first_voiceprint").otherwise("per_segment_similarity")
        calls = calls.join(sims, "call_id", "left").withColumn("speaker_mode", mode).withColumn(
            "hit_sim", F.coalesce("cluster_sim", "hit_sim")
        )

    labelled = labelled.select("call_id", "seg_idx", "start_s", "end_s", "text", "sim", "call_agent", *LABEL)
    long = materialize(calls.where(F.col("n_segments") > window_rows).select("call_id"))
    if long.isEmpty():
        passed = _passes(labelled, None)
    else:
        passed = _passes(labelled.join(long, "call_id", "left_anti"), None).unionByName(
            _passes(labelled.join(long, "call_id", "left_semi"), block_rows)
        )

    sim = F.coalesce(F.col("hit_sim"), F.lit(0.0))
    warning = F.when(
        (F.col("agent_slug") != "") & (sim < s.warn_below),
        F.concat(
            F.lit("Low confidence identification (avg_similarity="), F.format_string("%.2f", sim),
            F.lit(f" < {s.warn_below:.2f})"),
        ),
    )
    by_speaker = passed.groupBy("call_id", "display").agg(
        F.count("*").alias("turns"), F.round(F.sum(length), 6).alias("seconds")
    )
    speakers = by_speaker.groupBy("call_id").agg(
        F.sort_array(F.collect_list(F.struct(F.col("display").alias("speaker"), "turns", "seconds"))).alias("per_speaker")
    )
    changed = passed.select("call_id", "seg_idx", "role").join(
        labelled.select("call_id", "seg_idx", F.col("role").alias("__before")), ["call_id", "seg_idx"]
    ).groupBy("call_id").agg(F.sum((F.col("role") != F.col("__before")).cast("bigint")).alias("role_corrections"))
    found = F.col("agent_slug") != ""
    summary = calls.join(speakers, "call_id").join(changed, "call_id").select(
        "call_id", "agent_slug", F.col("call_agent").alias("agent_name"),
        F.round(sim, 3).alias("agent_similarity"), "n_segments", F.size("per_speaker").cast("bigint").alias("n_speakers"), "speaker_mode",
        F.round(F.when(found, F.col("agent_threshold")).otherwise(F.lit(s.threshold)), 3).alias("threshold_used"),
        warning.alias("warning"), "n_matches", "per_speaker", "role_corrections", F.when(found, F.col("dim")).alias("matched_dim"),
    )
    return passed.drop("call_agent"), summary
