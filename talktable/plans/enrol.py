"""Enrolment: from calls with vectors to voiceprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import snr_bucket
from ..operators.cluster import GROUP_ROWS, voiceprint_centroids
from ..operators.evaluate import calls_per_agent
from ..operators.frames import clip_quality, enrolment_gate, estimate_snr
from ..operators.intervals import purity_filter
from ..operators.vectors import drop_outliers_once, tighten
from ..sources.registry import upsert_registry
from ..storage import materialize


def enrol_agents(
    calls: DataFrame,
    phrases: DataFrame,
    frames: DataFrame,
    vectors: DataFrame,
    existing: DataFrame | None = None,
    least_calls: int = 1,
    first_calls: int | None = None,
    purity_buffer_s: float | None = None,
    first: float = 0.45,
    second: float = 0.55,
    least: int = 15,
    gate: dict = {},
    most_clusters: int = 2,
    per_cluster: int = 30,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Voiceprints per agent and SNR bucket.

    ``calls``: ``call_id, agent_slug, idx``; ``phrases``: ``call_id, phrase_idx, start_s, end_s,
    is_agent``; ``frames``: ``call_id, rms``; ``vectors``: ``vec_id, call_id, embedding`` of the
    agents' speech windows. With ``purity_buffer_s`` only phrases away from any customer count.
    ``existing`` agents are left out.
    """
    chosen = calls_per_agent(calls, least_calls, first_calls)
    if existing is not None:
        chosen = chosen.join(existing.select("agent_slug").distinct(), "agent_slug", "left_anti")
    if purity_buffer_s is None:
        spoken = phrases.where("is_agent")
    else:
        spoken = purity_filter(phrases, purity_buffer_s)
    seconds = spoken.groupBy("call_id").agg(F.sum(F.col("end_s") - F.col("start_s")).alias("seconds"))
    clips = materialize(
        chosen.select("call_id", "agent_slug")
        .join(seconds, "call_id")
        .join(estimate_snr(frames).select("call_id", "snr_db"), "call_id")
        .withColumn("bucket", snr_bucket(F.col("snr_db")))
    )
    windows = vectors.where(F.col("embedding").isNotNull()).join(
        clips.select("call_id", "agent_slug", "bucket"), "call_id"
    )
    agents, buckets = enrolment_gate(windows, clips, **gate)
    buckets = materialize(buckets.join(agents.select("agent_slug", "used_calls"), "agent_slug"))
    rows, groups = tighten(
        windows.join(buckets.select("agent_slug", "bucket"), ["agent_slug", "bucket"], "left_semi")
        .select("agent_slug", "bucket", "vec_id", "embedding"),
        ["agent_slug", "bucket"], first, second, least,
    )
    groups = materialize(groups)
    # a bucket whose tightening leaves too little keeps all its rows
    loose = groups.where(F.col("n_kept") < least).select("agent_slug", "bucket", F.lit(True).alias("all"))
    kept = materialize(
        rows.join(loose, ["agent_slug", "bucket"], "left").where(F.col("keep") | F.col("all").isNotNull())
        .select("agent_slug", "bucket", "vec_id", "embedding")
    )
    prints = voiceprint_centroids(kept, ["agent_slug", "bucket"], "vec_id", most_clusters, per_cluster,
                                  group_rows=group_rows)
    return prints.join(
        groups.select("agent_slug", "bucket", "inside", F.col("outside").alias("max_outside_sim")),
        ["agent_slug", "bucket"],
    ).join(
        buckets.select("agent_slug", "bucket", "used_calls", F.round("snr_median", 1).alias("snr_db")),
        ["agent_slug", "bucket"],
    )


def update_registry(old: DataFrame, enrolled: DataFrame, source: str) -> DataFrame:
    """The registry after an enrolment: agents of ``enrolled`` (from :func:`enrol_agents`) replace all their old voiceprints.

    ``old`` has the columns of the result: ``agent_slug, path, bucket, vp_idx, n_clips, snr_db, embedding, mean_inside_sim,
    max_outside_sim, source``; of an older registry some may be missing and are null.
    """
    new = enrolled.select(
        "agent_slug", F.concat_ws("/", "agent_slug", "bucket", F.col("vp_idx").cast("string")).alias("path"), "bucket", "vp_idx", "n_clips", "snr_db",
        "embedding", F.col("inside").alias("mean_inside_sim"), "max_outside_sim", F.lit(source).alias("source"),
    )
    for field in new.schema.fields:
        if field.name not in old.columns:
            old = old.withColumn(field.name, F.lit(None).cast(field.dataType))
    return upsert_registry(old.select(*new.columns), new)


def clean_extract(clips: DataFrame, threshold: float, cohesive: float = 0.65, **limits) -> DataFrame:
    """Registry rows from single clips: quality checks, outliers dropped once, cohesion flag.

    ``clips`` has ``agent_slug, clip_id, embedding`` and what :func:`clip_quality` looks at: ``duration_s, rms_dbfs, flatness,
    snr_db``; ``limits`` are its limits. ``n_clips`` were offered, and ``reasons`` counts those that failed by reason.
    """
    checked = clips.withColumn("reason", clip_quality(F.col("duration_s"), F.col("rms_dbfs"), F.col("flatness"), F.col("snr_db"), **limits))
    groups = drop_outliers_once(checked.where(F.col("reason") == ""), ["agent_slug"], ["clip_id"], threshold)
    counts = checked.groupBy("agent_slug", "reason").agg(F.count("*").alias("n"))
    failed = F.filter(F.sort_array(F.collect_list(F.struct("reason", "n"))), lambda r: r["reason"] != "")
    offered = counts.groupBy("agent_slug").agg(F.sum("n").alias("n_clips"), failed.alias("reasons"))
    return groups.join(offered, "agent_slug").withColumn("low_cohesion", F.col("mean_cosine") < cohesive)
