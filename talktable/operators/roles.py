"""Who is agent and who is customer: talk time, votes, fallbacks, display roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import phrases
from ..functions.text import keyword_hits
from ..functions.times import clean_agent_name
from .ordered import cut_keys, key_sum, running_sum, scan, sum_before
from .vectors import centroids

def _length() -> Column:
    return F.col("end_s") - F.col("start_s")



def speaker_stats(segments: DataFrame) -> DataFrame:
    """Turns and seconds per display speaker of a call."""
    return segments.groupBy("call_id", "display_speaker").agg(
        F.count("*").alias("turns"), F.sum(_length()).alias("seconds")
    )


def role_totals(segments: DataFrame, first_chars: int = 120) -> DataFrame:
    """AGENT and CUSTOMER totals of a call with the first words each of them said."""
    role = F.when(F.col("identified_speaker") == "AGENT", "AGENT").otherwise("CUSTOMER")
    named = F.col("identified_speaker").isin("AGENT", "CUSTOMER")
    first = F.min_by(F.trim("text"), F.when(named, F.col("seg_idx")))
    return segments.groupBy("call_id", role.alias("role")).agg(
        F.round(F.sum(_length()), 1).alias("time_s"),
        F.count("*").alias("turns"),
        F.substring(F.coalesce(first, F.lit("")), 1, first_chars).alias("first_words"),
    )


def talk_ratio(segments: DataFrame) -> DataFrame:
    """Agent and customer seconds, turns and the agent's share of the spoken time."""
    agent = F.col("identified_speaker") == "AGENT"
    seconds = lambda cond: F.sum(F.when(cond, _length()).otherwise(0.0))
    return (
        segments.groupBy("call_id")
        .agg(
            seconds(agent).alias("agent_s"),
            seconds(~agent).alias("customer_s"),
            F.sum(agent.cast("bigint")).alias("agent_turns"),
            F.sum((~agent).cast("bigint")).alias("customer_turns"),
        )
        .withColumn(
            "agent_share",
            F.when(F.col("agent_s") + F.col("customer_s") > 0,
                   F.col("agent_s") / (F.col("agent_s") + F.col("customer_s"))).otherwise(0.0),
        )
    )


def majority_identity(matched: DataFrame) -> DataFrame:
    """Per diarized label the identity with the highest summed confidence.

    ``matched`` has ``call_id, seg_idx, speaker, identity, confidence``; every segment gets the
    winner and its mean confidence.
    """
    votes = matched.groupBy("call_id", "speaker", "identity").agg(
        F.sum("confidence").alias("total"), F.count("*").alias("n"), F.min("seg_idx").alias("first_idx")
    )
    rank = F.struct(F.round("total", 9), -F.col("first_idx"))
    winners = votes.groupBy("call_id", "speaker").agg(
        F.max_by("identity", rank).alias("identified_speaker"),
        F.round(F.max_by(F.col("total") / F.col("n"), rank), 4).alias("confidence"),
    )
    rest = [c for c in matched.columns if c not in ("identity", "confidence")]
    return matched.select(*rest).join(winners, ["call_id", "speaker"])


def dominant_speaker(segments: DataFrame) -> DataFrame:
    """Speaker with most seconds per call, with the share of the call's time."""
    per = segments.where(F.col("speaker").isNotNull()).groupBy("call_id", "speaker").agg(
        F.sum(_length()).alias("seconds"), F.min("seg_idx").alias("first_idx")
    )
    rank = F.struct(F.round("seconds", 9), -F.col("first_idx"))
    return per.groupBy("call_id").agg(
        F.max_by("speaker", rank).alias("speaker"),
        F.max("seconds").alias("seconds"),
        F.sum("seconds").alias("total_s"),
    )


def keyword_role(segments: DataFrame, agent_words: list[str] = phrases.AGENT_KEYWORDS,
                 customer_words: list[str] = phrases.CUSTOMER_KEYWORDS) -> DataFrame:
    """Agent speaker from phrases: +2 per agent phrase, -1 per customer phrase.

    The best speaker needs at least 2 points and 1 more than the other speaker, which is the
    first other one with any hit.
    """
    a, c = keyword_hits(F.col("text"), agent_words), keyword_hits(F.col("text"), customer_words)
    scores = (
        segments.where(F.coalesce(F.col("speaker"), F.lit("")) != "")
        .select("call_id", "seg_idx", "speaker", a.alias("a"), c.alias("c"))
        .where((F.col("a") > 0) | (F.col("c") > 0))
        .groupBy("call_id", "speaker")
        .agg(F.sum(2 * F.col("a") - F.col("c")).alias("score"), F.min("seg_idx").alias("first_idx"))
    )
    rank = F.struct(F.col("score"), -F.col("first_idx"))
    best = scores.groupBy("call_id").agg(
        F.max_by(F.struct("speaker", "score"), rank).alias("best")
    )
    others = (
        scores.join(best, "call_id")
        .where(F.col("speaker") != F.col("best.speaker"))
        .groupBy("call_id")
        .agg(F.min_by("score", "first_idx").alias("other"))
    )
    margin = F.col("score") - F.coalesce(F.col("other"), F.lit(0))
    return (
        best.select("call_id", "best.speaker", "best.score")
        .join(others, "call_id", "left")
        .where((F.col("score") >= 2) & (margin >= 1))
        .select("call_id", "speaker", "score", margin.alias("margin"))
    )


def speaker_centroids(segments: DataFrame, least_s: float = 0.5, enough_s: float = 10.0,
                      count_unembedded: bool = False) -> DataFrame:
    """Mean unit vector per speaker from its first segments, until ``enough_s`` are collected.

    The segment that reaches the limit still counts. With ``count_unembedded`` segments without a
    vector use up the time as well.
    """
    usable = segments.where(F.col("speaker").isNotNull() & (_length() >= least_s))
    if not count_unembedded:
        usable = usable.where(F.col("embedding").isNotNull())
    spent = scan(
        usable, ["call_id", "speaker"], ["seg_idx"], {"__spent": sum_before(_length())},
        cut_keys(usable, ["call_id", "speaker"], "seg_idx"),
    )
    return centroids(spent.where(F.col("__spent") < enough_s), ["call_id", "speaker"])


def weighted_identity(speaker_scores: DataFrame, shares: DataFrame, fallback: DataFrame,
                      threshold: float = 0.25) -> DataFrame:
    """Best speaker × agent pair per call by ``sim · (0.7 + 0.3 · time share)``.

    ``speaker_scores`` has ``call_id, speaker, agent_slug, sim``, ``shares`` has ``call_id,
    speaker, share``. The threshold tests the raw similarity; below it the ``fallback``
    (call_id, speaker) speaker is returned as an unknown agent.
    """
    weighted = F.col("sim") * (0.7 + 0.3 * F.coalesce(F.col("share"), F.lit(0.0)))
    pairs = speaker_scores.join(shares, ["call_id", "speaker"], "left").withColumn("weighted", weighted)
    # ties: the first agent, then the first speaker
    order = F.struct(F.col("weighted") * -1, F.col("agent_slug"), F.col("speaker"))
    best = pairs.groupBy("call_id").agg(
        F.min_by(F.struct("speaker", "agent_slug", "sim"), order).alias("b")
    )
    ok = F.coalesce(F.col("b.sim") >= threshold, F.lit(False))
    return (
        fallback.select("call_id", F.col("speaker").alias("__dominant"))
        .join(best, "call_id", "full")
        .select(
            "call_id",
            F.when(ok, F.col("b.speaker")).otherwise(F.col("__dominant")).alias("speaker"),
            F.when(ok, F.col("b.agent_slug")).otherwise("Unknown Agent").alias("agent"),
            F.coalesce(F.col("b.sim"), F.lit(-2.0)).alias("sim"),
        )
    )


def agent_speaker(segments: DataFrame, regions: DataFrame | None = None,
                  enrolled: DataFrame | None = None, least_sim: float = 0.25) -> DataFrame:
    """Agent speaker of a call: region vote, else enrolled match above ``least_sim``, else
    phrases, else most speaking time. ``enrolled`` has ``call_id, speaker, sim``.
    """
    from .intervals import region_vote

    steps = []
    if regions is not None:
        steps.append(("regions", region_vote(segments, regions).select("call_id", "speaker")))
    if enrolled is not None:
        best = enrolled.groupBy("call_id").agg(
            F.max_by(F.struct("speaker", "sim"), F.struct(F.col("sim"), F.col("speaker"))).alias("b")
        ).where(F.col("b.sim") > least_sim)
        steps.append(("voiceprint", best.select("call_id", "b.speaker")))
    steps.append(("keywords", keyword_role(segments).select("call_id", "speaker")))
    steps.append(("talk_time", dominant_speaker(segments).select("call_id", "speaker")))
    out = segments.select("call_id").distinct()
    for i, (_, found) in enumerate(steps):
        out = out.join(found.withColumnRenamed("speaker", f"s{i}"), "call_id", "left")
    method = F.coalesce(*[F.when(F.col(f"s{i}").isNotNull(), F.lit(n)) for i, (n, _) in enumerate(steps)])
    return out.select(
        "call_id",
        F.coalesce(*[F.col(f"s{i}") for i in range(len(steps))], F.lit("SPEAKER_00")).alias("speaker"),
        F.coalesce(method, F.lit("none")).alias("method"),
    )


def call_summary(segments: DataFrame) -> DataFrame:
    """Distinct speakers, duration and mean confidence of a call."""
    return segments.groupBy("call_id").agg(
        F.count_distinct("speaker").alias("speakers"),
        F.round(F.max("end_s"), 2).alias("duration_s"),
        F.round(F.avg("confidence"), 4).alias("avg_confidence"),
    )


def swap_roles(segments: DataFrame, requests: DataFrame) -> DataFrame:
    """AGENT and CUSTOMER exchanged in the requested calls (call_id, agent_label)."""
    role, asked = F.col("identified_speaker"), F.col("__asked").isNotNull()
    swapped = F.when(role == "AGENT", "CUSTOMER").when(role == "CUSTOMER", "AGENT").otherwise(role)
    name = F.coalesce(F.nullif(F.col("agent_name"), F.lit("")), F.col("__label"), F.lit("Agent"))
    marked = segments.join(
        requests.select("call_id", F.col("agent_label").alias("__label"), F.lit(True).alias("__asked")),
        "call_id", "left",
    )
    rest = [c for c in segments.columns if c not in ("identified_speaker", "agent_name", "display_speaker")]
    return marked.select(
        *rest,
        F.when(asked, swapped).otherwise(role).alias("identified_speaker"),
        F.when(asked & (role == "CUSTOMER"), name).when(asked & (role == "AGENT"), F.lit(None))
        .otherwise(F.col("agent_name")).alias("agent_name"),
        F.when(asked & (role == "CUSTOMER"), name).when(asked & (role == "AGENT"), F.lit("Customer"))
        .otherwise(F.col("display_speaker")).alias("display_speaker"),
    )


def swap_stats(stats: DataFrame, requests: DataFrame) -> DataFrame:
    """Role totals (``call_id, role, …, roles_swapped``) after the same exchange."""
    asked = F.col("__asked").isNotNull()
    role = F.col("role")
    swapped = F.when(role == "AGENT", "CUSTOMER").when(role == "CUSTOMER", "AGENT").otherwise(role)
    marked = stats.join(requests.select("call_id", F.lit(True).alias("__asked")), "call_id", "left")
    return marked.withColumn("role", F.when(asked, swapped).otherwise(role)).withColumn(
        "roles_swapped", F.when(asked, ~F.col("roles_swapped")).otherwise(F.col("roles_swapped"))
    ).drop("__asked")


def _label(segments: DataFrame) -> Column:
    named = F.nullif(F.col("speaker"), F.lit(""))
    return F.coalesce(named, F.concat(F.lit("SPEAKER_"), F.lpad(F.col("seg_idx").cast("string"), 2, "0")))


def label_roles(segments: DataFrame, threshold: float = 0.25) -> DataFrame:
    """One row per diarized label: its role, key and display name.

    Of several labels on one agent the strongest (confidence, then score, time, earliest) stays
    agent; the rest are customers, numbered by first start.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    label = _label(segments)
    said = F.coalesce(F.nullif(F.col("identified_speaker"), F.lit("")), label)
    is_agent = F.upper(said) == "AGENT"
    confidence = F.when(
        is_agent & (zero("confidence") <= 0), F.greatest(zero("best_sim"), F.lit(1.0))
    ).otherwise(zero("confidence"))
    identity = F.when(F.startswith(F.lower(said), F.lit("agent_")), said).when(
        is_agent,
        F.coalesce(F.nullif(F.col("agent_name"), F.lit("")),
                   F.nullif(F.col("display_speaker"), F.lit("")), F.lit("Agent")),
    )
    length = F.greatest(F.lit(0.0), _length())
    per_identity = (
        segments.select("call_id", "seg_idx", "start_s", label.alias("label"), identity.alias("agent"),
                        confidence.alias("conf"), length.alias("len"))
        .groupBy("call_id", "label", "agent")
        .agg(
            F.min("start_s").alias("first_start_s"),
            F.sum("len").alias("seconds"),
            F.sum(F.greatest(F.col("conf"), F.lit(0.0)) * F.greatest(F.col("len"), F.lit(1.0))).alias("score"),
            F.max("conf").alias("conf"),
            F.min("seg_idx").alias("first_idx"),
        )
    )
    known = F.col("agent").isNotNull()
    strength = F.when(known, F.struct(F.col("conf"), F.round("score", 9), -F.col("first_idx")))
    labels = per_identity.groupBy("call_id", "label").agg(
        F.min("first_start_s").alias("first_start_s"),
        F.sum("seconds").alias("seconds"),
        F.max_by(F.struct("agent", "conf", "score"), strength).alias("best"),
        F.min("first_idx").alias("first_idx"),
    )
    rank = F.struct(
        F.col("best.conf"), F.round("best.score", 9), F.round("seconds", 9), -F.col("first_start_s"),
        -F.col("first_idx"),
    )
    winners = (
        labels.where(F.col("best.agent").isNotNull())
        .groupBy("call_id", F.col("best.agent").alias("agent"))
        .agg(F.max_by(F.struct("label", F.col("best.conf").alias("conf")), rank).alias("w"))
        .where(F.col("w.conf") >= threshold)
        .select("call_id", "agent", F.col("w.label").alias("label"))
    )
    overall = F.struct(
        F.coalesce(F.col("best.conf"), F.lit(0.0)), F.round("seconds", 9), -F.col("first_start_s"),
        -F.col("first_idx"),
    )
    # a call with one label keeps its only agent candidate whatever the confidence
    lone = (
        labels.groupBy("call_id")
        .agg(F.count("*").alias("n"), F.max_by(F.struct("label", F.col("best.agent").alias("agent")), overall).alias("w"))
        .where((F.col("n") == 1) & F.col("w.agent").isNotNull())
        .join(winners.select("call_id").distinct(), "call_id", "left_anti")
        .select("call_id", "w.agent", "w.label")
    )
    agents = winners.unionByName(lone).withColumnRenamed("agent", "won")
    one = F.lit(1).cast("bigint")
    sides = labels.join(agents, ["call_id", "label"], "left").withColumn("customer", F.col("won").isNull())
    roles = scan(
        sides,
        ["call_id", "customer"],
        ["first_start_s", "label"],
        {"nth": running_sum(one), "of": key_sum(one)},
        cut_keys(labels, ["call_id"], "first_start_s"),
    )
    customers, nth = F.col("customer"), F.col("nth").cast("string")
    many = F.col("of") > 1
    clean = clean_agent_name(F.col("won"))
    customer_name = F.when(many, F.concat(F.lit("Customer "), nth)).otherwise("Customer")
    return roles.select(
        "call_id", "label",
        F.when(customers, "Customer").otherwise("Agent").alias("role"),
        F.when(customers, F.concat(F.lit("customer_"), nth)).otherwise(F.col("won")).alias("speaker_key"),
        F.when(customers, customer_name).otherwise(clean).alias("speaker_name"),
        F.when(customers, customer_name).otherwise(F.concat(F.lit("Agent ("), clean, F.lit(")"))).alias("display_speaker"),
    )


def conversation_view(segments: DataFrame, threshold: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """Segments with display roles, and one row per speaker of a call with its whole text."""
    roles = label_roles(segments, threshold)
    own = F.coalesce(F.nullif(F.col("speaker"), F.lit("")), F.lit("Unknown"))
    plain = segments.select(
        "call_id", "seg_idx", "start_s", "end_s", F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce(F.nullif(F.col("identified_speaker"), F.lit("")), own).alias("identified_speaker"),
        own.alias("label"),
    )
    unnamed = {"role": "Customer", "speaker_key": "customer_1", "speaker_name": "Customer",
               "display_speaker": "Customer"}
    rows = plain.join(roles, ["call_id", "label"], "left").fillna(unnamed)
    said = F.sort_array(
        F.collect_list(F.when(F.col("text") != "", F.struct("seg_idx", "text")))
    )
    groups = rows.groupBy("call_id", "speaker_key").agg(
        *[F.min_by(c, "seg_idx").alias(c) for c in ("role", "speaker_name", "display_speaker", "label")],
        F.count("*").alias("segment_count"),
        F.round(F.sum(F.greatest(F.lit(0.0), _length())), 2).alias("talk_time"),
        F.min("start_s").alias("first_start_s"),
        F.array_join(F.transform(said, lambda s: s["text"]), "\n").alias("text"),
    )
    return rows, groups
