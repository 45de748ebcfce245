"""Scoring predictions against truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

THRESHOLDS = [0.25, 0.30, 0.35, 0.40, 0.45, 0.50, 0.55]


def confusion_counts(truth: Column, predicted: Column) -> list[Column]:
    """Aggregates tp, fp, tn, fn."""
    count = lambda cond: F.sum(cond.cast("bigint"))
    return [
        count(truth & predicted).alias("tp"),
        count(~truth & predicted).alias("fp"),
        count(~truth & ~predicted).alias("tn"),
        count(truth & ~predicted).alias("fn"),
    ]


def with_metrics(counts: DataFrame, digits: int = 4) -> DataFrame:
    """Precision, recall, F1 and accuracy from tp, fp, tn, fn, zero denominators guarded."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    one = F.lit(1.0)
    return (
        counts.withColumn("__p", tp / F.greatest(tp + fp, one))
        .withColumn("__r", tp / F.greatest(tp + fn, one))
        .withColumn("precision", F.round("__p", digits))
        .withColumn("recall", F.round("__r", digits))
        .withColumn(
            "f1",
            F.round(2 * F.col("__p") * F.col("__r") / F.greatest(F.col("__p") + F.col("__r"), F.lit(1e-9)), digits),
        )
        .withColumn("accuracy", F.round((tp + tn) / F.greatest(tp + fp + tn + fn, one), digits))
        .drop("__p", "__r")
    )


def confusion(rows: DataFrame, by: list[str], truth: Column, predicted: Column) -> DataFrame:
    return with_metrics(rows.groupBy(*by).agg(*confusion_counts(truth, predicted)))


def _agent_rank() -> Column:
    """Order of a call's agents: mean similarity, then the one seen first."""
    return F.struct(F.col("sim_sum") / F.col("n"), -F.col("first_idx"))


def call_agents(scored: DataFrame) -> DataFrame:
    """Predicted agent per call: highest mean of the best similarities won by that agent.

    ``scored`` has ``call_id, seg_idx, best_match, best_sim``.
    """
    per_agent = scored.where(F.col("best_match").isNotNull()).groupBy("call_id", "best_match").agg(
        F.sum("best_sim").alias("sim_sum"), F.count("*").alias("n"),
        F.min("seg_idx").alias("first_idx"),
    )
    return per_agent.groupBy("call_id").agg(
        F.max_by("best_match", _agent_rank()).alias("predicted_slug"),
        F.max(F.col("sim_sum") / F.col("n")).alias("mean_sim"),
    )


def call_evaluation(scored: DataFrame, threshold: float) -> DataFrame:
    """One row per call: truth against prediction per phrase, and the identified agent.

    ``scored`` has ``call_id, seg_idx, expected_slug, is_agent, best_match, best_sim``. Everything
    is folded per (call, winning agent) first, so the scores are read once.
    """
    predicted = F.col("best_sim") >= threshold
    hit = F.col("is_agent") & predicted & (F.col("best_match") == F.col("expected_slug"))
    counted = ["tp", "fp", "tn", "fn", "agent_phrases", "agent_hits"]
    per_agent = (
        scored.where(F.col("best_sim").isNotNull())
        .groupBy("call_id", "expected_slug", "best_match")
        .agg(
            *confusion_counts(F.col("is_agent"), predicted),
            F.sum(F.col("is_agent").cast("bigint")).alias("agent_phrases"),
            F.sum(hit.cast("bigint")).alias("agent_hits"),
            F.sum("best_sim").alias("sim_sum"),
            F.count("*").alias("n"),
            F.min("seg_idx").alias("first_idx"),
        )
    )
    return (
        per_agent.groupBy("call_id", "expected_slug")
        .agg(
            *[F.sum(c).alias(c) for c in counted],
            F.max_by("best_match", _agent_rank()).alias("predicted_slug"),
        )
        .withColumn("correct_call", F.col("predicted_slug") == F.col("expected_slug"))
    )


def summarise_calls(calls: DataFrame, sets: list[list[str]]) -> DataFrame:
    """Pooled metrics overall and per grouping set of ``bucket`` / ``expected_slug`` ...

    ``level`` names the grouping set; columns outside the set are null.
    """
    names = sorted({c for s in sets for c in s})
    cols = [F.col(c) for c in names]
    level = F.concat_ws(
        ",", *[F.when(F.grouping(c) == 0, F.lit(c)) for c in names]
    )
    out = calls.groupingSets([[F.col(c) for c in s] for s in sets], *cols).agg(
        F.count("*").alias("calls"),
        F.sum(F.col("correct_call").cast("bigint")).alias("correct_calls"),
        *[F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn")],
        F.when(level == "", F.lit("overall")).otherwise(level).alias("level"),
    )
    return with_metrics(out).withColumn(
        "call_accuracy", F.round(F.col("correct_calls") / F.col("calls"), 4)
    )


def threshold_sweep(scored: DataFrame, thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """Metrics per threshold. Every phrase is scored once; phrases are first folded into a count
    per (call, truth, number of thresholds reached), which is what the thresholds multiply."""
    rows = scored.where(F.col("best_sim").isNotNull())
    cuts = sorted(thresholds)
    reached = sum(((F.col("best_sim") >= t).cast("int") for t in cuts), F.lit(0))
    folded = rows.groupBy("is_agent", reached.alias("reached")).agg(F.count("*").alias("n"))
    calls = (
        rows.select("call_id", "expected_slug").distinct()
        .join(call_agents(rows), "call_id")
        .agg(
            F.count("*").alias("calls"),
            F.avg((F.col("predicted_slug") == F.col("expected_slug")).cast("double")).alias("call_accuracy"),
        )
    )
    positive = F.col("reached") > F.col("pos")
    weigh = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(F.lit(0)))
    swept = (
        folded.withColumn(
            "__cut",
            F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(t).alias("threshold")) for i, t in enumerate(cuts)])),
        )
        .select("is_agent", "reached", "n", "__cut.pos", "__cut.threshold")
        .groupBy("threshold")
        .agg(
            weigh(F.col("is_agent") & positive).alias("tp"),
            weigh(~F.col("is_agent") & positive).alias("fp"),
            weigh(~F.col("is_agent") & ~positive).alias("tn"),
            weigh(F.col("is_agent") & ~positive).alias("fn"),
        )
    )
    # one row of call counts joined to at most len(thresholds) rows
    joined = with_metrics(swept).drop("accuracy").join(
        calls.select("calls", F.round("call_accuracy", 4).alias("accuracy")), how="cross"
    )
    # call accuracy ignores the threshold, so the first one is always its best; F1 is not flat
    few = Window.partitionBy()
    return joined.select(
        "*",
        (F.col("threshold") == F.min("threshold").over(few)).alias("is_best_accuracy"),
        (F.col("f1") == F.max("f1").over(few)).alias("is_best_f1"),
    )


def head_to_head(first: DataFrame, second: DataFrame) -> DataFrame:
    """Calls where the first method fixed, broke or kept the second one's outcome."""
    a, b = F.col("first_ok"), F.col("second_ok")
    count = lambda cond: F.coalesce(F.sum(cond.cast("bigint")), F.lit(0))
    return (
        first.select("call_id", F.col("correct_call").alias("first_ok"))
        .join(second.select("call_id", F.col("correct_call").alias("second_ok")), "call_id")
        .agg(
            count(a & ~b).alias("helped"),
            count(b & ~a).alias("hurt"),
            count(a == b).alias("same"),
        )
    )


def held_out(calls: DataFrame, enrolled: DataFrame, agents: DataFrame, least_phrases: int = 3,
             limit: int | None = None, consumed: DataFrame | None = None) -> DataFrame:
    """Calls no agent was enrolled from, of enrolled agents, one row per id, newest first.

    ``consumed`` (call_id) adds training calls that the registry does not list itself.
    """
    used = enrolled.select("call_id")
    if consumed is not None:
        used = used.unionByName(consumed.select("call_id"))
    fresh = calls.join(used, "call_id", "left_anti")
    first = dedupe_calls(fresh).where(F.col("n_agent_phrases") >= least_phrases)
    newest = first.join(agents.select("agent_slug"), "agent_slug", "left_semi").orderBy(
        F.desc("connect_time"), "call_id"
    )
    return newest if limit is None else newest.limit(limit)


def dedupe_calls(calls: DataFrame, order: str = "idx") -> DataFrame:
    """First occurrence of every call id; combined before the shuffle."""
    rest = [c for c in calls.columns if c != "call_id"]
    return calls.groupBy("call_id").agg(
        F.min_by(F.struct(*rest), order).alias("__row")
    ).select("call_id", "__row.*").select(*calls.columns)


def trained_ids(registry: DataFrame) -> DataFrame:
    """Distinct call ids of all enrolments; ``per_call_snr`` is an array of structs with call_id."""
    return registry.select(F.explode("per_call_snr").alias("c")).select(
        F.col("c.call_id").alias("call_id")
    ).where(F.col("call_id").isNotNull()).distinct()


def sample_calls(calls: DataFrame, n: int) -> DataFrame:
    """Reproducible sample: the n smallest MD5 digests of the id."""
    return calls.orderBy(F.md5(F.col("call_id").cast("string")), "call_id").limit(n)


def purity_audit(phrases: DataFrame) -> DataFrame:
    """Agent and customer phrases per agent and call, and per agent over all its calls.

    ``phrases`` has ``agent_slug, call_id, is_agent``.
    """
    agent = F.sum(F.col("is_agent").cast("bigint"))
    customer = F.sum((~F.col("is_agent")).cast("bigint"))
    both = F.greatest((agent + customer).cast("double"), F.lit(1.0))
    return (
        phrases.groupingSets([[F.col("agent_slug"), F.col("call_id")], [F.col("agent_slug")]],
                             F.col("agent_slug"), F.col("call_id"))
        .agg(
            agent.alias("agent_phrases"),
            customer.alias("customer_phrases"),
            F.round(100.0 * customer / both, 4).alias("contamination_pct"),
            F.round(100.0 * agent / both, 4).alias("purity_pct"),
        )
    )


def calls_per_agent(calls: DataFrame, least: int = 1, first: int | None = None) -> DataFrame:
    """Calls of agents that have at least ``least``, numbered in file order, busiest agent first.

    With ``first`` only that many calls per agent are kept; the row limit is applied per map task
    before the shuffle.
    """
    counts = calls.groupBy("agent_slug").agg(F.count("*").alias("n_calls")).where(
        F.col("n_calls") >= least
    )
    if first is None:
        return calls.join(counts, "agent_slug")
    nth = F.row_number().over(Window.partitionBy("agent_slug").orderBy("idx", "call_id"))
    kept = calls.withColumn("nth", nth).where(F.col("nth") <= first)
    return kept.join(counts, "agent_slug")


def latency_summary(runs: DataFrame, by: list[str]) -> DataFrame:
    t = F.col("processing_time_s")
    return runs.groupBy(*by).agg(
        F.count("*").alias("runs"),
        F.round(F.avg(t), 6).alias("avg_s"),
        F.round(F.min(t), 6).alias("min_s"),
        F.round(F.max(t), 6).alias("max_s"),
        F.round(F.sum(t) / F.sum("duration_s"), 6).alias("real_time_factor"),
    )


def model_ranking(models: DataFrame) -> DataFrame:
    """Models by word error rate; ``models`` is one row per model."""
    few = Window.partitionBy().orderBy("wer", "model")
    return models.withColumn("rank", F.row_number().over(few)).orderBy("rank")
