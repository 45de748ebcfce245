"""Role accuracy over time ticks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordered import before, cut_keys, following, max_before, scan

#: ticks of a call that are painted together where its indexes do not rise with its starts
PAINTED = 2048


def tick_accuracy(ticks: DataFrame, digits: int = 4, weight: Column | None = None) -> DataFrame:
    """Percent of right ticks per call, overall and by true role (``truth``, ``ours``: is agent).

    A row is one tick, or ``weight`` of them.
    """
    n = F.lit(1).cast("bigint") if weight is None else weight
    right = F.when(F.col("truth") == F.col("ours"), n).otherwise(0)

    def pct(part: Column) -> Column:
        share = F.sum(F.when(part, right)).cast("double") / F.sum(F.when(part, n))
        return F.round(100 * F.coalesce(share, F.lit(0.0)), digits)

    return ticks.groupBy("call_id").agg(
        F.sum(n).alias("ticks"),
        pct(F.lit(True)).alias("overall_pct"),
        pct(F.col("truth")).alias("agent_pct"),
        pct(~F.col("truth")).alias("customer_pct"),
    )


def _painted(rows: DataFrame) -> DataFrame:
    """Ranges of the lowest covering index, whatever the order of the indexes; ``rows`` as in ``label_pieces``.

    Intervals are cut at blocks of ``PAINTED`` ticks, and of equal ranges in a block the lowest index stays, so a block's rows are
    bounded. A block is painted from the highest index to the lowest.
    """
    size = F.lit(float(PAINTED))
    at = F.floor(F.col("first") / size).cast("bigint")
    parts = rows.withColumn("__at", F.explode(F.sequence(at, F.floor(F.col("last") / size).cast("bigint")))).select(
        "call_id", "__at", "__i", "label",
        F.greatest("first", F.col("__at") * PAINTED).alias("first"),
        F.least("last", F.col("__at") * PAINTED + PAINTED - 1).alias("last"),
    ).groupBy("call_id", "__at", "first", "last").agg(F.min_by("label", "__i").alias("label"), F.min("__i").alias("__i"))
    schema = T.StructType([parts.schema[c] for c in ("call_id", "first", "last", "label")])

    def paint(block: pa.Table) -> pa.Table:
        block = block.sort_by([("__i", "descending")])
        first, last = block.column("first").to_numpy(), block.column("last").to_numpy()
        base = block.column("__at")[0].as_py() * PAINTED
        owner = np.full(PAINTED, -1, np.int64)
        for row, (s, e) in enumerate(zip((first - base).tolist(), (last - base).tolist())):
            owner[s:e + 1] = row
        cuts = np.flatnonzero(np.diff(owner)) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [PAINTED]]) - 1
        seen = owner[starts] >= 0
        of = pa.array(owner[starts[seen]])
        columns = [block.column("call_id").take(of), pa.array(starts[seen] + base), pa.array(ends[seen] + base), block.column("label").take(of)]
        return pa.table(columns, names=["call_id", "first", "last", "label"])

    return parts.groupBy("call_id", "__at").applyInArrow(paint, schema)


def label_pieces(intervals: DataFrame, label: str, index: str, step: float = 0.5) -> DataFrame:
    """Disjoint tick ranges (call_id, first, last, label) with the label of the lowest covering index.

    Where a call's indexes rise with its starts, an interval is the lowest one from the end of all earlier ones
    on, so a running maximum gives its range. The ranges of other calls are painted block by block.
    """
    rows = intervals.select(
        "call_id", F.col(index).alias("__i"), F.col(label).alias("label"),
        F.ceil(F.greatest(F.col("start_s"), F.lit(0.0)) / F.lit(step)).cast("bigint").alias("first"),
        F.floor(F.col("end_s") / F.lit(step)).cast("bigint").alias("last"),
    ).where(F.col("last") >= F.col("first"))
    # an index that falls back shows in the order of (first, index)
    seen = scan(rows, ["call_id"], ["first", "__i"], {"ended": max_before(F.col("last")), "highest": max_before(F.col("__i"))},
                cut_keys(rows, ["call_id"], "first"))
    mixed = seen.where(F.col("highest") > F.col("__i")).select("call_id").distinct()
    ranges = seen.withColumn("first", F.greatest("first", F.coalesce(F.col("ended") + 1, F.col("first")))).where(
        F.col("last") >= F.col("first")
    ).select("call_id", "first", "last", "label")
    painted = _painted(rows.join(mixed, "call_id", "left_semi"))
    return ranges.join(mixed, "call_id", "left_anti").unionByName(painted)


def joint_ticks(truth: DataFrame, ours: DataFrame) -> DataFrame:
    """Ranges in which both sides have a label: call_id, their first ``tick``, truth, ours and their number of ticks ``n``.

    Both sides are disjoint ranges of booleans, null ones stay null. Their ends are put in one order and the label in force on each
    side is carried along it; no tick becomes a row and no ranges are paired. Rows without a call id meet nothing.
    """
    code = F.when(F.col("label").isNull(), 3).when(F.col("label"), 2).otherwise(1)

    def marks(side: DataFrame, name: str) -> DataFrame:
        other = "ours" if name == "truth" else "truth"
        return side.where(F.col("call_id").isNotNull()).select("call_id", F.explode(F.array(
            F.struct(F.col("first").alias("tick"), code.alias(name)),
            F.struct((F.col("last") + 1).alias("tick"), F.lit(0).alias(name)),
        )).alias("m")).select("call_id", "m.tick", F.col(f"m.{name}").alias(name), F.lit(None).cast("int").alias(other))

    # where one range ends and the next begins, the beginning counts
    at = marks(truth, "truth").unionByName(marks(ours, "ours")).groupBy("call_id", "tick").agg(
        F.max("truth").alias("truth"), F.max("ours").alias("ours")
    )
    carried = scan(at, ["call_id"], ["tick"], {
        "truth_before": before(F.col("truth")), "ours_before": before(F.col("ours")), "until": following(F.col("tick")),
    }, cut_keys(at, ["call_id"], "tick"))
    now = lambda side: F.coalesce(F.col(side), F.col(f"{side}_before"), F.lit(0))
    label = lambda side: F.when(now(side) < 3, now(side) == 2)
    return carried.select(
        "call_id", "tick", label("truth").alias("truth"), label("ours").alias("ours"),
        (F.col("until") - F.col("tick")).alias("n"),
        ((now("truth") > 0) & (now("ours") > 0)).alias("both"),
    ).where("both and n > 0").drop("both")


def joint_labels(truth: DataFrame, ours: DataFrame, step: float = 0.5) -> DataFrame:
    """Ticks at which both sides have a label: call_id, tick, truth, ours. Only ranges are shuffled, each lists its ticks last."""
    joint = joint_ticks(label_pieces(truth, "truth", "idx", step), label_pieces(ours, "ours", "idx", step))
    return joint.select("call_id", F.explode(F.sequence("tick", F.col("tick") + F.col("n") - 1)).alias("tick"), "truth", "ours")


def interval_accuracy(truth: DataFrame, ours: DataFrame, step: float = 0.5, digits: int = 4) -> DataFrame:
    """``tick_accuracy`` of intervals: ``truth`` with ``truth, idx``, ``ours`` with ``ours, idx``."""
    joint = joint_ticks(label_pieces(truth, "truth", "idx", step), label_pieces(ours, "ours", "idx", step))
    return tick_accuracy(joint, digits, F.col("n"))


def macro_accuracy(per_call: DataFrame, digits: int = 1) -> DataFrame:
    """Average of the per-call percentages, every call counting the same."""
    return per_call.agg(
        F.count("*").alias("calls"),
        *[F.round(F.avg(c), digits).alias(c) for c in ("overall_pct", "agent_pct", "customer_pct")],
    )
