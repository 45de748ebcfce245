"""Largest rows of a group when the number to keep depends on the group's size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import cut_keys, running_sum, scan


def _ranked_values(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Distinct values of each group with their count and the rows at or above them."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("__n"))
    return scan(
        counts, by, [F.col(value) * -1], {"__upto": running_sum(F.col("__n"))}, cut_keys(counts, by, F.col(value) * -1)
    )


def top_fraction_mean(scores: DataFrame, by: list[str], value: str, fraction: float = 0.30,
                      least: int = 5) -> DataFrame:
    """Mean of the best ``max(least, floor(fraction * n))`` values of each group.

    Equal values are counted first, so a hot group shrinks before the shuffle, and the running
    count over the distinct values of a large group is taken block by block.
    """
    ranked = _ranked_values(scores, by, value)
    sizes = scores.groupBy(*by).agg(F.count("*").alias("n"))
    k = F.greatest(F.lit(least), F.floor(F.col("n") * F.lit(float(fraction))))
    above = F.col("__upto") - F.col("__n")
    used = F.greatest(F.lit(0), F.least(F.col("__n"), F.col("k") - above))
    return (
        ranked.join(sizes.withColumn("k", F.least(k, F.col("n"))), by)
        .withColumn("__used", used)
        .groupBy(*by)
        .agg(
            (F.sum(F.col(value) * F.col("__used")) / F.sum("__used")).alias("top_mean"),
            F.max("n").alias("n"),
            F.max("k").alias("k"),
        )
    )


def keep_top(rows: DataFrame, by: list[str], value: str, take: str, order: list[str]) -> DataFrame:
    """Rows of each group with the ``take`` largest values; ``order`` breaks ties."""
    ranked = scan(
        rows,
        by,
        [F.col(value) * -1, *order],
        {"__rank": running_sum(F.lit(1).cast("bigint"))},
        cut_keys(rows, by, F.col(value) * -1),
    )
    return ranked.where(F.col("__rank") <= F.col(take)).drop("__rank")
