"""Centroids, outlier tightening and coherence of groups of vectors."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let
from ..functions.vectors import cosine, dot, l2_normalize
from ..storage import materialize


def mean_vector(embedding: Column) -> Column:
    """Aggregate: element-wise mean. One buffer of ``dim`` doubles per group and map task, so a
    hot group is combined before the shuffle and rows are not multiplied by the dimension."""
    return vector_to_array(Summarizer.mean(array_to_vector(embedding)))


def centroids(vectors: DataFrame, by: list[str], embedding: str = "embedding",
              unit: bool = True) -> DataFrame:
    """Mean vector per group with its row count, unit length unless ``unit=False``."""
    means = vectors.where(F.col(embedding).isNotNull()).groupBy(*by).agg(
        mean_vector(F.col(embedding)).alias("centroid"), F.count("*").alias("n")
    )
    return means.withColumn("centroid", l2_normalize(F.col("centroid"))) if unit else means


def unit_vectors(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    return vectors.withColumn(embedding, l2_normalize(F.col(embedding)))


def _parts(rows: DataFrame, by: list[str], flags: list[str], embedding: str = "embedding") -> DataFrame:
    """Per group a short array with mean and count of each combination of ``flags``."""
    means = rows.groupBy(*by, *flags).agg(mean_vector(F.col(embedding)).alias("mean"), F.count("*").alias("rows"))
    return means.groupBy(*by).agg(F.collect_list(F.struct(*flags, "mean", "rows")).alias("parts"))


def _rows(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0).cast("bigint"), lambda acc, p: acc + p["rows"])


def _unit_mean(parts: Column) -> Column:
    """Direction of the mean over several parts."""

    def total(ps):
        first = F.get(ps, F.lit(0))
        return F.aggregate(
            F.slice(ps, 2, F.size(ps)),
            F.transform(first["mean"], lambda x: x * first["rows"]),
            lambda acc, p: F.zip_with(acc, p["mean"], lambda a, x: a + x * p["rows"]),
        )

    return l2_normalize(let(parts, total))


def tighten(
    vectors: DataFrame,
    by: list[str],
    first: float = 0.45,
    second: float = 0.55,
    least: int = 15,
    embedding: str = "embedding",
) -> tuple[DataFrame, DataFrame]:
    """Two-pass outlier drop.

    Returns the rows with ``keep`` and their cosine to the final centroid, and one row per group:
    ``centroid, n, n_kept, inside, outside``. A pass that would leave fewer than ``least`` rows
    does not count. Only the per-group tables are written out between passes, so the vectors are
    read once per pass and never nested into each other's plans.
    """
    unit = unit_vectors(vectors.where(F.col(embedding).isNotNull()), embedding)
    v = F.col(embedding)

    start = materialize(centroids(unit, by, embedding).select(*by, F.col("centroid").alias("c0")))

    sim1 = dot(v, F.col("c0"))
    flagged1 = unit.join(start, by).withColumn("keep1", sim1 >= first)
    pass1 = materialize(
        _parts(flagged1, by, ["keep1"])
        .withColumn("n", _rows(F.col("parts")))
        .withColumn("kept", F.filter("parts", lambda p: p["keep1"]))
        .withColumn("use1", _rows(F.col("kept")) >= least)
        .withColumn("c1", _unit_mean(F.when(F.col("use1"), F.col("kept")).otherwise(F.col("parts"))))
        .join(start, by)
        .select(*by, "n", "c0", "use1", "c1")
    )

    def with_keep1(frame):
        return frame.withColumn("keep1", ~F.col("use1") | (sim1 >= first)).withColumn(
            "keep2", F.col("keep1") & (dot(v, F.col("c1")) >= second)
        )

    flagged2 = with_keep1(unit.join(pass1, by)).where("keep1")
    pass2 = materialize(
        _parts(flagged2, by, ["keep2"])
        .withColumn("kept", F.filter("parts", lambda p: p["keep2"]))
        .withColumn("use2", _rows(F.col("kept")) >= least)
        .withColumn("chosen", F.when(F.col("use2"), F.col("kept")).otherwise(F.col("parts")))
        .withColumn("centroid", _unit_mean(F.col("chosen")))
        .withColumn("n_kept", _rows(F.col("chosen")))
        .join(pass1, by)
        .select(*by, "n", "n_kept", "c0", "use1", "c1", "use2", "centroid")
    )

    rows = with_keep1(unit.join(pass2, by)).withColumn(
        "keep", F.when(F.col("use2"), F.col("keep2")).otherwise(F.col("keep1"))
    ).withColumn("sim", dot(v, F.col("centroid"))).select(*unit.columns, "keep", "sim")

    stats = rows.groupBy(*by).agg(
        F.coalesce(F.avg(F.when(F.col("keep"), F.col("sim"))), F.lit(0.0)).alias("inside"),
        F.coalesce(F.max(F.when(~F.col("keep"), F.col("sim"))), F.lit(0.0)).alias("outside"),
    )
    groups = stats.join(pass2.select(*by, "n", "n_kept", "centroid"), by)
    return rows, groups


def drop_outliers_once(
    vectors: DataFrame,
    by: list[str],
    order: list[str],
    threshold: float,
    strict: bool = False,
    least: int = 1,
    embedding: str = "embedding",
) -> DataFrame:
    """One pass against the mean; when nothing survives the better half is used instead.

    One row per group with the new unit centroid, rows used and mean/min/max cosine to it.
    ``strict`` compares with ``>``; groups with fewer than ``least`` kept rows count as empty.
    """
    from .topk import keep_top

    unit = vectors.where(F.col(embedding).isNotNull())
    v = F.col(embedding)
    mean = materialize(centroids(unit, by, embedding).select(*by, F.col("centroid").alias("c0")))
    scored = unit.join(mean, by).withColumn("__sim", cosine(v, F.col("c0")))
    ok = F.col("__sim") > threshold if strict else F.col("__sim") >= threshold
    counts = materialize(
        scored.groupBy(*by).agg(
            F.count("*").alias("n"), F.sum(ok.cast("bigint")).alias("n_ok")
        )
    )
    passing = scored.join(
        counts.where(F.col("n_ok") >= least).select(*by), by, "left_semi"
    ).where(ok)
    relaxed_groups = counts.where(F.col("n_ok") < least).select(
        *by, F.greatest(F.lit(1), F.floor(F.col("n") / 2)).cast("bigint").alias("__take")
    )
    relaxed = keep_top(scored.join(relaxed_groups, by), by, "__sim", "__take", order).drop("__take")
    kept = passing.unionByName(relaxed)
    final = materialize(centroids(kept, by, embedding).select(*by, "centroid", F.col("n").alias("n_used")))
    return (
        kept.join(final.select(*by, "centroid"), by)
        .withColumn("__cos", cosine(v, F.col("centroid")))
        .groupBy(*by)
        .agg(
            F.avg("__cos").alias("mean_cosine"),
            F.min("__cos").alias("min_cosine"),
            F.max("__cos").alias("max_cosine"),
        )
        .join(final, by)
        .join(counts.select(*by, "n", (F.col("n_ok") < least).alias("relaxed")), by)
    )


def pairwise_coherence(vectors: DataFrame, by: list[str], expected: int | Column | None = None,
                       embedding: str = "embedding") -> DataFrame:
    """Mean cosine over all pairs of a group times its coverage, from the sum vector alone.

    For unit vectors the pair sum is (|sum|² − n) / 2, so no pair is ever formed.
    """
    unit = unit_vectors(vectors.where(F.col(embedding).isNotNull()), embedding)
    n = F.col("n").cast("double")
    squared = F.aggregate(
        F.col("centroid"), F.lit(0.0), lambda acc, x: acc + x * x
    ) * n * n
    coverage = F.lit(1.0) if expected is None else n / (
        expected if isinstance(expected, Column) else F.lit(float(expected))
    )
    return (
        centroids(unit, by, embedding, unit=False)
        .withColumn(
            "coherence",
            F.when(F.col("n") < 2, F.lit(0.0)).otherwise((squared - n) / (n * (n - 1)) * coverage),
        )
        .select(*by, "n", "coherence")
    )
