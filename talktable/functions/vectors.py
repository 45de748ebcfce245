"""Vector columns: norms, cosine, thresholds, SNR buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0), lambda acc, x: acc + x,
    )


def norm(v: Column) -> Column:
    return F.sqrt(
        F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    )


def l2_normalize(v: Column) -> Column:
    """Unit length in double; a zero vector stays as it is."""

    def scaled(u):
        return let(
            norm(u),
            lambda n: F.transform(u, lambda x: x.cast("double") / F.when(n > 0, n).otherwise(F.lit(1.0))),
        )

    return let(v, scaled)


def cosine(a: Column, b: Column) -> Column:
    """Cosine, 0 when either vector has no length."""
    return let(
        norm(a) * norm(b), lambda n: F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))
    )


def snr_bucket(snr_db: Column) -> Column:
    return F.when(snr_db >= 20.0, "high").when(snr_db >= 12.0, "mid").otherwise("low")


def agent_threshold(overall: float, max_outside: Column, margin: float = 0.05,
                    cap: float = 0.42) -> Column:
    """Stricter cut for agents whose enrolment was fuzzy; unreadable statistics keep ``overall``."""
    raised = F.greatest(F.lit(overall), max_outside.try_cast("double") + margin)
    return F.least(F.lit(cap), F.coalesce(raised, F.lit(overall)))
