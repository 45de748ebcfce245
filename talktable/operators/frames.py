"""Frame-energy analytics: exact percentiles, SNR, speech shares, clip gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import Cut, cut_keys, key_max, key_min, key_sum, running_sum, scan


def value_ranks(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Distinct values per group with count ``cnt``, rows up to it ``upto`` and group size ``n``.

    The exact order statistics of a group follow from this table. Equal values are folded before
    the shuffle, and large groups are counted block by block.
    """
    return _ranks(rows, by, value)[0]


def _ranks(rows: DataFrame, by: list[str], value: str) -> tuple[DataFrame, Cut]:
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("cnt"))
    cut = cut_keys(counts, by, value)
    return scan(counts, by, [value], {"upto": running_sum(F.col("cnt")), "n": key_sum(F.col("cnt"))}, cut), cut


def _at(value: str, position: Column) -> Column:
    """Aggregate: the value at a 0-based position of the sorted group."""
    return F.min(F.when(F.col("upto") > position, F.col(value)))


def interpolated(value: str, p: float, size: Column, skipped: Column | None = None) -> Column:
    """Aggregate over :func:`value_ranks`: linear percentile of the rows after ``skipped`` ones."""
    skipped = F.lit(0) if skipped is None else skipped
    place = F.lit(float(p)) * (size - 1)
    low = _at(value, skipped + F.floor(place))
    high = _at(value, skipped + F.ceil(place))
    weight = F.max(place - F.floor(place))
    return low + (high - low) * weight


def percentiles(rows: DataFrame, by: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated percentiles per group."""
    ranks = value_ranks(rows, by, value)
    return ranks.groupBy(*by).agg(
        F.max("n").alias("n"),
        *[interpolated(value, p, F.col("n")).alias(name) for name, p in wanted.items()],
    )


def estimate_snr(frames: DataFrame, by: list[str] = ["call_id"], least_frames: int = 8) -> DataFrame:
    """Dynamic range of the louder half of the frames in dB: 20·log10(p95 / p20)."""
    ranks, cut = _ranks(frames, by, "rms")
    middle = F.ceil(F.lit(0.5) * (F.col("n") - 1))
    halves = scan(
        ranks, by, ["rms"],
        {"below": key_max(F.when(F.col("upto") <= middle, F.col("upto")))},
        cut,
    ).withColumn("below", F.coalesce("below", F.lit(0)))
    size = F.col("n") - F.col("below")
    speech = halves.groupBy(*by).agg(
        F.max("n").alias("n_frames"),
        F.max(size).alias("n_speech"),
        interpolated("rms", 0.95, size, F.col("below")).alias("high"),
        interpolated("rms", 0.20, size, F.col("below")).alias("low"),
    )
    low = F.greatest(F.col("low"), F.lit(1e-6))
    snr = 20.0 * F.log10(F.greatest(F.col("high"), F.lit(1e-12)) / low)
    usable = (F.col("n_frames") >= least_frames) & (F.col("n_speech") >= 4)
    return speech.select(*by, "n_frames", F.when(usable, snr).otherwise(F.lit(0.0)).alias("snr_db"))


def speech_ratio(frames: DataFrame, by: list[str], factor: float = 1.5, floor: float = 0.005,
                 least_frames: int = 4) -> DataFrame:
    """Share of frames louder than ``max(factor · median, floor)``."""
    ranks, cut = _ranks(frames, by, "rms")
    place = F.lit(0.5) * (F.col("n") - 1)
    at = lambda pos: key_min(F.when(F.col("upto") > pos, F.col("rms")))
    marked = scan(
        ranks, by, ["rms"], {"lo": at(F.floor(place)), "hi": at(F.ceil(place))}, cut
    )
    limit = F.greatest(F.lit(factor) * (F.col("lo") + F.col("hi")) / 2, F.lit(floor))
    loud = F.when(F.col("rms") > limit, F.col("cnt")).otherwise(F.lit(0))
    return marked.groupBy(*by).agg(F.max("n").alias("n_frames"), F.sum(loud).alias("loud")).select(
        *by, "n_frames",
        F.when(F.col("n_frames") < least_frames, F.lit(0.0))
        .otherwise(F.col("loud") / F.col("n_frames")).alias("speech_ratio"),
    )


def audible_chunks(frames: DataFrame, by: list[str], silence: float, least: float = 0.08) -> DataFrame:
    """Chunks in which at least ``least`` of the frames are not silent."""
    return (
        frames.groupBy(*by)
        .agg(F.avg((F.col("rms") > silence).cast("double")).alias("voiced"))
        .where(F.col("voiced") >= least)
    )


def speech_windows(frames: DataFrame, frame_s: float = 0.030, window_s: float = 2.0,
                   step_s: float = 1.0, percentile: float = 0.60, share: float = 0.30) -> DataFrame:
    """Windows of a recording with ``is_speech``: enough frames at or above its own percentile.

    Each frame lists the windows it falls into, so windows and frames meet by equality.
    """
    limits = percentiles(frames, ["call_id"], "rms", {"limit": percentile}).select(
        "call_id", "limit", F.col("n").alias("n_frames")
    )
    scale = 1_000_000
    frame, window, step = (round(x * scale) for x in (frame_s, window_s, step_s))
    idx = F.col("frame_idx")
    # window w covers frames (w·step) div frame up to, not including, (w·step + window) div frame
    first = F.greatest(
        F.lit(0), F.floor(((idx + 1) * frame - window + step - 1) / F.lit(float(step)))
    )
    last = F.floor(((idx + 1) * frame - 1) / F.lit(float(step)))
    total = F.col("n_frames") * frame
    fits = F.floor((total - window) / F.lit(float(step)))
    begin = F.floor(F.col("win_idx") * step / F.lit(float(frame)))
    end = F.floor((F.col("win_idx") * step + window) / F.lit(float(frame)))
    return (
        frames.join(limits, "call_id")
        .withColumn("last", F.least(last, fits))
        .where((total >= window) & (F.col("last") >= first))
        .withColumn("win_idx", F.explode(F.sequence(first, F.col("last"))))
        .where((idx >= begin) & (idx < end))
        .groupBy("call_id", "win_idx")
        .agg(F.avg((F.col("rms") >= F.col("limit")).cast("double")).alias("active"))
        .withColumn("is_speech", F.col("active") >= share)
    )


def energy_gate(segments: DataFrame, drop_db: float = 11.0, by: list[str] = ["call_id"]) -> DataFrame:
    """Segments within ``drop_db`` of the loudest one of their call; a silent call is kept whole."""
    peaks = segments.groupBy(*by).agg(F.max("rms").alias("__peak"))
    near = (F.col("rms") > 0) & (
        20.0 * F.log10("__peak") - 20.0 * F.log10(F.greatest(F.col("rms"), F.lit(1e-300))) <= drop_db
    )
    return segments.join(peaks, by).where((F.col("__peak") <= 0) | near).drop("__peak")


def clip_quality(duration_s: Column, rms_dbfs: Column, flatness: Column, snr_db: Column,
                 shortest: float = 1.5, longest: float = 20.0, quietest: float = -40.0,
                 flattest: float = 0.6, noisiest: float = 10.0) -> Column:
    """First failing quality check of a clip, empty when it passes."""
    return (
        F.when(duration_s < shortest, "too short")
        .when(duration_s > longest, "too long")
        .when(rms_dbfs < quietest, "too quiet")
        .when(flatness > flattest, "too noisy")
        .when(snr_db < noisiest, "low SNR")
        .otherwise("")
    )


def is_clean_recording(rms: Column, flatness: Column) -> Column:
    return (rms > 0.10) & (flatness < 0.20)


def embed_window(start_s: Column, end_s: Column, call_end_s: Column, shortest: float = 0.3,
                 pad_below: float = 0.8, pad_s: float = 0.2) -> Column:
    """Struct ``win_start_s, win_end_s, long_enough`` of the audio a segment is embedded from."""
    end = F.least(end_s, call_end_s)
    length = F.round(end - start_s, 9)
    short = length < pad_below
    return F.struct(
        F.when(short, F.greatest(F.lit(0.0), start_s - pad_s)).otherwise(start_s).alias("win_start_s"),
        F.when(short, F.least(call_end_s, end + pad_s)).otherwise(end).alias("win_end_s"),
        (length >= shortest).alias("long_enough"),
    )


def embeddable(segments: DataFrame, frames: DataFrame, frame_s: float, least: float = 0.25) -> DataFrame:
    """Segments with their embed window, its speech ratio and ``eligible``.

    ``segments`` has ``call_id, seg_idx, start_s, end_s, call_end_s``. A window covers the frames
    lying wholly inside it, which it lists by index.
    """
    w = segments.withColumn("__w", embed_window(F.col("start_s"), F.col("end_s"), F.col("call_end_s"))).select(
        "*", "__w.*"
    ).drop("__w")
    first = F.ceil(F.round(F.col("win_start_s") / frame_s, 6))
    last = F.floor(F.round(F.col("win_end_s") / frame_s, 6)) - 1
    covered = (
        w.where(F.col("long_enough") & (last >= first))
        .select("call_id", "seg_idx", F.explode(F.sequence(first, last)).alias("frame_idx"))
        .join(frames.select("call_id", "frame_idx", "rms"), ["call_id", "frame_idx"])
    )
    ratios = speech_ratio(covered, ["call_id", "seg_idx"]).select("call_id", "seg_idx", "speech_ratio")
    ratio = F.coalesce(F.col("speech_ratio"), F.lit(0.0))
    return w.join(ratios, ["call_id", "seg_idx"], "left").withColumn("speech_ratio", ratio).withColumn(
        "eligible", F.col("long_enough") & (F.col("speech_ratio") >= least)
    )


def enrolment_gate(windows: DataFrame, clips: DataFrame, least_windows: int = 30,
                   least_seconds: float = 60.0, call_seconds: float = 3.0, call_windows: int = 3,
                   bucket_windows: int = 20) -> tuple[DataFrame, DataFrame]:
    """Agents and their buckets that have enough material.

    ``windows`` has ``agent_slug, call_id, bucket`` (one row per vector), ``clips`` has
    ``agent_slug, call_id, seconds, snr_db, bucket`` (one row per call). Calls that are too short
    or have too few windows are dropped first.
    """
    per_call = windows.groupBy("agent_slug", "call_id").agg(F.count("*").alias("n_windows"))
    used = clips.join(per_call, ["agent_slug", "call_id"]).where(
        (F.col("seconds") >= call_seconds) & (F.col("n_windows") >= call_windows)
    )
    agents = (
        used.groupBy("agent_slug")
        .agg(F.sum("n_windows").alias("n_windows"), F.sum("seconds").alias("seconds"),
             F.count("*").alias("used_calls"))
        .where((F.col("n_windows") >= least_windows) & (F.col("seconds") >= least_seconds))
    )
    kept = used.join(agents.select("agent_slug"), "agent_slug", "left_semi")
    medians = percentiles(kept, ["agent_slug", "bucket"], "snr_db", {"snr_median": 0.5})
    buckets = (
        kept.groupBy("agent_slug", "bucket")
        .agg(F.sum("n_windows").alias("n_windows"), F.count("*").alias("calls"))
        .where(F.col("n_windows") >= bucket_windows)
        .join(medians.select("agent_slug", "bucket", "snr_median"), ["agent_slug", "bucket"])
    )
    return agents, buckets
