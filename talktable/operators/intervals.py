"""Timed intervals: overlap joins, nearest rows, merging, window grids.

Interval columns are ``start_s`` and ``end_s`` in seconds; joins are within ``call_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import (
    Cut,
    after,
    before,
    cut_keys,
    max_before,
    previous,
    running_sum,
    scan,
    sum_before,
)

BIN_SECONDS = 60.0


def overlap_seconds(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def overlap_fraction(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Overlap as a share of the first interval, 0 for an empty one."""
    length = a_end - a_start
    return F.when(
        length > 0, overlap_seconds(a_start, a_end, b_start, b_end) / length
    ).otherwise(F.lit(0.0))


def _bin(seconds: Column, width: float) -> Column:
    return F.floor(seconds / F.lit(width))


def _bins(start: Column, end: Column, width: float) -> Column:
    return F.explode(F.sequence(_bin(start, width), _bin(F.greatest(start, end), width)))


def overlapping(left: DataFrame, right: DataFrame, prefix: str = "r_",
                width: float = BIN_SECONDS) -> DataFrame:
    """Pairs of rows of one call whose intervals share time, with ``overlap_s``.

    Both sides are spread over time bins and joined on (call, bin), so a long call is spread over
    many tasks. A pair is emitted only in the first bin the two intervals have in common.
    Right-hand columns other than ``call_id`` get ``prefix``.
    """
    names = {c: f"{prefix}{c}" for c in right.columns if c != "call_id"}
    r = right.select("call_id", *[F.col(c).alias(n) for c, n in names.items()])
    rs, re = F.col(f"{prefix}start_s"), F.col(f"{prefix}end_s")
    ls, le = F.col("start_s"), F.col("end_s")
    lb = left.where(le > ls).withColumn("__bin", _bins(ls, le, width))
    rb = r.where(re > rs).withColumn("__bin", _bins(rs, re, width))
    return (
        lb.join(rb, ["call_id", "__bin"])
        .where((ls < re) & (rs < le) & (F.col("__bin") == _bin(F.greatest(ls, rs), width)))
        .withColumn("overlap_s", F.least(le, re) - F.greatest(ls, rs))
        .drop("__bin")
    )


def assign_dominant_speaker(segments: DataFrame, turns: DataFrame) -> DataFrame:
    """Add ``speaker``: the turn speaker sharing most time with the segment, UNKNOWN if none.

    ``segments`` has ``call_id, seg_idx``; ``turns`` has ``turn_idx, speaker``. Ties go to the
    speaker whose first overlapping turn comes first.
    """
    spans = segments.select("call_id", "seg_idx", "start_s", "end_s")
    per_speaker = (
        overlapping(spans, turns.select("call_id", "turn_idx", "start_s", "end_s", "speaker"))
        .groupBy("call_id", "seg_idx", "r_speaker")
        .agg(F.sum("overlap_s").alias("overlap_s"), F.min("r_turn_idx").alias("first_idx"))
    )
    rank = F.struct(F.round("overlap_s", 9), -F.col("first_idx"))
    best = per_speaker.groupBy("call_id", "seg_idx").agg(
        F.max_by("r_speaker", rank).alias("speaker"), F.max("overlap_s").alias("overlap_s")
    )
    rest = [c for c in segments.columns if c not in ("speaker", "overlap_s")]
    return segments.select(*rest).join(best, ["call_id", "seg_idx"], "left").withColumn(
        "speaker", F.coalesce("speaker", F.lit("UNKNOWN"))
    )


def best_overlap_match(segments: DataFrame, phrases: DataFrame, least: float = 0.01) -> DataFrame:
    """Per segment the phrase covering most of it; segments covered below ``least`` are dropped.

    ``phrases`` has ``phrase_idx``; the first of equally good phrases is taken. Phrase columns
    come back with the prefix ``p_``.
    """
    fraction = F.round(F.col("overlap_s") / (F.col("end_s") - F.col("start_s")), 9)
    pairs = overlapping(segments, phrases, prefix="p_").withColumn("fraction", fraction)
    rank = F.struct(F.col("fraction"), -F.col("p_phrase_idx"))
    rest = [c for c in pairs.columns if c not in ("call_id", "seg_idx", "overlap_s")]
    best = pairs.groupBy("call_id", "seg_idx").agg(F.max_by(F.struct(*rest), rank).alias("m"))
    return best.select("call_id", "seg_idx", "m.*").where(F.col("fraction") >= least)


def region_vote(segments: DataFrame, regions: DataFrame) -> DataFrame:
    """Per call the speaker with most seconds inside the regions; calls without overlap get none."""
    votes = (
        overlapping(
            segments.where(F.col("speaker").isNotNull() & (F.col("speaker") != "")),
            regions.select("call_id", "start_s", "end_s"),
        )
        .groupBy("call_id", "speaker")
        .agg(F.sum("overlap_s").alias("votes_s"), F.min("seg_idx").alias("first_idx"))
    )
    rank = F.struct(F.round("votes_s", 9), -F.col("first_idx"))
    return votes.groupBy("call_id").agg(
        F.max_by("speaker", rank).alias("speaker"), F.max("votes_s").alias("votes_s")
    )


def labels_at_ticks(intervals: DataFrame, label: str, index: str, step: float = 0.5,
                    durations: DataFrame | None = None) -> DataFrame:
    """Label at every tick ``0, step, 2·step, …`` that some interval covers, ends included.

    Of several covering intervals the one with the lowest index counts. Every interval lists its
    own ticks, so no range join is needed; ``durations`` (call_id, duration_s) cuts the grid.
    """
    first = F.ceil(F.greatest(F.col("start_s"), F.lit(0.0)) / F.lit(step))
    last = F.floor(F.col("end_s") / F.lit(step))
    ticks = (
        intervals.where(last >= first)
        .select("call_id", F.col(index).alias("__i"), F.col(label).alias("__l"),
                F.explode(F.sequence(first, last)).alias("tick"))
        .groupBy("call_id", "tick")
        .agg(F.min_by("__l", "__i").alias(label))
    )
    if durations is None:
        return ticks
    return ticks.join(durations, "call_id").where(
        F.col("tick") * F.lit(step) < F.col("duration_s")
    ).drop("duration_s")


def label_at_mid(segments: DataFrame, truth: DataFrame, label: str, index: str,
                 width: float = BIN_SECONDS) -> DataFrame:
    """Truth label of the first interval that covers each segment's mid-point, null if none."""
    mid = (F.col("start_s") + F.col("end_s")) / 2
    points = segments.select("call_id", "seg_idx", mid.alias("__mid")).withColumn(
        "__bin", _bin(F.col("__mid"), width)
    )
    spans = truth.where(F.col("end_s") >= F.col("start_s")).select(
        "call_id", F.col("start_s").alias("__s"), F.col("end_s").alias("__e"),
        F.col(label).alias("__l"), F.col(index).alias("__i"),
        _bins(F.col("start_s"), F.col("end_s"), width).alias("__bin"),
    )
    found = (
        points.join(spans, ["call_id", "__bin"])
        .where(F.col("__mid").between(F.col("__s"), F.col("__e")))
        .groupBy("call_id", "seg_idx")
        .agg(F.min_by("__l", "__i").alias(label))
    )
    return segments.join(found, ["call_id", "seg_idx"], "left")


def words_in_utterances(utterances: DataFrame, words: DataFrame, slack: float = 0.05,
                        width: float = BIN_SECONDS) -> DataFrame:
    """Long table of (utterance, word) for words inside the utterance, ``slack`` seconds either way.

    A word may belong to several utterances. Nesting is left to the JSON sink.
    """
    w = words.select(
        "call_id", "word_idx", "word", F.col("start_s").alias("word_start_s"),
        F.col("end_s").alias("word_end_s"),
    ).withColumn("__bin", _bin(F.col("word_start_s"), width))
    lo, hi = F.col("start_s") - slack, F.col("end_s") + slack
    u = utterances.withColumn("__bin", _bins(lo, hi, width))
    return (
        u.join(w, ["call_id", "__bin"])
        .where((F.col("word_start_s") >= lo) & (F.col("word_end_s") <= hi))
        .drop("__bin")
    )


def near_customer(phrases: DataFrame, buffer_s: float) -> DataFrame:
    """Agent phrases with ``near``: whether a customer phrase comes within ``buffer_s``.

    A sweep instead of an interval join: agent rows are placed at the latest customer start that
    could reach them, and the latest customer end seen so far decides.
    """
    spot = F.when(F.col("is_agent"), F.col("end_s") + buffer_s).otherwise(F.col("start_s"))
    placed = phrases.withColumn("__spot", spot).withColumn(
        "__kind", F.when(F.col("is_agent"), 0).otherwise(1)
    )
    swept = scan(
        placed,
        ["call_id"],
        ["__spot", "__kind", "phrase_idx"],
        {"__reach": max_before(F.when(~F.col("is_agent"), F.col("end_s")))},
        cut_keys(placed, ["call_id"], "__spot"),
    )
    return (
        swept.where("is_agent")
        .withColumn("near", F.coalesce(F.col("__reach") > F.col("start_s") - buffer_s, F.lit(False)))
        .drop("__spot", "__kind", "__reach")
    )


def purity_filter(phrases: DataFrame, buffer_s: float = 2.0, min_clip_s: float = 0.4) -> DataFrame:
    """Agent phrases long enough and away from every customer phrase."""
    return near_customer(phrases, buffer_s).where(
        ~F.col("near") & (F.col("end_s") - F.col("start_s") >= min_clip_s)
    ).drop("near")


def purity_ratio(phrases: DataFrame, buffer_s: float = 2.0, min_clip_s: float = 0.4,
                 least: float = 0.90) -> DataFrame:
    """Kept share of agent phrases per call and whether the call passes."""
    long_enough = F.col("end_s") - F.col("start_s") >= min_clip_s
    clean = (~F.col("near") & long_enough).cast("bigint")
    return (
        near_customer(phrases, buffer_s)
        .groupBy("call_id")
        .agg(F.count("*").alias("agent_phrases"), F.sum(clean).alias("clean_phrases"))
        .withColumn("purity", F.round(F.col("clean_phrases") / F.col("agent_phrases"), 6))
        .withColumn("passes", F.col("clean_phrases") / F.col("agent_phrases") >= least)
    )


def nearest_in_time(rows: DataFrame, label: str) -> DataFrame:
    """Rows without ``label`` take that of the row with the nearest mid-point in their call.

    Of equally near rows the lower ``seg_idx`` wins; calls without any label stay null.
    """
    mid = (F.col("start_s") + F.col("end_s")) / 2
    columns = rows.columns
    payload = F.struct(*columns)
    ref = F.struct(
        F.col("__mid").alias("mid"), F.col("seg_idx").alias("idx"), F.col(label).alias("label")
    )
    known = rows.where(F.col(label).isNotNull()).withColumn("__mid", mid)
    points = known.groupBy("call_id", "__mid").agg(F.min_by(ref, "seg_idx").alias("__ref"))
    asked = rows.where(F.col(label).isNull()).select(
        "call_id", mid.alias("__mid"), "seg_idx", payload.alias("__row")
    )
    line = points.select(
        "call_id", "__mid", F.lit(0).alias("__kind"), F.col("__ref.idx").alias("seg_idx"), "__ref",
        F.lit(None).cast(asked.schema["__row"].dataType).alias("__row"),
    ).unionByName(
        asked.withColumn("__kind", F.lit(1)).withColumn(
            "__ref", F.lit(None).cast(points.schema["__ref"].dataType)
        )
    )
    placed = scan(
        line,
        ["call_id"],
        ["__mid", "__kind", "seg_idx"],
        {"__left": before(F.col("__ref")), "__right": after(F.col("__ref"))},
        cut_keys(line, ["call_id"], "__mid"),
    ).where(F.col("__kind") == 1)
    gap = lambda side: F.abs(F.col("__mid") - F.col(f"{side}.mid"))
    left_wins = F.col("__right").isNull() | (
        F.struct(gap("__left"), F.col("__left.idx")) <= F.struct(gap("__right"), F.col("__right.idx"))
    )
    picked = F.when(F.col("__left").isNotNull() & left_wins, F.col("__left.label")).otherwise(
        F.col("__right.label")
    )
    filled = placed.select(
        *[picked.alias(c) if c == label else F.col(f"__row.{c}").alias(c) for c in columns]
    )
    return rows.where(F.col(label).isNotNull()).unionByName(filled)


def split_at_turns(segments: DataFrame, turns: DataFrame, margin_s: float = 1.0,
                   least_words: int = 2, width: float = BIN_SECONDS) -> DataFrame:
    """Split segments at turn starts at least ``margin_s`` from both ends, sharing words by time.

    A segment stays whole when any part would get fewer than ``least_words`` words. A segment with
    more cuts than its words allow is kept whole from the count alone, so the list of cuts of a
    row never outgrows its text.
    """
    from ..functions.text import split_words

    s, e = F.col("start_s"), F.col("end_s")
    words = split_words(F.col("text"))
    cuts = turns.select(
        "call_id", F.col("start_s").alias("cut"), _bin(F.col("start_s"), width).alias("__bin")
    ).distinct()
    able = segments.where((e - s >= 2 * margin_s) & (F.size(words) >= 2 * least_words)).select(
        "call_id", "seg_idx", s.alias("__s"), e.alias("__e"), F.size(words).alias("__n")
    )
    inside = (
        able.withColumn("__bin", _bins(F.col("__s"), F.col("__e"), width))
        .join(cuts, ["call_id", "__bin"])
        .where((F.col("cut") > F.col("__s") + margin_s) & (F.col("cut") < F.col("__e") - margin_s))
    )
    counts = inside.groupBy("call_id", "seg_idx", "__n").agg(F.count("*").alias("__cuts"))
    possible = counts.where((F.col("__cuts") + 1) * least_words <= F.col("__n"))
    listed = (
        inside.join(possible.select("call_id", "seg_idx"), ["call_id", "seg_idx"], "left_semi")
        .groupBy("call_id", "seg_idx")
        .agg(F.sort_array(F.collect_list("cut")).alias("__list"))
    )
    joined = segments.join(listed, ["call_id", "seg_idx"], "left").withColumn("__words", words)
    bounds = F.concat(F.array(s), F.col("__list"), F.array(e))
    at = lambda t: F.floor(
        F.size("__words") * (t - s) / F.greatest(e - s, F.lit(0.01))
    ).cast("int")
    part = F.transform(
        F.sequence(F.lit(0), F.size("__list")),
        lambda i: F.struct(
            F.get(F.col("__bounds"), i).alias("s"), F.get(F.col("__bounds"), i + 1).alias("e"),
            at(F.get(F.col("__bounds"), i)).alias("a"), at(F.get(F.col("__bounds"), i + 1)).alias("b"),
        ),
    )
    whole = F.array(F.struct(s.alias("s"), e.alias("e"), F.lit(0).alias("a"), F.lit(-1).alias("b")))
    fits = F.col("__list").isNotNull() & F.forall(
        F.coalesce(F.col("__parts"), whole), lambda p: p["b"] - p["a"] >= least_words
    )
    cut_text = F.array_join(
        F.slice(F.col("__words"), F.col("__p.a") + 1, F.greatest(F.col("__p.b") - F.col("__p.a"), F.lit(0))), " "
    )
    split = F.col("__p.b") >= 0
    rest = [c for c in segments.columns if c not in ("start_s", "end_s", "text")]
    return (
        joined.withColumn("__bounds", bounds)
        .withColumn("__parts", F.when(F.col("__list").isNotNull(), part))
        .withColumn("__use", F.when(fits, F.col("__parts")).otherwise(whole))
        .select("*", F.posexplode("__use").alias("part_idx", "__p"))
        .select(
            *rest,
            "part_idx",
            F.when(split, F.round("__p.s", 2)).otherwise(s).alias("start_s"),
            F.when(split, F.round("__p.e", 2)).otherwise(e).alias("end_s"),
            F.when(split, cut_text).otherwise(F.col("text")).alias("text"),
        )
    )


def merge_same_speaker(turns: DataFrame, gap_s: float = 0.5) -> DataFrame:
    """Merge consecutive rows of one speaker when the gap to the row before is at most ``gap_s``.

    The merged end is that of the last row, which may lie before an earlier row's end.
    """
    order = ["start_s", "turn_idx"]
    cut = cut_keys(turns, ["call_id"], "start_s")
    linked = scan(
        turns,
        ["call_id"],
        order,
        {"__end": previous(F.col("end_s")), "__speaker": previous(F.col("speaker"))},
        cut,
    )
    joins = (F.col("__speaker") == F.col("speaker")) & (F.col("start_s") - F.col("__end") <= gap_s)
    fresh = F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)
    islands = scan(
        linked.withColumn("__fresh", fresh),
        ["call_id"],
        order,
        {"island": running_sum(F.col("__fresh"))},
        cut,
    )
    return islands.groupBy("call_id", "island").agg(
        F.min_by("speaker", F.struct(*order)).alias("speaker"),
        F.min("start_s").alias("start_s"),
        F.max_by("end_s", F.struct(*order)).alias("end_s"),
        F.count("*").alias("n_turns"),
    )


def merge_blocks(intervals: DataFrame, gap_s: float, pad_before: float = 0.0,
                 pad_after: float | None = None, inclusive: bool = True,
                 by: list[str] = ["call_id"], limit_s: str | None = None) -> DataFrame:
    """Pad the intervals, then merge those overlapping or closer than ``gap_s``.

    The end of a block is the latest end in it. ``limit_s`` names a column (recording length)
    that ends are clipped to.
    """
    pad_after = pad_before if pad_after is None else pad_after
    end = F.col("end_s") + pad_after
    padded = intervals.select(
        *by,
        F.greatest(F.lit(0.0), F.col("start_s") - pad_before).alias("start_s"),
        (F.least(end, F.col(limit_s)) if limit_s else end).alias("end_s"),
    )
    cut = cut_keys(padded, by, "start_s")
    reached = scan(padded, by, ["start_s", "end_s"], {"__reach": max_before(F.col("end_s"))}, cut)
    gap = F.col("start_s") - F.col("__reach")
    joins = gap <= gap_s if inclusive else gap < gap_s
    marked = reached.withColumn("__fresh", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
    islands = scan(
        marked, by, ["start_s", "end_s", "__reach"], {"block": running_sum(F.col("__fresh"))}, cut,
    )
    return islands.groupBy(*by, "block").agg(
        F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"),
        F.count("*").alias("n_intervals"),
    )


def remap_time(blocks: DataFrame) -> DataFrame:
    """Add where every kept block lands once the gaps between blocks are cut out."""
    length = F.col("end_s") - F.col("start_s")
    return scan(
        blocks, ["call_id"], ["start_s", "block"], {"clean_start_s": sum_before(length)},
        cut_keys(blocks, ["call_id"], "start_s"),
    ).withColumn("clean_end_s", F.col("clean_start_s") + length)


def to_clean_time(points: DataFrame, blocks: DataFrame, width: float = BIN_SECONDS) -> DataFrame:
    """Clean time of each point (``time_s``), null for points that were cut out."""
    spans = remap_time(blocks).select(
        "call_id", F.col("start_s").alias("__s"), F.col("end_s").alias("__e"), "clean_start_s",
        _bins(F.col("start_s"), F.col("end_s"), width).alias("__bin"),
    )
    t = F.col("time_s")
    return (
        points.withColumn("__point_bin", _bin(t, width))
        .join(
            spans.withColumnRenamed("call_id", "__call"),
            (F.col("call_id") == F.col("__call")) & (F.col("__point_bin") == F.col("__bin"))
            & (t >= F.col("__s")) & (t < F.col("__e")),
            "left",
        )
        .withColumn("clean_time_s", t - F.col("__s") + F.col("clean_start_s"))
        .select(*points.columns, "clean_time_s")
    )


def sliding_windows(spans: DataFrame, window_s: float, step_s: float, include_last: bool) -> DataFrame:
    """Grid of windows inside each row's ``duration_s``.

    ``include_last`` keeps a window that ends exactly at the end; enrolment leaves it out.
    """
    room = F.col("duration_s") - window_s
    steps = F.round(room / step_s, 9)
    last = F.floor(steps) if include_last else F.ceil(steps) - 1
    fits = F.col("duration_s") >= window_s
    return (
        spans.where(fits & (last >= 0))
        .withColumn("win_idx", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
        .withColumn("win_start_s", F.col("win_idx") * F.lit(step_s))
        .withColumn("win_end_s", F.col("win_start_s") + window_s)
    )


def fixed_chunks(spans: DataFrame, chunk_s: float, least_s: float) -> DataFrame:
    """Consecutive chunks of ``chunk_s``; a tail shorter than ``least_s`` is dropped."""
    last = F.ceil(F.col("duration_s") / chunk_s) - 1
    return (
        spans.where(F.col("duration_s") > 0)
        .withColumn("chunk_idx", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
        .withColumn("chunk_start_s", F.col("chunk_idx") * F.lit(chunk_s))
        .withColumn("chunk_end_s", F.least(F.col("chunk_start_s") + chunk_s, F.col("duration_s")))
        .where(F.round(F.col("chunk_end_s") - F.col("chunk_start_s"), 9) >= least_s)
    )


def group_words_by_speaker(words: DataFrame) -> DataFrame:
    """Consecutive words of one speaker become an utterance; ``words`` has ``word_idx, word``."""
    order = ["word_idx"]
    block = cut_keys(words, ["call_id"], "word_idx")
    linked = scan(words, ["call_id"], order, {"__speaker": previous(F.col("speaker"))}, block)
    fresh = F.when(F.col("__speaker").eqNullSafe(F.col("speaker")), 0).otherwise(1)
    islands = scan(
        linked.withColumn("__fresh", fresh), ["call_id"], order,
        {"utt_idx": running_sum(F.col("__fresh"))}, block,
    )
    spoken = F.sort_array(F.collect_list(F.struct("word_idx", "word")))
    return (
        islands.groupBy("call_id", "utt_idx")
        .agg(
            F.min_by("speaker", "word_idx").alias("speaker"),
            F.min_by("start_s", "word_idx").alias("start_s"),
            F.max_by("end_s", "word_idx").alias("end_s"),
            F.count("*").alias("n_words"),
            F.trim(F.array_join(F.transform(spoken, lambda w: w["word"]), " ")).alias("text"),
        )
        .where(F.col("text") != "")
    )


def speaker_flips(turns: DataFrame, by: list[str] = ["call_id"], order: str = "turn_idx",
                  block: Column | Cut | None = None) -> DataFrame:
    """Speaker changes between neighbouring turns, with the number of turns."""
    block = cut_keys(turns, by, order) if block is None else block
    linked = scan(turns, by, [order], {"__last": previous(F.col("speaker"))}, block)
    flip = (F.col("__last") != F.col("speaker")).cast("bigint")
    return linked.groupBy(*by).agg(
        F.count("*").alias("n_turns"), F.coalesce(F.sum(flip), F.lit(0)).alias("flips")
    )


def pick_clips(blocks: DataFrame, least_s: float = 1.5, most_s: float = 20.0,
               n: int = 10) -> DataFrame:
    """Merged blocks of usable length, longest first, ``n`` per call.

    The row limit per call is applied inside the map tasks, before the shuffle.
    """
    length = F.col("end_s") - F.col("start_s")
    nth = F.row_number().over(Window.partitionBy("call_id").orderBy(F.desc("length_s"), "start_s"))
    return (
        blocks.withColumn("length_s", F.round(length, 6))
        .where(F.col("length_s").between(least_s, most_s))
        .withColumn("nth", nth)
        .where(F.col("nth") <= n)
    )


def number_customers(clusters: DataFrame, label: str = "cluster") -> DataFrame:
    """``Customer n`` and ``SPEAKER_nn`` per cluster of a call, in order of first start."""
    first = clusters.groupBy("call_id", label).agg(F.min("start_s").alias("first_start_s"))
    numbered = scan(
        first, ["call_id"], ["first_start_s", label], {"nth": running_sum(F.lit(1).cast("bigint"))},
        cut_keys(first, ["call_id"], "first_start_s"),
    )
    nth = F.col("nth").cast("string")
    return numbered.withColumn("display_speaker", F.concat(F.lit("Customer "), nth)).withColumn(
        "speaker", F.concat(F.lit("SPEAKER_"), F.when(F.length(nth) < 2, F.lpad(nth, 2, "0")).otherwise(nth))
    )
