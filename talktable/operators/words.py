"""Word error rate and content matching of transcripts."""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: bytes of the bit masks of one reference that are kept between its columns
MASK_BYTES = 8 << 20


def word_distance(ref: list[str], hyp: list[str]) -> int:
    """Word edits between two texts, with one bit per reference word (bit-parallel columns).

    A common head and tail are cut off first. Masks of the most frequent words are kept within ``MASK_BYTES``, others are made from
    their positions where they are needed, so memory grows with the words and not with their square.
    """
    head, least = 0, min(len(ref), len(hyp))
    while head < least and ref[head] == hyp[head]:
        head += 1
    tail = 0
    while tail < least - head and ref[-1 - tail] == hyp[-1 - tail]:
        tail += 1
    ref, hyp = ref[head:len(ref) - tail], hyp[head:len(hyp) - tail]
    if not ref or not hyp:
        return max(len(ref), len(hyp))
    where: dict[str, list[int]] = {}
    for i, word in enumerate(ref):
        where.setdefault(word, []).append(i)
    size = len(ref) // 8 + 1
    room = MASK_BYTES // size
    often = where if len(where) <= room else set(heapq.nlargest(room, where, key=lambda w: len(where[w])))
    kept: dict[str, int] = {}

    def mask(word: str) -> int:
        found = kept.get(word)
        if found is None:
            bits = bytearray(size)
            for i in where[word]:
                bits[i >> 3] |= 1 << (i & 7)
            found = int.from_bytes(bits, "little")
            if word in often:
                kept[word] = found
        return found

    full, top = (1 << len(ref)) - 1, 1 << (len(ref) - 1)
    plus, minus, distance = full, 0, len(ref)
    for word in hyp:
        equal = mask(word) if word in where else 0
        vertical = equal | minus
        horizontal = (((equal & plus) + plus) ^ plus) | equal
        up = minus | (full & ~(horizontal | plus))
        down = plus & horizontal
        distance += bool(up & top) - bool(down & top)
        up, down = (up << 1) | 1, down << 1
        plus = (down | ~(vertical | up)) & full
        minus = up & vertical & full
    return distance


_ERRORS = T.StructType([T.StructField(name, T.LongType()) for name in ("edits", "ref_words", "hyp_words")])


@F.arrow_udf(_ERRORS)
def _distance(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    """One pair at a time is taken out of the batch and into words; Spark bounds the batch in bytes."""
    found: list[list[int]] = [[], [], []]
    for r, h in zip(ref, hyp):
        r, h = r.as_py().split(), h.as_py().split()
        for column, n in zip(found, (word_distance(r, h), len(r), len(h))):
            column.append(n)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in found], _ERRORS.names)


def word_errors(ref: Column, hyp: Column) -> Column:
    """Word edits between two texts and the words of both; whole texts, words are parted by any white space."""
    return _distance(F.coalesce(ref, F.lit("")), F.coalesce(hyp, F.lit("")))


def with_wer(pairs: DataFrame, ref: str, hyp: str, name: str = "wer") -> DataFrame:
    """Edits per reference word; an empty reference gives 1 if the hypothesis has words, else 0."""
    e = lambda part: F.col("__errors")[part]
    rate = F.when(e("ref_words") == 0, F.when(e("hyp_words") > 0, 1.0).otherwise(0.0)).otherwise(
        e("edits") / e("ref_words")
    )
    return pairs.withColumn("__errors", word_errors(F.col(ref), F.col(hyp))).withColumn(
        name, F.round(rate, 6)
    ).drop("__errors")


def spoken_text(turns: DataFrame, by: list[str], text: Column, order: str) -> DataFrame:
    """Texts of a group joined in order."""
    parts = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t"))))
    return turns.groupBy(*by).agg(F.array_join(F.transform(parts, lambda p: p["t"]), " ").alias("text"))


def role_wer(ref: DataFrame, hyp: DataFrame) -> DataFrame:
    """Word error rate per call over all, agent and customer speech.

    Both sides have ``call_id, turn_idx, role, text``; texts are normalised to words first.
    """
    from ..functions.text import norm_text

    def sides(turns, name):
        cleaned = turns.withColumn("__t", norm_text(F.col("text")))
        both = F.explode(F.array(F.lit("FULL"), F.col("role")))
        return spoken_text(
            cleaned.withColumn("part", both), ["call_id", "part"], F.col("__t"), "turn_idx"
        ).withColumnRenamed("text", name)

    joined = sides(ref, "ref").join(sides(hyp, "hyp"), ["call_id", "part"], "left")
    squeezed = lambda c: F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), " +", " "))
    ready = joined.withColumn("ref", squeezed("ref")).withColumn("hyp", squeezed("hyp"))
    return with_wer(ready, "ref", "hyp").groupBy("call_id").agg(
        *[F.max(F.when(F.col("part") == p, F.col("wer"))).alias(n) for p, n in
          (("FULL", "wer_full"), ("AGENT", "wer_agent"), ("CUSTOMER", "wer_customer"))]
    )


def shared_words(a: Column, b: Column) -> Column:
    """Distinct words two texts have in common."""
    return F.array_intersect(a, b)


def content_matches(ref: DataFrame, hyp: DataFrame, words: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Reference turns that share words with a turn of the same call, with the best one.

    ``by`` names columns of ``hyp``, such as the system: each of their values is matched apart. Empty words
    are not shared.
    """
    def exploded(turns, tag, *more):
        return turns.select(
            *more, "call_id", F.col("turn_idx").alias(f"{tag}_idx"), F.col("speaker").alias(f"{tag}_speaker"),
            F.explode(F.filter(F.array_distinct(words), lambda w: w != "")).alias("word"),
        )

    shared = (
        exploded(ref, "ref").join(exploded(hyp, "hyp", *by), ["call_id", "word"])
        .groupBy(*by, "call_id", "ref_idx", "ref_speaker", "hyp_idx", "hyp_speaker")
        .agg(F.count("*").alias("shared"))
    )
    rank = F.struct(F.col("shared"), -F.col("hyp_idx"))
    return shared.groupBy(*by, "call_id", "ref_idx", "ref_speaker").agg(
        F.max_by("hyp_idx", rank).alias("hyp_idx"),
        F.max_by("hyp_speaker", rank).alias("hyp_speaker"),
        F.max("shared").alias("shared"),
    )


def best_content_match(ref: DataFrame, hyp: DataFrame, words: Column) -> DataFrame:
    """Each reference turn with the hypothesis turn sharing most distinct words, if any does.

    Both sides have ``call_id, turn_idx, speaker`` and the columns ``words`` is built from. Turns
    meet only through words they share, never as all pairs; among equals the first turn wins.
    """
    best = content_matches(ref, hyp, words).drop("ref_speaker")
    turns = ref.select("call_id", F.col("turn_idx").alias("ref_idx"), F.col("speaker").alias("ref_speaker"))
    return turns.join(best, ["call_id", "ref_idx"], "left")


def speaker_agreement(matches: DataFrame, first: str = "A", second: str = "B",
                      by: tuple[str, ...] = ("call_id",)) -> DataFrame:
    """Turns per call with the right speaker, taking the better of direct and swapped labels."""
    h = F.col("hyp_speaker")
    swapped = F.when(h == first, second).when(h.isNotNull(), first)
    hits = lambda label: F.sum(F.coalesce((label == F.col("ref_speaker")).cast("bigint"), F.lit(0)))
    return matches.groupBy(*by).agg(
        F.count("*").alias("turns"), hits(h).alias("direct"), hits(swapped).alias("swapped")
    ).withColumn("correct", F.greatest("direct", "swapped"))
