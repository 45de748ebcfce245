"""Systems against a reference transcript."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_punct
from ..operators.evaluate import model_ranking
from ..operators.intervals import speaker_flips
from ..operators.words import content_matches, speaker_agreement, spoken_text, with_wer


def compare_transcripts(ref: DataFrame, systems: DataFrame) -> DataFrame:
    """Per system: turns, words, pooled word error rate, speaker flips and right speakers, ranked.

    ``ref`` has ``call_id, turn_idx, speaker, text``; ``systems`` also ``system``.
    """
    text = norm_punct(F.col("text"), True)
    words = lambda c: F.size(F.filter(F.split(F.col(c), " "), lambda w: w != ""))
    truth = spoken_text(ref, ["call_id"], text, "turn_idx").withColumnRenamed("text", "ref")
    said = spoken_text(systems, ["system", "call_id"], text, "turn_idx").withColumnRenamed("text", "hyp")
    squeezed = lambda c: F.trim(F.regexp_replace(c, " +", " "))
    pairs = said.join(truth, "call_id").withColumn("ref", squeezed("ref")).withColumn("hyp", squeezed("hyp"))
    rates = (
        with_wer(pairs, "ref", "hyp")
        .groupBy("system")
        .agg(
            F.sum(words("hyp")).alias("words"),
            F.round(F.sum(F.col("wer") * words("ref")) / F.sum(words("ref")), 6).alias("wer"),
        )
    )
    flips = speaker_flips(systems, ["system", "call_id"]).groupBy("system").agg(
        F.sum("n_turns").alias("turns"), F.sum("flips").alias("flips")
    )
    # turns without a match have no right speaker, so only matched ones are needed
    matched = content_matches(ref, systems, F.split(text, " "), by=("system",))
    right = speaker_agreement(matched, by=("system", "call_id")).groupBy("system").agg(
        F.sum("correct").alias("right_speaker")
    )
    joined = rates.join(flips, "system").join(right, "system", "left").fillna(0, ["right_speaker"])
    return model_ranking(joined.withColumnRenamed("system", "model"))
