"""Transcript text rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import phrases
from .binding import let


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def norm_words(text: Column) -> Column:
    """Lower-case tokens of letters a-z, digits and apostrophes."""
    return F.regexp_extract_all(F.lower(_text(text)), F.lit("([a-z0-9']+)"), F.lit(1))


def norm_text(text: Column) -> Column:
    return F.array_join(norm_words(text), " ")


def norm_punct(text: Column, keep_gap: bool) -> Column:
    """Lower case without punctuation, which becomes a space (``keep_gap``) or nothing."""
    bare = F.regexp_replace(F.lower(_text(text)), r"(?U)[^\p{L}\p{N}_\s]", " " if keep_gap else "")
    return F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))


def split_words(text: Column) -> Column:
    """Whitespace tokens, none for blank text."""
    return F.filter(F.split(_text(text), r"(?U)\s+"), lambda w: w != "")


def looks_like_question(text: Column) -> Column:
    first = F.coalesce(F.get(norm_words(text), F.lit(0)), F.lit(""))
    return F.contains(_text(text), F.lit("?")) | first.isin(phrases.QUESTION_STARTS)


def short_customer_reply(text: Column) -> Column:
    words = norm_words(text)
    count = F.size(words)
    single = (count == 1) & (F.length(F.coalesce(F.get(words, F.lit(0)), F.lit(""))) <= 16)
    return (count >= 1) & (count <= 3) & (norm_text(text).isin(phrases.SHORT_REPLIES) | single)


def agent_phrase(text: Column) -> Column:
    return norm_text(text).isin(phrases.AGENT_PHRASES)


def farewell(text: Column) -> Column:
    return F.replace(norm_text(text), F.lit("bye bye"), F.lit("bye-bye")).isin(phrases.FAREWELLS)


def backchannel_start(text: Column, most_words: int = 15) -> Column:
    words = norm_words(text)
    first = F.coalesce(F.get(words, F.lit(0)), F.lit(""))
    return (F.size(words) <= most_words) & first.isin(phrases.BACKCHANNEL_STARTS)


def top_word_count(words: Column) -> Column:
    """Count of the most frequent word: longest run of the sorted list, so n log n and not n²."""

    def runs(ordered):
        starts = F.filter(
            F.sequence(F.lit(0), F.size(ordered) - 1),
            lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)),
        )
        return F.concat(starts, F.array(F.size(ordered)))

    def longest(starts):
        return F.array_max(
            F.transform(
                F.sequence(F.lit(0), F.size(starts) - 2),
                lambda i: F.get(starts, i + 1) - F.get(starts, i),
            )
        )

    counted = let(F.sort_array(words), lambda w: let(runs(w), longest))
    return F.when(F.size(words) > 0, counted).otherwise(F.lit(0))


def repeats_in_a_row(words: Column, times: int) -> Column:
    """Whether some word stands ``times`` times in a row."""

    def found(w):
        last = F.size(w) - times
        return (last >= 0) & F.exists(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
            lambda i: F.forall(
                F.sequence(F.lit(1), F.lit(times - 1)), lambda j: F.get(w, i + j) == F.get(w, i)
            ),
        )

    return let(words, found)


def is_hallucination(text: Column, share: float = 0.45, in_a_row: int = 4) -> Column:
    """Punctuation only, or at least six words with one dominating or repeating in a row."""
    bare = F.regexp_replace(_text(text), r"[^\p{L}\p{N}_]", "")

    def looping(words):
        # a dominating word leaves few other words, which is cheaper to see
        few = F.size(F.array_distinct(words)) - 1 < (1 - share) * F.size(words)
        dominant = few & (top_word_count(words) / F.size(words) > share)
        return (F.size(words) >= 6) & (dominant | repeats_in_a_row(words, in_a_row))

    return (bare == "") | let(split_words(F.lower(_text(text))), looping)


def _longer(phrases: Column, words: Column, n: Column) -> Column:
    """Phrases of one word more: each with the word after it, ``n`` words on."""
    count = F.greatest(F.size(words) - n, F.lit(0))
    return F.zip_with(F.slice(phrases, F.lit(1), count), F.slice(words, n + 1, count), lambda p, w: F.concat_ws(" ", p, w))


def _first_repeat(phrases: Column, distinct: Column) -> Column:
    """Position of the first phrase that has occurred before: there the distinct phrases leave the order of all."""
    same = F.zip_with(distinct, F.slice(phrases, F.lit(1), F.size(distinct)), lambda a, b: a == b)
    differs = F.array_position(same, False)
    return F.when(differs > 0, differs - 1).otherwise(F.size(distinct).cast("bigint")).cast("int")


def _cut(words: Column, phrases: Column, n: int, most: int) -> Column:
    """First repeat among the longest phrases of ``n`` to ``most`` words that repeat at all, null if none does.

    A longer phrase repeats only where its beginning does, so longer ones are made only where shorter ones repeat.
    """
    def decide(distinct):
        own = _first_repeat(phrases, distinct)
        if n < most:
            own = F.coalesce(let(_longer(phrases, words, F.lit(n)), lambda p: _cut(words, p, n + 1, most)), own)
        return F.when(F.size(distinct) < F.size(phrases), own)

    return let(F.array_distinct(phrases), decide)


def truncate_repetition(text: Column) -> Column:
    """Cut a text before its first repeated phrase.

    Phrases of 5, 4, 3, then 2 words are tried; a head of fewer than four words becomes blank.
    Without a repeat, a text whose words are mostly the same becomes blank. Texts under eight
    words stay.
    """

    def cleaned(words):
        cut = let(_longer(words, words, F.lit(1)), lambda pairs: _cut(words, pairs, 2, 5))
        unique = F.size(F.array_distinct(words)) / F.size(words)
        return let(
            cut,
            lambda c: F.when(c >= 4, F.array_join(F.slice(words, F.lit(1), c), " "))
            .when(c.isNotNull(), "")
            .when(unique < 0.35, "")
            .otherwise(text),
        )

    return let(split_words(text), lambda w: F.when(F.size(w) < 8, text).otherwise(cleaned(w)))


def keyword_hits(text: Column, keywords: list[str]) -> Column:
    """How many of ``keywords`` occur in the text."""
    lowered = F.lower(_text(text))
    hits = F.lit(0)
    for word in keywords:
        hits = hits + F.contains(lowered, F.lit(word)).cast("int")
    return hits
