"""Clock strings and names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let


def _number(text: Column) -> Column:
    return F.when(text.rlike(r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"), text.try_cast("double"))


def _whole(text: Column) -> Column:
    return F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), text.try_cast("double"))


def to_seconds(value: Column, minutes: bool = True) -> Column:
    """Number, ``H:M:S``, ``M:S`` or text to seconds; what cannot be read is 0.0.

    ``minutes=False`` is the reader that knows no ``M:S`` and takes fractions in every part.
    """
    text = F.trim(value.cast("string"))
    parts = F.split(text, ":")
    count = F.size(parts)
    head = _whole if minutes else _number
    hms = head(parts[0]) * 3600 + head(parts[1]) * 60 + _number(parts[2])
    ms = _whole(parts[0]) * 60 + _number(parts[1])
    read = F.when(count == 3, hms)
    if minutes:
        read = read.when(count == 2, ms)
    read = read.when(count == 1, _number(text))
    return F.coalesce(read, F.lit(0.0))


def _two(n: Column) -> Column:
    text = n.cast("bigint").cast("string")
    return F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)


def clock_millis(seconds: Column) -> Column:
    """``HH:MM:SS.mmm``, negatives shown as zero."""
    millis = F.round(F.greatest(seconds, F.lit(0.0)) * 1000).cast("bigint")
    whole = F.floor(millis / 1000)
    return F.concat(
        _two(F.floor(whole / 3600)), F.lit(":"), _two(F.floor(whole / 60) % 60), F.lit(":"),
        _two(whole % 60), F.lit("."), F.lpad((millis % 1000).cast("string"), 3, "0"),
    )


def clock_short(seconds: Column) -> Column:
    """``MM:SS`` below one hour, else ``HH:MM:SS``."""
    whole = F.floor(F.greatest(seconds, F.lit(0.0)))
    tail = F.concat(_two(F.floor(whole / 60) % 60), F.lit(":"), _two(whole % 60))
    hours = F.floor(whole / 3600)
    return F.when(hours > 0, F.concat(_two(hours), F.lit(":"), tail)).otherwise(tail)


def clock_minutes(seconds: Column) -> Column:
    """``MM:SS`` with minutes running past 59."""
    whole = F.floor(F.greatest(seconds, F.lit(0.0)))
    return F.concat(_two(F.floor(whole / 60)), F.lit(":"), _two(whole % 60))


def slug(name: Column) -> Column:
    return F.regexp_replace(
        F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", ""
    )


def clean_agent_name(name: Column) -> Column:
    """``agent_`` dropped, underscores to spaces, a capital after everything that is no letter."""
    bare = F.replace(F.replace(name, F.lit("agent_"), F.lit("")), F.lit("_"), F.lit(" "))

    def titled(chars):
        inside = lambda i: (i > 0) & F.get(chars, i - 1).rlike(r"\p{L}")
        return F.array_join(
            F.transform(chars, lambda c, i: F.when(inside(i), F.lower(c)).otherwise(F.upper(c))), ""
        )

    return let(F.split(bare, ""), titled)


def names_match(identified: Column, expected: Column) -> Column:
    """Equal, containing or contained, after lower case and spaces to underscores."""
    a = F.replace(F.lower(F.coalesce(identified, F.lit(""))), F.lit(" "), F.lit("_"))
    b = F.replace(F.lower(F.coalesce(expected, F.lit(""))), F.lit(" "), F.lit("_"))
    return (a != "") & (b != "") & ((a == b) | F.contains(a, b) | F.contains(b, a))


def contains_agent(name: Column, wanted: str) -> Column:
    return F.contains(F.lower(F.coalesce(name, F.lit(""))), F.lit(wanted.lower()))


def is_agent_label(label: Column, mode: str = "trimmed") -> Column:
    """Whether a truth label names the agent; the four readings differ on blanks and case."""
    text = F.coalesce(label, F.lit(""))
    if mode == "trimmed":
        trimmed = F.trim(text)
        return (trimmed != "") & (F.lower(trimmed) != "customer")
    if mode == "exact":
        return (text != "") & (text != "Customer")
    if mode == "suffix":
        base = F.when(text.rlike(r"_\d+$"), F.split(text, "_")[0]).otherwise(text)
        return ~F.startswith(F.lower(base), F.lit("customer"))
    if mode == "contains":
        return ~F.contains(F.lower(text), F.lit("customer"))
    raise ValueError(mode)
