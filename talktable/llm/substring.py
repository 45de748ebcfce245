"""Exact removal of lines and passages that repeat across the corpus."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talktable.llm.common import written

_SPACE = re.compile(r"\s+")
#: one place in so many words is a cut, by the words before it
STEP = 4
#: characters of the texts that are looked at together
CHUNK = 1 << 18
#: bits of the table that tells which digests occur again
SIEVE_BITS = 26
#: rows whose texts are cut together
ROWS = 256
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def lines(text: str, separator: str = "\n") -> Iterator[tuple[int, int, str]]:
    """(start, end, normalised form) of each line; ``end`` is that of its separator. Lower case, single spaces."""
    at = 0
    for part in text.split(separator):
        end = min(len(text), at + len(part) + len(separator))
        yield at, end, _SPACE.sub(" ", part).strip().lower()
        at = end


def _lower(text: str) -> bytes:
    """Lower case without a change of length: the few characters whose lower case is longer stay."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c if len(c.lower()) > 1 else c.lower() for c in text)
    return low.encode("utf-8", "surrogatepass")


def passages(texts: list[str], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(text, start, end, digest) of the passages of some texts, which overlap; offsets in characters.

    A place is a cut if the two words before it say so by the sums of their bytes, so a passage has the same cuts inside wherever it
    stands; the ends of the text are cuts, too. From each cut a passage goes to the first cut at least ``least`` words on.
    Its form are its words in lower case with single spaces.
    """
    raw = [_lower(t) for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    begins = np.cumsum([0, *(len(r) + 1 for r in raw[:-1])])
    space = (data == 32) | ((data >= 9) & (data <= 13))
    before = np.concatenate([[True], space[:-1]])
    first, last = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
    n = len(first)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none, []
    text = np.searchsorted(begins, first, side="right") - 1
    sums = np.concatenate([[0], np.cumsum(data, dtype=np.int64)])
    sums = sums[last] - sums[first]
    said = (((sums[:-1] * 31 + sums[1:]) * 2654435761) >> 16) % STEP == 0
    # cuts are numbers of words before them; a text ends where the next begins
    cut = np.zeros(n + 1, bool)
    cut[2:] = np.append(said, False)[:n - 1] & np.append(text[1:] == text[:-1], False)[:n - 1]
    cut[np.flatnonzero(np.diff(text)) + 1] = True
    cut[0] = cut[n] = True
    cuts = np.flatnonzero(cut)
    limit = np.searchsorted(text, text, side="right")
    start = cuts[:-1]
    start = start[start + least <= limit[start]]
    end = cuts[np.searchsorted(cuts, start + least)] - 1
    # offsets in characters from those in bytes, and the form of all words one after another
    chars = np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)
    base = chars[begins[text[start]]] - 1
    kept = ~space | ~before
    place = np.cumsum(kept, dtype=np.int64) - kept
    flat = np.where(space, np.uint8(32), data)[kept].tobytes()
    digest = xxhash.xxh3_128_digest
    digests = [digest(flat[s:e]) for s, e in zip(place[first[start]].tolist(), place[last[end]].tolist())]
    return text[start], chars[first[start]] - 1 - base, chars[last[end] - 1] - base, digests


def _groups(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of about ``CHUNK`` characters."""
    held, size, at = [], 0, 0
    for row, text in enumerate(texts):
        held.append(text.as_py())
        size += len(held[-1])
        if size >= CHUNK:
            yield at, held
            held, size, at = [], 0, row + 1
    if held:
        yield at, held


def unit_digests(docs: DataFrame, id_col: str, text_col: str, min_words: int, min_bytes: int, passage: int, separator: str) -> DataFrame:
    """(_key, _of, start, end, high, low) of each unit: its document and a digest of 128 bits, offsets in characters.

    Units are the lines of at least ``min_words`` words or ``min_bytes`` bytes, and the passages.
    """
    names = ["_key", "_of", "start", "end", "high", "low"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, of = batch.column("_key").to_numpy(), batch.column("_of").to_numpy()
            for at, texts in _groups(batch.column("_text")):
                rows, starts, ends, digests = [], [], [], []
                for row, text in enumerate(texts):
                    for s, e, form in lines(text, separator):
                        data = form.encode("utf-8", "surrogatepass")
                        if data and (form.count(" ") + 1 >= min_words or len(data) >= min_bytes):
                            rows.append(row)
                            starts.append(s)
                            ends.append(e)
                            digests.append(xxhash.xxh3_128_digest(b"line " + data))
                found = passages(texts, passage)
                row = np.concatenate([np.array(rows, np.int64), found[0]]) + at
                high, low = np.frombuffer(b"".join(digests + found[3]), ">i8").reshape(-1, 2).astype(np.int64).T
                start, end = (np.concatenate([np.array(a, np.int64), b]) for a, b in ((starts, found[1]), (ends, found[2])))
                columns = (keys[row], of[row], start, end, np.ascontiguousarray(high), np.ascontiguousarray(low))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("_key"), F.xxhash64(text_col).alias("_of"), F.col(text_col).alias("_text")
    )
    return rows.mapInArrow(run, "_key long, _of long, start long, end long, high long, low long")


def repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 5, min_bytes: int = 32,
                   passage: int = 24, separator: str = "\n") -> DataFrame:
    """(_key, _of, start, end) of each unit that occurs earlier, ranked by (id, offset), and does not overlap its first occurrence.

    The first occurrence of a digest is a minimum, found with map-side partial results; only digests that
    occur again are written. A table of 2^26 bits, whatever the corpus, keeps most other units from being shuffled a second time; the rest are joined
    to the first occurrences, so one frequent line is a skewed join side that Spark splits, not a group.
    """
    every = unit_digests(docs, id_col, text_col, min_words, min_bytes, passage, separator)
    firsts = written(
        every.groupBy("high", "low").agg(F.min(F.struct("_key", "start", "end")).alias("first"), F.count("*").alias("n"))
        .where("n > 1").select("high", "low", "first")
    )
    place, bit = F.col("low").bitwiseAND(F.lit((1 << SIEVE_BITS) - 1)), F.expr("cast(low & 63 AS int)")
    sieve = firsts.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))
    likely = every.join(F.broadcast(sieve), F.shiftright(place, 6) == F.col("at")).where(
        F.call_function("shiftright", F.col("bits"), bit).bitwiseAND(F.lit(1)) == 1
    )
    later = (F.col("_key") > F.col("first._key")) | ((F.col("_key") == F.col("first._key")) & (F.col("start") >= F.col("first.end")))
    return likely.join(firsts, ["high", "low"]).where(later).select("_key", "_of", "start", "end")


def merged(spans) -> list[tuple[int, int]]:
    """Sorted spans (start, end), those that meet put together."""
    out: list[list[int]] = []
    for span in spans:
        if out and span["start"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], span["end"])
        else:
            out.append([span["start"], span["end"]])
    return [tuple(s) for s in out]


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without disjoint sorted spans."""
    kept, at = [], 0
    for start, end in spans:
        kept.append(text[at:start])
        at = end
    return "".join(kept) + text[at:]


def drop_repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 5, min_bytes: int = 32,
                        passage: int = 24, separator: str = "\n", removed: str = "removed") -> DataFrame:
    """``docs`` with repeated lines and passages cut out of ``text_col``, and the column ``removed``: array of (start, end) in the original.

    Units are of two kinds. Lines stand between separators (``"\\n\\n"`` gives paragraphs); case and runs of white space do not matter.
    Lines of fewer than ``min_words`` words and ``min_bytes`` bytes are no units, so blank lines and short headings stay.
    Passages are overlapping strings of ``passage`` words or a few more, whose ends are set by the words around them, so that text
    that is repeated inside other lines has the same passages; about ``STEP`` words at either end of it may be left. The occurrence of a
    unit with the smallest (id, offset) stays, all others go that do not overlap it, lines with their separator; ``removed`` joins what meets.

    Null texts stay null, texts without units and rows with a null id stay as they are; ``removed`` is then empty. Equal rows
    of one id lose the same units and other texts of that id their own; a unit at the same offset of both is no repetition. A column
    of that name is replaced. An empty table gives an empty one.
    """
    span = F.struct("start", "end")
    cuts = written(
        repeated_units(docs, id_col, text_col, min_words, min_bytes, passage, separator).groupBy("_key", "_of").agg(
            F.sort_array(F.collect_set(span)).alias("cuts")
        )
    )
    rows = docs.drop(removed)
    same = (rows[id_col] == cuts["_key"]) & (F.xxhash64(rows[text_col]) == cuts["_of"])
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")

    @F.arrow_udf("text string, removed array<struct<start: bigint, end: bigint>>")
    def rest(texts: pa.Array, cuts: pa.Array) -> pa.Array:
        left, gone = [pa.array([], texts.type)], [pa.array([], _SPANS)]
        for at in range(0, len(texts), ROWS):
            spans = [merged(c) for c in cuts.slice(at, ROWS).to_pylist()]
            left.append(pa.array([t if t is None else without(t, s) for t, s in zip(texts.slice(at, ROWS).to_pylist(), spans)], texts.type))
            gone.append(pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], _SPANS))
        return pa.StructArray.from_arrays([pa.concat_arrays(left), pa.concat_arrays(gone)], ["text", "removed"])

    made = rest(rows[text_col], F.coalesce(cuts["cuts"], none))
    kept = [made["text"].alias(c) if c == text_col else rows[c] for c in rows.columns]
    return rows.join(cuts, same, "left").select(*kept, made["removed"].alias(removed))
