"""Stretches of a text that repeat with a fixed period, found by longest common extensions on suffix trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: rows taken from an Arrow batch at a time, so that only their results are held
ROWS = 256


class SuffixTree:
    """Ukkonen's tree of ``symbols`` (1 and up) and a closing 0, toured for constant-time common extensions."""

    def __init__(self, symbols: list[int]):
        text = [*symbols, 0]
        self._grow(text, max(text) + 1)
        self._tour(len(text))

    def _grow(self, text: list[int], base: int) -> None:
        """Edges ``node * base + first symbol -> child``; an edge of a child reads text[start:end]."""
        n = len(text)
        starts, ends, links, edges = [0], [0], [0], {}
        node = edge = length = waiting = 0
        for i, symbol in enumerate(text):
            waiting += 1
            inner = 0  # the node made last, whose suffix link is not known yet
            while waiting:
                if not length:
                    edge = i
                key = node * base + text[edge]
                child = edges.get(key)
                if child is None:
                    edges[key] = len(starts)
                    starts.append(i)
                    ends.append(n)
                    links.append(0)
                    if inner:
                        links[inner] = node
                    inner = node
                else:
                    at = starts[child]
                    span = ends[child] - at
                    if length >= span:
                        node = child
                        edge += span
                        length -= span
                        continue
                    if text[at + length] == symbol:
                        if inner:
                            links[inner] = node
                        length += 1
                        break
                    split = len(starts)
                    starts += (at, i)
                    ends += (at + length, n)
                    links += (0, 0)
                    edges[key] = split
                    edges[split * base + symbol] = split + 1
                    starts[child] = at + length
                    edges[split * base + text[at + length]] = child
                    if inner:
                        links[inner] = split
                    inner = split
                waiting -= 1
                if node:
                    node = links[node]
                elif length:
                    length -= 1
                    edge = i - waiting + 1
        self._starts, self._ends, self._edges, self._base = starts, ends, edges, base

    def _tour(self, n: int) -> None:
        """Tour of the tree with children in symbol order: ``rank`` of each suffix, and range minima of what lies between leaves.

        The shallowest node that the tour passes between two leaves is their lowest common ancestor, and its depth
        their common extension.
        """
        keys = np.fromiter(self._edges.keys(), np.int64, len(self._edges))
        order = np.argsort(keys)
        children = np.fromiter(self._edges.values(), np.int64, len(keys))[order].tolist()
        owners = keys[order] // self._base
        bounds = np.searchsorted(owners, np.arange(len(self._starts) + 1)).tolist()
        starts, ends = self._starts, self._ends
        suffixes, between = [], []
        stack = [(0, 0, 0)]  # node, depth of its parent, depth of the ancestor it shares with the leaf before it
        while stack:
            node, above, shared = stack.pop()
            first, last = bounds[node], bounds[node + 1]
            depth = above + ends[node] - starts[node]
            if first == last:
                suffixes.append(n - depth)
                between.append(shared)
                continue
            for at in range(last - 1, first, -1):
                stack.append((children[at], depth, depth))
            stack.append((children[first], depth, shared))
        self.rank = np.empty(n, np.int64)
        self.rank[suffixes] = np.arange(n)
        table = [np.array(between, np.int32)]
        while 2 << (len(table) - 1) <= n:
            half = 1 << (len(table) - 1)
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        self._table = table
        del self._starts, self._ends, self._edges

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes that start at ``i`` and ``j`` (different)."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b)
        level = np.log2(high - low + 1).astype(np.int64)
        found = np.empty(len(a), np.int64)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            row = self._table[k]
            found[at] = np.minimum(row[low[at]], row[high[at] - (1 << k) + 1])
        return found


def _next_smaller(rank: list[int]) -> list[int]:
    """For each place the next one of smaller rank, or the length."""
    found, stack = [len(rank)] * len(rank), []
    for i, r in enumerate(rank):
        while stack and rank[stack[-1]] > r:
            found[stack.pop()] = i
        stack.append(i)
    return found


def runs_of(symbols: list[int], min_length: int, min_exponent: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of ``symbols`` by start, then period.

    A run holds its Lyndon root for one of the two orders of the symbols: at some place, the longest Lyndon word that starts
    there, which ends where the next smaller suffix begins, is as long as the period. Each such word is extended both ways,
    by the tree of the symbols and that of their reversal.
    """
    n = len(symbols)
    ahead = SuffixTree(symbols)
    at, period = [], []
    for rank in (ahead.rank, -ahead.rank):
        lyndon = np.array(_next_smaller(rank.tolist())[:n], np.int64) - np.arange(n)
        fits = np.flatnonzero((lyndon * min_exponent <= n) & (np.arange(n) + lyndon < n))
        at.append(fits)
        period.append(lyndon[fits])
    at, period = np.concatenate(at), np.concatenate(period)
    if not len(at):
        return []
    back = SuffixTree(symbols[::-1])
    left = back.extension(n - at, n - at - period)
    length = left + period + ahead.extension(at, at + period)
    kept = length >= np.maximum(min_length, min_exponent * period)
    found = np.unique(np.stack([(at - left)[kept], period[kept], length[kept]], axis=1), axis=0)
    return [(start, size, p) for start, p, size in found.tolist()]


def _repeating(symbols: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Stretches (start, end) covered by strings of ``width`` symbols that occur more than once; the rest cannot be in a run.

    Of a run of length m and period q the strings that start in its first m - q - width + 1 and its last places recur, and
    cover it, as m is 2 q or more. Hashes stand for the strings: equal ones of different strings only make a stretch longer.
    """
    if len(symbols) <= width:
        return []
    hashes, size = symbols.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03), 1
    for bit in bin(width)[3:]:
        for grow in ([size, 1] if bit == "1" else [size]):
            more = hashes[grow:] if grow == size else symbols[size:].astype(np.uint64)
            hashes = (hashes[:len(more)] ^ (hashes[:len(more)] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + more
            size += grow
    _, where, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    again = np.flatnonzero(counts[where] > 1)
    if not len(again):
        return []
    cuts = np.flatnonzero(np.diff(again) > width)
    firsts, lasts = again[np.append(0, cuts + 1)], again[np.append(cuts, len(again) - 1)] + width
    return list(zip(firsts.tolist(), lasts.tolist()))


def text_runs(words: list[bytes], min_length: int = 24, min_exponent: int = 3) -> tuple[list[tuple[int, int, int]], list[bytes]]:
    """Runs (start, length, period) of a list of words, and the words without what repeats in a run."""
    if len(words) < min_length:
        return [], words
    seen: dict[bytes, int] = {}
    symbols = [seen.setdefault(w, len(seen) + 1) for w in words]
    # words a period apart are equal along at least this much of the shortest run
    width = min_length - min_length // min_exponent
    found = []
    for start, end in _repeating(np.array(symbols, np.int64), width):
        if end - start >= min_length:
            numbers: dict[int, int] = {}
            part = [numbers.setdefault(s, len(numbers) + 1) for s in symbols[start:end]]
            found += [(start + s, n, p) for s, n, p in runs_of(part, min_length, min_exponent)]
    if not found:
        return [], words
    found.sort(key=lambda r: (r[0], r[2]))
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    return found, [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 24, min_exponent: int = 3) -> DataFrame:
    """One row per row of ``docs``: ``_key`` (its id), ``n_words``, ``runs``, ``collapsed``.

    Words are runs without ASCII white space, numbered from 0, and compared as they are. ``runs`` lists (start, length, period)
    of all maximal stretches of at least ``min_length`` words and ``min_exponent`` (2 or more) smallest periods, by start,
    then period. ``collapsed`` joins by single spaces the words that no run contains after its first period.

    The whole text is one task's work: about 800 bytes of memory for each word of its longest stretch of repeated strings.
    A null, empty or blank text has no words, no runs and an empty ``collapsed``. Each of several rows with the same id or
    text gets its own row; a null id stays null. Other columns are not read; an empty table gives an empty one.
    """
    if min_exponent < 2 or min_length < min_exponent:
        raise ValueError("a run has at least two periods of one word")
    item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                sizes, runs, texts = [], [], []
                for text in part.column("_text"):
                    words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                    found, kept = text_runs(words, min_length, min_exponent)
                    sizes.append(len(words))
                    runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                    texts.append(b" ".join(kept).decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays([
                    part.column("_key"), pa.array(sizes, pa.int64()), pa.array(runs, pa.list_(item)), pa.array(texts, pa.string()),
                ], ["_key", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).cast("long").alias("_key"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, "_key long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
