"""Byte strings that repeat across documents, found by merging Burrows-Wheeler transforms of shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talktable.llm.common import written

#: bytes worked on at once by the scan
CHUNK = 1 << 20
#: bytes of a shard whose transform is built by sorting, of the shards merged at once, and of a task
SHARD, MERGE, TASK = 1 << 15, 1 << 18, 1 << 21
#: bytes of distinct stretches with one anchor beyond which they are split by window
HOT = 1 << 20


def grams(data: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all ``k`` byte strings of ``data`` (``k`` a power of two), by doubling."""
    with np.errstate(over="ignore"):
        h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        factor, n = np.uint64(0xD6E8FEB86659FD93), 1
        while n < k:
            h = h[:-n] * factor + h[n:]
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            factor = factor * np.uint64(0x9FB21C651E98DF25) | np.uint64(1)
            n *= 2
    return h


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    k = 1
    while 2 * k <= w:
        a = np.minimum(a[:-k], a[k:])
        k *= 2
    return np.minimum(a[:len(a) - (w - k)], a[w - k:]) if k < w else a


def runs(data: np.ndarray, ends: np.ndarray, length: int, k: int):
    """(anchor, start, starts, anchors) of the runs of strings with one anchor in ``data``, documents ending at ``ends``.

    The anchor of a string of ``length`` bytes is the smallest hash of its ``k``-byte strings; equal strings
    have equal anchors. ``anchors`` counts the places of the anchor that the run's strings reach.
    """
    none = np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    if len(data) < length:
        return none
    w = length - k + 1
    h = grams(data, k)
    low = sliding_min(h, w)
    begins = np.concatenate([[0], ends[:-1]])
    inside = np.zeros(len(low) + 1, np.int64)
    whole = ends - begins >= length
    np.add.at(inside, begins[whole], 1)
    np.add.at(inside, ends[whole] - length + 1, -1)
    inside = np.cumsum(inside[:-1]) > 0
    doc = np.searchsorted(ends, np.arange(len(low)), side="right")
    change = np.ones(len(low), bool)
    change[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(change)
    last = np.concatenate([first[1:], [len(low)]])
    keep = inside[first]
    first, last = first[keep], last[keep]
    if not len(first):
        return none
    value = low[first]
    # places of anchors, in order of (hash, place)
    high = sliding_min(np.concatenate([np.full(w - 1, ~np.uint64(0)), ~low, np.full(w - 1, ~np.uint64(0))]), w)
    at = np.flatnonzero(h == ~high)
    known, rank = np.unique(h[at], return_inverse=True)
    span = len(data) + 1
    places = np.sort(rank.astype(np.int64) * span + at)
    mine = np.searchsorted(known, value).astype(np.int64) * span
    count = np.searchsorted(places, mine + last + w - 1) - np.searchsorted(places, mine + first)
    return value, first, last - first, count


def _pieces(batch: pa.RecordBatch, length: int):
    """(row, offset, bytes) in groups of about ``CHUNK`` bytes; long texts are cut with an overlap of length - 1."""
    group, size = [], 0
    for row, value in enumerate(batch.column("_bytes")):
        data = value.as_py()
        if data is None or len(data) < length:
            continue
        for at in range(0, len(data) - length + 1, CHUNK):
            part = data[at:at + CHUNK + length - 1]
            group.append((row, at, part))
            size += len(part)
            if size >= CHUNK:
                yield group
                group, size = [], 0
    if group:
        yield group


def anchored_runs(docs: DataFrame, length: int, k: int) -> DataFrame:
    """(anchor, _key, _hash, start, starts, places) over ``docs`` (_key, _hash, _bytes)."""
    names = ["anchor", "_key", "_hash", "start", "starts", "places"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, hashes = batch.column("_key").to_numpy(), batch.column("_hash").to_numpy()
            for group in _pieces(batch, length):
                ends = np.cumsum([len(part) for _, _, part in group])
                data = np.frombuffer(b"".join(part for _, _, part in group), np.uint8)
                value, first, n, places = runs(data, ends, length, k)
                which = np.searchsorted(ends, first, side="right")
                row = np.array([g[0] for g in group])[which]
                start = first - np.concatenate([[0], ends[:-1]])[which] + np.array([g[1] for g in group])[which]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in (value.view(np.int64), keys[row], hashes[row], start, n, places)], names
                )

    return docs.mapInArrow(run, "anchor long, _key long, _hash long, start long, starts long, places long")


def build_transform(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of ``text`` in order of their first ``depth`` symbols, the symbol before each, and the place of
    the suffix that starts with it (the last-to-first map).

    ``text`` holds strings of symbols from 1 on, each closed by 0. The closing symbols differ, in text order.
    """
    n = len(text)
    # eight symbols make the first key; what follows a closing symbol does not count
    ahead = np.concatenate([text, np.zeros(8, text.dtype)]).astype(np.uint64)
    key, going = np.zeros(n, np.uint64), np.ones(n, bool)
    for j in range(8):
        symbol = ahead[j:j + n]
        key = key << np.uint64(8) | np.where(going, symbol, np.uint64(0))
        going &= symbol != 0
    order = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = (key[order[1:]] != key[order[:-1]]) | ~going[order[1:]]
    # ranks of 16 bits are sorted in linear time
    small = np.uint16 if n <= 1 << 16 else np.int32
    rank, k = np.empty(n, small), 8
    rank[order] = np.cumsum(new) - 1
    while k < depth and not new.all():
        # in the order of what follows k symbols on: first the suffixes that end before
        second = np.concatenate([np.arange(n - k, n), order[order >= k] - k]) if k < n else np.arange(n)
        order = second[np.argsort(rank[second], kind="stable")]
        follows = np.full(n, -1, np.int32)
        follows[:max(0, n - k)] = rank[k:]
        mine, theirs = rank[order], follows[order]
        new = np.ones(n, bool)
        new[1:] = (mine[1:] != mine[:-1]) | (theirs[1:] != theirs[:-1])
        rank = np.empty(n, small)
        rank[order] = np.cumsum(new) - 1
        k *= 2
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    return order, text[order - 1], place[order - 1]


def merge_transforms(transforms: list[tuple[np.ndarray, np.ndarray]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the suffixes that share ``depth`` symbols with another, shard after shard numbered, and their group.

    ``transforms[s]`` is the symbol before each suffix of shard s in its order, and its last-to-first map. The
    interleave says in which order the suffixes of all shards follow each other; it starts as shard after
    shard. In each round the symbols are read off in that order and dealt stably by symbol: the interleave by one
    symbol more. A place whose symbol or block of the round before differs from its neighbour's starts a block,
    and the round in which it first does is its common prefix plus one. A block of one suffix is settled, and so
    is all that is read off from it, so only blocks of several are carried on. No suffix is sorted again and
    no text is read.
    """
    starts = np.cumsum([0] + [len(symbols) for symbols, _ in transforms])
    symbols = np.concatenate([symbols for symbols, _ in transforms])
    before = np.concatenate([last + start for (_, last), start in zip(transforms, starts)]).astype(np.int32)
    entries, block = np.arange(len(symbols), dtype=np.int32), np.zeros(len(symbols), np.int32)
    for _ in range(depth):
        read = symbols[entries]
        # what comes before the start of a string is its closing symbol, which no other suffix starts with
        on = read != 0
        dealt = np.argsort(read[on], kind="stable")
        entries, read, block = before[entries[on]][dealt], read[on][dealt], block[on][dealt]
        new = np.ones(len(entries) + 1, bool)
        new[1:-1] = (read[1:] != read[:-1]) | (block[1:] != block[:-1])
        several = ~(new[:-1] & new[1:])
        entries, block = entries[several], np.cumsum(new[:-1], dtype=np.int32)[several]
        if not len(entries):
            break
    return entries, block


def repeated_starts(stretches: list[bytes], length: int, shard_bytes: int = SHARD):
    """(stretch, offset, class) of all strings of ``length`` bytes that occur more than once in ``stretches``."""
    shards, held, size = [], [], 0
    for i, s in enumerate(stretches):
        held.append(i)
        size += len(s) + 1
        if size >= shard_bytes or i == len(stretches) - 1:
            shards.append(held)
            held, size = [], 0
    transforms, owners, offsets = [], [], []
    for rows in shards:
        # no UTF-8 text has the byte 255, so that symbols from 1 on fit
        text = np.frombuffer(b"\xff".join([stretches[i] for i in rows]) + b"\xff", np.uint8) + np.uint8(1)
        lengths = np.array([len(stretches[i]) + 1 for i in rows])
        owner = np.repeat(np.array(rows), lengths)
        offset = np.arange(len(text)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        order, symbols, before = build_transform(text, length)
        transforms.append((symbols, before))
        owners.append(owner[order])
        offsets.append(offset[order])
    place, group = merge_transforms(transforms, length)
    return np.concatenate(owners)[place], np.concatenate(offsets)[place], group


def _later_spans(table: pa.Table, length: int) -> pa.Table:
    """Spans of strings in the first occurrences of stretches that also start earlier in another or the same one."""
    table = table.sort_by("anchor")
    stretches = table.column("stretch").to_pylist()
    anchors, keys, hashes, start = (table.column(c).to_numpy() for c in ("anchor", "_key", "_hash", "start"))
    # stretches of one anchor are merged together, and others as far as there is room
    sizes = np.cumsum([len(s) + 1 for s in stretches])
    begins = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
    cuts, filled = [0], 0
    for a, b in zip(begins, [*begins[1:], len(stretches)]):
        if sizes[b - 1] - filled > MERGE and a > cuts[-1]:
            cuts.append(int(a))
            filled = sizes[a - 1]
    found = []
    for a, b in zip(cuts, [*cuts[1:], len(stretches)]):
        row, offset, group = repeated_starts(stretches[a:b], length)
        found.append((row + a, offset, group.astype(np.int64) + (a << 32)))
    row, offset, group = (np.concatenate(c) for c in zip(*found))
    place = start[row] + offset
    order = np.lexsort((place, hashes[row], keys[row], group))
    later = np.concatenate([[False], group[order[1:]] == group[order[:-1]]]) if len(order) else np.zeros(0, bool)
    row, place = row[order[later]], place[order[later]]
    order = np.lexsort((place, row))
    row, place = row[order], place[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(row)]]) - 1 if len(first) else first
    return pa.table({"_key": keys[row[first]], "_hash": hashes[row[first]], "start": place[first], "end": place[last] + length})


SPANS = "_key long, _hash long, start long, end long"


def _not_first(found: DataFrame, text_digest: str, firsts: DataFrame) -> DataFrame:
    """Rows of ``found`` other than the first with their digest; ``firsts``: (digest, first), one row each."""
    here = F.struct("_key", "_hash", "start")
    return found.join(firsts.hint("shuffle_hash"), text_digest).where(here != F.col("first"))


def repeated_spans(docs: DataFrame, length: int = 100, k: int = 32) -> DataFrame:
    """(_key, _hash, start, end): spans of ``docs`` (_key, _hash, _bytes) covered by strings that also start earlier.

    1. Each string has an anchor; runs of strings with an anchor that occurs once are dropped. Anchors are
       counted with partial sums, and the runs joined with those that occur again.
    2. The stretches of text of the other runs are cut out. Equal stretches are one, at their first place; all
       strings of its other places start earlier there.
    3. Distinct stretches with one anchor, and those that reach their anchor at several places, are compared by merging transforms of shards, many anchors a task.
       An anchor with more than ``HOT`` bytes of them is split by window instead: equal windows meet by digest,
       and the first of them is a minimum.
    """
    anchors = written(
        anchored_runs(docs, length, k).groupBy("anchor").agg(F.sum("places").alias("n")).where("n > 1").select("anchor")
    )
    again = anchored_runs(docs, length, k).join(anchors.hint("shuffle_hash"), "anchor")
    per_doc = again.groupBy("_key", "_hash").agg(F.collect_set(F.struct("start", "starts", "anchor", "places")).alias("runs"))
    names = ["anchor", "stretch", "_key", "_hash", "start", "places"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(list(zip(names, (pa.int64(), pa.binary(), *[pa.int64()] * 4))))
        for batch in batches:
            for row in range(len(batch)):
                key, of, data = (batch.column(c)[row].as_py() for c in ("_key", "_hash", "_bytes"))
                found = batch.column("runs")[row].values
                start, n, anchor, places = (found.field(c).to_numpy() for c in range(4))
                parts = [data[s:s + m + length - 1] for s, m in zip(start.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), pa.array(parts, pa.binary()), pa.array([key] * len(parts), pa.int64()), pa.array([of] * len(parts), pa.int64()), pa.array(start), pa.array(places)],
                    schema=schema,
                )

    stretches = docs.join(per_doc.hint("shuffle_hash"), ["_key", "_hash"]).select("_key", "_hash", "_bytes", "runs").mapInArrow(
        cut, "anchor long, stretch binary, _key long, _hash long, start long, places long"
    )
    stretches = written(stretches.withColumn("digest", F.unhex(F.md5("stretch"))))
    distinct = written(
        stretches.groupBy("anchor", "digest", "stretch")
        .agg(F.min(F.struct("_key", "_hash", "start")).alias("first"), F.count("*").alias("n"), F.max("places").alias("places"))
    )
    spans = _not_first(
        stretches.select("digest", "_key", "_hash", "start", F.length("stretch").alias("size")), "digest",
        distinct.where("n > 1").select("digest", "first"),
    ).select("_key", "_hash", "start", (F.col("start") + F.col("size")).alias("end"))
    sizes = written(
        distinct.groupBy("anchor").agg(F.count("*").alias("stretches"), F.sum(F.length("stretch")).alias("bytes"), F.max("places").alias("places"))
        .where("stretches > 1 or places > 1").select("anchor", "bytes")
    )
    several = distinct.select("anchor", "stretch", "first.*").join(sizes, "anchor")
    total = sizes.where(F.col("bytes") <= HOT).agg(F.sum("bytes")).first()[0] or 0
    tasks = max(1, -(-total // TASK))
    merged = (
        several.where(F.col("bytes") <= HOT).select("anchor", "stretch", "_key", "_hash", "start", F.pmod(F.xxhash64("anchor"), F.lit(tasks)).alias("task"))
        .groupBy("task").applyInArrow(lambda table: _later_spans(table, length), SPANS)
    )
    windows = written(
        several.where(F.col("bytes") > HOT)
        .select("stretch", "_key", "_hash", "start", F.explode(F.sequence(F.lit(0), F.length("stretch") - length)).alias("o"))
        .select(F.unhex(F.md5(F.expr(f"substring(stretch, o + 1, {length})"))).alias("window"), "_key", "_hash", (F.col("start") + F.col("o")).alias("start"))
    )
    earliest = written(
        windows.groupBy("window").agg(F.min(F.struct("_key", "_hash", "start")).alias("first"), F.count("*").alias("n"))
        .where("n > 1").select("window", "first")
    )
    split = _not_first(windows, "window", earliest).select("_key", "_hash", "start", (F.col("start") + length).alias("end"))
    return spans.unionByName(merged).unionByName(split)


def merge_spans(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching spans."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    first = np.flatnonzero(new)
    return list(zip(start[first].tolist(), end[np.concatenate([first[1:], [len(start)]]) - 1].tolist()))


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, k: int = 32) -> DataFrame:
    """One row per row: ``_key`` (its id), ``n_bytes``, ``spans`` (maximal removed runs) and ``kept`` (bytes left).

    Texts are UTF-8 bytes, null is empty; texts shorter than ``length`` lose nothing. A byte goes if it lies in
    a string of ``length`` bytes that also starts earlier: in a smaller id, or before in the same text. What
    repeats is judged on the input, and overlaps count. Rows of one id and different texts are ordered by a
    hash of the text; rows with equal id and text are one document, so that repeating a row removes nothing.
    Rows with a null id lose nothing and make no other row lose anything. Other columns are not read; an empty
    table gives an empty one. ``k`` is a power of two below ``length``.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("_key"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_bytes")
    ).withColumn("_hash", F.xxhash64("_bytes"))
    long = rows.where(F.col("_key").isNotNull() & (F.length("_bytes") >= length))
    spans = repeated_spans(long, length, k).groupBy("_key", "_hash").agg(F.collect_list(F.struct("start", "end")).alias("_spans"))
    spans = written(spans)
    joined = rows.join(spans.hint("shuffle_hash"), ["_key", "_hash"], "left").select("_key", "_bytes", "_spans")
    names = ["_key", "n_bytes", "spans", "kept"]
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("_key", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(span)), ("kept", pa.binary())])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                sizes, removed, kept = [], [], []
                for data, found in zip(part.column("_bytes"), part.column("_spans")):
                    data, merged = data.as_py(), []
                    if found.values is not None and len(found.values):
                        merged = merge_spans(*(found.values.field(c).to_numpy() for c in range(2)))
                    left, end = [], 0
                    for s, e in merged:
                        left.append(data[end:s])
                        end = e
                    sizes.append(len(data))
                    removed.append([{"start": s, "end": e} for s, e in merged])
                    kept.append(b"".join(left) + data[end:])
                yield pa.RecordBatch.from_arrays(
                    [part.column("_key"), pa.array(sizes, pa.int64()), pa.array(removed, pa.list_(span)), pa.array(kept, pa.binary())], schema=schema
                )

    assert names == schema.names
    return joined.mapInArrow(finish, "_key long, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary")
