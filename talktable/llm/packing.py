"""Documents as token sequences of a fixed length, by bounded-space best-fit packing."""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talktable.llm.common import written
from talktable.storage import materialize

SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
    ("ids", pa.binary()), ("task", pa.int64()), ("open", pa.bool_()),
])
DDL = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
       "ids binary, task long, open boolean")
#: tasks whose leftovers one task of the next level merges
FAN_IN = 64
_ENCODERS: dict = {}


#: Fixed value: what the tokenizer's file names as its pre-token rule, "byte level with its own pattern".
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_pieces(vocabulary: dict[str, int]) -> dict[bytes, int]:
    """Pieces as bytes. In the file, bytes that cannot be printed are written as characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain}
    byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    return {bytes(byte_of[c] for c in piece): i for piece, i in vocabulary.items() if all(c in byte_of for c in piece)}


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit values, from the definition of a byte-level tokenizer.

    Pre-tokens never hold a space inside, and a space before a character that is not white space starts one.
    So a text may be cut at such spaces, and each piece keeps its ids; they are remembered for ``remember`` to twice as many
    pieces, those met of late. Texts in which a space meets other white space are encoded whole. With ``added`` the file's added
    tokens are found in a text first and cut it, as the tokenizer's own library does; without, their names are ordinary text.
    """

    _ODD = re.compile(r" (?:\s|$)")

    def __init__(self, definition: str, remember: int = 1 << 16, added: bool = False):
        import tiktoken

        model = json.loads(definition)
        special = {t["content"] for t in model.get("added_tokens", ()) if t.get("special")}
        pieces = byte_pieces({p: i for p, i in model["model"]["vocab"].items() if p not in special})
        coder = tiktoken.Encoding("bytes", pat_str=PRE_TOKENS, mergeable_ranks=pieces, special_tokens={})
        self._ids = coder.encode_ordinary
        self.remember = remember
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        found = model.get("added_tokens", ()) if added else ()
        if any(t.get(flag) for t in found for flag in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that take white space or whole words only are not supported")
        self.added = {t["content"]: struct.pack("<I", t["id"]) for t in found}
        self._cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if found else None

    def _encode(self, text: str) -> bytes:
        ids = self._ids(text)
        return struct.pack(f"<{len(ids)}I", *ids)

    def __call__(self, text: str) -> bytes:
        if self._cut is None or not self._cut.search(text):
            return self._plain(text)
        return b"".join(self.added[part] if part in self.added else self._plain(part) for part in self._cut.split(text) if part)

    def _plain(self, text: str) -> bytes:
        if self._ODD.search(text):
            return self._encode(text)
        first, *rest = text.split(" ")
        known, out = self.known, []
        for word in rest:
            ids = known.get(word)
            if ids is None:
                ids = self.older.get(word) or self._encode(" " + word)
                if len(word) <= 64:
                    if len(known) >= self.remember:
                        self.older, self.known = known, {}
                        known = self.known
                    known[word] = ids
            out.append(ids)
        return (self._encode(first) if first else b"") + b"".join(out)


def _encoder(definition: str, added: bool) -> Encoder:
    """One encoder per Python worker."""
    key = zlib.crc32(definition.encode()), added
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(definition, added=added)
    return _ENCODERS[key]


class Packer:
    """At most ``open_limit`` windows that take pieces, best fit first.

    A piece goes whole into the open window it leaves least room in. If none has room and the limit is
    reached, the fullest is filled with the head of the piece and closed, and the rest is placed anew. What
    fills a window alone never enters one.
    """

    def __init__(self, size: int, open_limit: int, first_id: int):
        self.size, self.open_limit, self.next_id = size, open_limit, first_id
        self.windows: list[tuple[list, int]] = []
        self.closed: list[tuple] = []

    def _close(self, pieces: list) -> None:
        at = 0
        for doc_id, start, ids, doc_tokens in pieces:
            self.closed.append((doc_id, start, ids, doc_tokens, self.next_id, at))
            at += len(ids) // 4
        self.next_id += 1

    def add(self, doc_id: int | None, start: int, ids: bytes, doc_tokens: int) -> None:
        view, size = memoryview(ids), self.size
        while len(view) >= 4 * size:
            self._close([(doc_id, start, view[:4 * size], doc_tokens)])
            view, start = view[4 * size:], start + size
        while len(view):
            n = len(view) // 4
            fits = [(size - used, i) for i, (_, used) in enumerate(self.windows) if size - used >= n]
            if fits:
                room, i = min(fits)
                pieces, used = self.windows[i]
                pieces.append((doc_id, start, bytes(view), doc_tokens))
                if room == n:
                    self._close(pieces)
                    self.windows.pop(i)
                else:
                    self.windows[i] = (pieces, used + n)
                return
            if len(self.windows) < self.open_limit:
                self.windows.append(([(doc_id, start, bytes(view), doc_tokens)], n))
                return
            i = max(range(len(self.windows)), key=lambda j: (self.windows[j][1], -j))
            pieces, used = self.windows.pop(i)
            room = size - used
            pieces.append((doc_id, start, bytes(view[:4 * room]), doc_tokens))
            self._close(pieces)
            view, start = view[4 * room:], start + room

    def drain(self) -> None:
        """Close what is open without padding: full windows, then windows of a power of two."""
        left = [p for pieces, _ in self.windows for p in pieces]
        total = sum(len(p[2]) for p in left) // 4
        self.windows = []
        while total:
            goal = self.size if total >= self.size else 1 << (total.bit_length() - 1)
            total -= goal
            taken = []
            while goal:
                doc_id, start, ids, doc_tokens = left.pop(0)
                n = min(goal, len(ids) // 4)
                taken.append((doc_id, start, ids[:4 * n], doc_tokens))
                if 4 * n < len(ids):
                    left.insert(0, (doc_id, start + n, ids[4 * n:], doc_tokens))
                goal -= n
            self._close(taken)

    def rows(self, keep_ids: bool) -> pa.RecordBatch:
        closed, self.closed = self.closed, []
        return pa.RecordBatch.from_arrays([
            pa.array([c[0] for c in closed], pa.int64()), pa.array([c[1] for c in closed], pa.int64()),
            pa.array([len(c[2]) // 4 for c in closed], pa.int64()), pa.array([zlib.crc32(c[2]) for c in closed], pa.int64()),
            pa.array([c[3] for c in closed], pa.int64()), pa.array([c[4] for c in closed], pa.int64()),
            pa.array([c[5] for c in closed], pa.int64()), pa.array([bytes(c[2]) if keep_ids else None for c in closed], pa.binary()),
            pa.nulls(len(closed), pa.int64()), pa.array([False] * len(closed), pa.bool_()),
        ], schema=SCHEMA)

    def leftovers(self, task: int) -> pa.RecordBatch:
        rows = [(*p, w) for w, (pieces, _) in enumerate(self.windows) for p in pieces]
        return pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
            pa.array([len(r[2]) // 4 for r in rows], pa.int64()), pa.nulls(len(rows), pa.int64()),
            pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64()),
            pa.nulls(len(rows), pa.int64()), pa.array([r[2] for r in rows], pa.binary()),
            pa.array([task] * len(rows), pa.int64()), pa.array([True] * len(rows), pa.bool_()),
        ], schema=SCHEMA)


def _first_id(level: int, task: int) -> int:
    return (level << 58) + (task << 26)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 1,
         open_windows: int = 16, keep_ids: bool = True, added_tokens: bool = False) -> DataFrame:
    """Pieces of all texts of ``docs`` in sequences of ``size`` tokens.

    A document is its ids, null and empty texts none, and ``end_id``. Columns: doc_id, start (ids of the
    document before the piece), length, ids_crc32 (of the ids as little-endian unsigned 32-bit values),
    doc_tokens, sequence_id, offset (in the sequence, gapless) and ``ids`` (those bytes; null without
    ``keep_ids``). All sequences are full but at most eleven at the end, whose lengths are powers of two.
    Null ids are packed like others; repeated rows are packed each; other columns are not read; an empty table
    gives no pieces. ``tokenizer`` is the file of the vocabulary, read on the driver and sent to the workers.
    With ``added_tokens`` names of the file's added tokens in a text give their ids, otherwise they are ordinary text.

    Each task packs its own rows with ``open_windows`` open windows; the leftovers, at most that many windows
    a task, are written with their ids and merged 64 tasks at a time until one group is left.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        encode, packer = _encoder(definition.value, added_tokens), Packer(size, open_windows, _first_id(0, task))
        for batch in batches:
            for key, text in zip(batch.column("_key").to_pylist(), batch.column("_text")):
                ids = encode(text.as_py() or "") + end
                packer.add(key, 0, ids, len(ids) // 4)
                if len(packer.closed) >= 2000:
                    yield packer.rows(keep_ids)
        yield packer.rows(keep_ids)
        yield packer.leftovers(task)

    rows = docs.select(F.col(id_col).cast("long").alias("_key"), F.col(text_col).alias("_text"))
    packed = written(rows.mapInArrow(run, DDL))
    done, level = packed.where("not open"), 0
    while True:
        left = packed.where("open")
        last = left.agg(F.max("task")).first()[0]
        if last is None:
            return done.drop("task", "open")
        level += 1
        packed = materialize(_merge(left, level, last < FAN_IN, size, open_windows, keep_ids))
        done = done.unionByName(packed.where("not open"))


def _merge(left: DataFrame, level: int, final: bool, size: int, open_windows: int, keep_ids: bool) -> DataFrame:
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("task", "ascending"), ("sequence_id", "ascending"), ("doc_id", "ascending"), ("start", "ascending")])
        task = group.column("task")[0].as_py() // FAN_IN
        packer = Packer(size, open_windows, _first_id(level, task))
        columns = (group.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens"))
        for piece in zip(*columns):
            packer.add(*piece)
        if final:
            packer.drain()
        return pa.Table.from_batches([packer.rows(keep_ids), packer.leftovers(task)], SCHEMA)

    return left.groupBy(F.floor(F.col("task") / FAN_IN)).applyInArrow(run, DDL)


def padding(pieces: Iterable, size: int) -> int:
    """Padding of sequences, given (sequence_id, length) pairs: tokens missing to ``size``, none at a power of two."""
    used: dict[int, int] = {}
    for sequence, length in pieces:
        used[sequence] = used.get(sequence, 0) + length
    return sum(size - n for n in used.values() if n & (n - 1))
